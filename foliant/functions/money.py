"""Amounts as text, as whole cents and in words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, strip, value

# Numerals and magnitudes of amounts in words, and signs around them that say nothing.
NUMERALS, GROUPS = "零壹贰叁肆伍陆柒捌玖", ("", "万", "亿", "万亿")
# a section's first two digits with their units, and its last two, by the number that they make; the last two behind a
# zero, or one where there are no tens; tenths and hundredths, alone and behind a whole
_HIGH, _LOW = (["".join(NUMERALS[d] + u for d, u in zip(divmod(n, 10), us, strict=True) if d) for n in range(100)] for us in (("仟", "佰"), ("拾", "")))
_AFTER_ZERO, _AFTER = ["零" * (n > 0) + t for n, t in enumerate(_LOW)], ["零" * (0 < n < 10) + t for n, t in enumerate(_LOW)]
_ALONE = ["".join(NUMERALS[d] + u for d, u in zip(divmod(n, 10), "角分", strict=True) if d) + "整" * (n % 10 == 0) for n in range(100)]
_BEHIND = ["零" * (0 < n < 10) + t for n, t in enumerate(_ALONE)]
_DIGITS = {"壹": 1, "贰": 2, "叁": 3, "肆": 4, "伍": 5, "陆": 6, "柒": 7, "捌": 8, "玖": 9, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "零": 0, "〇": 0}
_TENS = {"拾": 10, "十": 10, "佰": 100, "百": 100, "仟": 1000, "千": 1000}
_MAGNITUDES = {"万": 10_000, "亿": 100_000_000}
_NOISE = "人民币（()）:： ,，.。￥¥"
_D, _T = "".join(_DIGITS), "".join(_TENS)
_SAYS, _COUNTS, _PLAIN = re.compile(f"[{_D}{_T}万亿元圆角分]"), re.compile(r"\d[\d.]*"), re.compile(f"[{_D}{_T}万亿元圆角分整正]+")
_SECTIONS, _PART, _SILENT = re.compile("([^万亿]*)([万亿]?)"), re.compile(f"[{_D}]?[角分]"), {ord(c): None for c in _NOISE}
_FLOAT = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
#: Cells that stand for no amount. Fixed values.
EMPTY_CELLS = ("", "—", "-", "–", "/", "－", "——")


def _without_commas(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit(",")), F.lit("，"))


def clean_amount(x: Column | str) -> Column:
    """Without currency signs, thousands marks and blanks, where a number remains; else as it was."""
    s = strip(x)
    bare = F.regexp_replace(F.regexp_replace(s, "[￥¥,， \u3000]", ""), "元$", "")
    return F.when(bare.rlike(r"^-?\d+(?:\.\d+)?$"), bare).otherwise(s)


def normalize_amount(x: Column | str) -> Column:
    """Two decimals: the last two of a string of digits are the decimals, and its zeros stay; of other numbers ties go
    up in size; what is no number stays as it was, null is blank. Commas alone are taken out."""
    s, own = _without_commas(value(x)), col(x).cast("string")
    few, many = F.concat(F.lit("0."), F.lpad(s, 2, "0")), lambda t: F.concat(F.left(t, F.length(t) - 2), F.lit("."), F.right(t, F.lit(2)))
    # digits without signs or blanks around them, as most cells have them, are told by one look
    return F.when(own.rlike(r"^\d{3,}\z"), many(own)).when(s.rlike(r"^\d+$"), F.when(F.length(s) <= 2, few).otherwise(many(s))).when(s.rlike(_FLOAT), s.try_cast("decimal(38,2)").cast("string")).otherwise(value(x))


def cell_amount(x: Column | str) -> Column:
    """An amount in a table's cell with two decimals (whole numbers are whole amounts); marks for none are blank, other text stays."""
    s = strip(F.regexp_replace(value(x), "[,，元]", ""))
    return F.when(s.isin(*EMPTY_CELLS), "").when(s.rlike(_FLOAT), s.try_cast("decimal(38,2)").cast("string")).otherwise(value(x))


def to_cents(x: Column | str) -> Column:
    """Whole cents, halves to even; null where it isn't a number. Commas alone are taken out."""
    s, own = _without_commas(value(x)), col(x).cast("string")
    # of a normalised amount the digits are the cents
    return F.when(own == "", None).when(own.rlike(r"^\d{1,16}\.\d\d\z"), F.replace(own, F.lit(".")).try_cast("long")).when(s.rlike(_FLOAT), F.bround(s.try_cast("decimal(38,8)") * 100, 0).cast("long"))


def parse_words(text: str | None) -> float | None:
    """The number that an amount names; None if a sign in it means nothing.

    An amount is `whole 元 tenths 角 hundredths 分`; a whole is sections, each behind all of which its magnitude multiplies;
    a section is digits before units (none counts one), and a last digit. A string of digits has two implied decimals.
    """
    text = (text or "").strip()
    if not text:
        return None
    if not _PLAIN.fullmatch(text):
        if not _SAYS.search(text) and (digits := _COUNTS.search(re.sub("[,，]", "", text))):
            return int(digits[0].replace(".", "")) / 100
        text = text.translate(_SILENT)
        if not text or not _PLAIN.fullmatch(text):
            return None
    text = text.replace("整", "").replace("正", "").replace("圆", "元")
    head, _, tail = text.rpartition("元") if "元" in text else (text, "", "")
    whole, early = head.rpartition("元")[2], "角" in head or "分" in head
    total = 0
    for section, magnitude in _SECTIONS.findall(_PART.sub("", whole) if early else whole):
        total = (total + _section(section)) * _MAGNITUDES.get(magnitude, 1)
    tenths, hundredths = _small(text if early else tail)
    return round(total + tenths / 10 + hundredths / 100, 2)


@lru_cache(1 << 16)
def _section(text: str) -> int:
    """Digits before units, and a last digit; few sections are in use, and many amounts share them."""
    last = re.search(f"[{_D}]$", text)
    return sum((_DIGITS[d[-1]] if d else 1) * _TENS[u] for d, u in re.findall(f"([{_D}]*)([{_T}])", text)) + (_DIGITS[last[0]] if last else 0)


@lru_cache(1 << 16)
def _small(text: str) -> tuple[int, int]:
    """The digits before the last 角 and the last 分."""
    tenths, hundredths = (_DIGITS.get((re.findall(f"([{_D}]?){u}", text) or [""])[-1], 0) for u in "角分")
    return tenths, hundredths


def words_to_amount(x: Column | str) -> Column:
    """parse_words for a column; each different text of a batch is read once."""

    @F.pandas_udf("double")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for own in batches:
            at, texts = pd.factorize(own)  # null is at -1
            yield pd.Series(np.array([*map(parse_words, texts), None], "float64")[at])

    return parse(col(x))


def cents_in_words(cents: Column | str) -> Column:
    """An amount in capital numerals, without regard to its sign; null from ten quadrillions up.

    A section of no digits between others is a zero; one that begins with zeros isn't marked.
    """
    return _bound(F.abs(col(cents)).try_cast("long"), _in_words)


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it. Within another `_bound`, f uses its own value alone:
    a function in Python can't be given an expression whose inner lambda reads an outer one's variable."""
    return F.get(F.transform(F.array(x), f), 0)


def _in_words(c: Column) -> Column:
    part = lambda x, n: F.call_function("div", x, F.lit(n))
    named = lambda names, i: F.get(F.split(F.lit(",".join(names)), ","), i.cast("int"))

    def section(n: Column) -> Column:
        high, low = part(n, 100), n % 100
        return F.concat(named(_HIGH, high), F.when(high == 0, named(_LOW, low)).when(high % 10 == 0, named(_AFTER_ZERO, low)).otherwise(named(_AFTER, low)))

    def joined(n: Column) -> Column:
        def group(i: int) -> Column:
            own = part(n, 10 ** (4 * i)) % 10_000 if i else n % 10_000
            zero = (n >= 10 ** (4 * i + 4)) & (n % 10 ** (4 * i) > 0) if i else F.lit(False)
            text = F.when(own > 0, F.concat(_bound(own, section), F.lit(GROUPS[i]))).when(zero, "零").otherwise("")
            return F.when(n < 10 ** (4 * i), "").otherwise(text) if i else text

        return F.concat(*[group(i) for i in (3, 2, 1, 0)], F.lit("元"))

    whole = part(c, 100)
    return F.when(c == 0, "零元整").when(c < 100, named(_ALONE, c)).when(whole < 10**16, F.concat(_bound(whole, joined), named(_BEHIND, c % 100)))
