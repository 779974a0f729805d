"""Text rules as Column expressions. White space, letters and digits are Unicode's throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that stand for "nothing was seen", besides blanks. Fixed values.
ABSENT = ("未见", "未出现")
_SPACE = r"[\s\x1c-\x1f]"
# Dates with the year first or last.
DATE = r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4}"
# A cell of digits and signs alone; lines that hold a page number and nothing else.
SKIPPABLE = r"(?U)^[\d\s/\-:.,()%¥$€£#&+＋]+$"
PAGE_LINES = (r"(?Ui)^page\s*\d+(?:\s*(?:of|/)\s*\d+)?$", r"(?U)^第\s*\d+\s*页(?:\s*[,，]?\s*共\s*\d+\s*页)?$", r"(?U)^\d+\s*/\s*\d+$", r"(?U)^[-—–]\s*\d+\s*[-—–]$")
# Months in file names, a range and a single one.
MONTHS = r"(\d{4})年\s*(\d{1,2})\s*月?\s*[-—~至到]\s*(?:\d{4}年\s*)?(\d{1,2})\s*月"
MONTH = r"(\d{4})年(\d{1,2})月"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    return F.regexp_replace(col(x).cast("string"), f"(?U)^{_SPACE}+|{_SPACE}+$", "")


def value(x: Column | str) -> Column:
    """A field as filters see it: stripped, null as blank."""
    return F.coalesce(strip(x), F.lit(""))


def is_absent(x: Column | str, marks: tuple[str, ...] = ABSENT) -> Column:
    return value(x).isin("", *marks)


def clip(x: Column | str, n: int) -> Column:
    """At most n characters, an ellipsis for what is cut; 0: whole."""
    return col(x) if n <= 0 else F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 1), F.lit("…"))).otherwise(col(x))


def cell(x: Column) -> Column:
    """A number as a cell shows it: whole numbers without their `.0`; null is blank."""
    return F.coalesce(F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string")), F.lit(""))


def with_dates_marked(x: Column | str, before: str = "{D", after: str = "}", first: int = 0) -> Column:
    """Dates replaced by placeholders numbered from the left: {D0}, {D1}, ..., or what stands before and after a number."""
    parts = F.split(x, DATE, -1)
    numbered = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(before), (i - 1 + first).cast("string"), F.lit(after), p)))
    return F.array_join(numbered, "")


def dates(x: Column | str) -> Column:
    """The dates that with_dates_marked takes out, in order."""
    return F.regexp_extract_all(x, F.lit(f"({DATE})"), F.lit(1))


def with_dates_restored(x: Column | str, found: Column | str, before: str = "{D", after: str = "}", first: int = 0) -> Column:
    marked = F.transform(found, lambda d, i: F.struct(F.concat(F.lit(before), (i + first).cast("string"), F.lit(after)).alias("mark"), d.alias("date")))
    return F.aggregate(marked, col(x), lambda text, m: F.replace(text, m["mark"], m["date"]))


def xml_safe(x: Column | str) -> Column:
    """Without control characters that XML can't hold (tab and line ends stay)."""
    return F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")


def is_skippable(x: Column | str) -> Column:
    return col(x).rlike(SKIPPABLE)


def is_page_line(x: Column | str) -> Column:
    return reduce(lambda a, b: a | b, [strip(x).rlike(p) for p in PAGE_LINES])


def is_code(x: Column | str) -> Column:
    """Texts that need no rendering: any without a letter; else eight characters or more without a blank, with two digits
    or more and all letters capital. Blanks are none."""
    c = value(x)
    spelt = ~c.rlike(f"(?U){_SPACE}") & (F.length(c) >= 8) & (F.regexp_count(c, F.lit(r"(?U)\d")) >= 2) & ~c.rlike(r"[\p{L}&&[^\p{Lu}]]")
    return (c != "") & (~c.rlike(r"\p{L}") | spelt)


def fidelity(source: Column | str, target: Column | str, placeholder: str = r"\{D\d+\}") -> Column:
    """What is wrong with a rendering of a text, the first of this order, with what is missing behind a colon; `ok` if nothing.

    Placeholders and strings of digits must all be there; a text without letters must stay as it is; of a text of two
    English words or more a rendering without a Chinese sign may keep less than six tenths; a text of 60 characters or
    more may shrink to three tenths.
    """
    s, t = value(source), value(target)
    found = lambda x, pattern: F.regexp_extract_all(x, F.lit(f"({pattern})"), F.lit(1))
    missing = lambda xs: F.get(F.filter(xs, lambda x: ~F.contains(t, x)), F.lit(0))
    words = lambda x: F.regexp_count(x, F.lit("[A-Za-z]{2,}"))
    mark, number = missing(found(s, placeholder)), missing(found(F.regexp_replace(s, placeholder, ""), r"(?U)\d+"))
    kept = (words(s) >= 2) & ~t.rlike("[\u4e00-\u9fff]") & (words(t) >= F.greatest(F.lit(2), F.floor(words(s) * 0.6)))
    return (
        F.when(s == "", "ok")
        .when(t == "", "empty")
        .when(mark.isNotNull(), F.concat(F.lit("missing_placeholder:"), mark))
        .when(number.isNotNull(), F.concat(F.lit("missing_number:"), number))
        .when(~s.rlike("[A-Za-z\u4e00-\u9fff]") & (s != t), "not_identical")
        .when(kept, "untranslated")
        .when((F.length(s) >= 60) & (F.length(t) < F.length(s) * 0.3), "truncated")
        .otherwise("ok")
    )


#: How a second request opens, and what stands before the text; an answer with either has taken in its instruction.
AGAIN, BEFORE_TEXT = "The last answer failed a check", "\nSource: "
REASONS = ("empty", "missing_number", "missing_placeholder", "not_identical", "truncated", "untranslated")


def retry_prompt(source: Column | str, reason: Column | str, hints: dict[str, str] | None = None) -> Column:
    """The text behind what was wrong with its rendering: the hint for the reason's kind, or, without hints, the reason itself
    in a sentence. The text alone where there is none for it."""
    kind = F.split_part(col(reason), F.lit(":"), F.lit(1))
    if hints is None:
        said = F.when(kind.isin(*REASONS), F.concat(F.lit(f"{AGAIN}: "), F.replace(kind, F.lit("_"), F.lit(" ")), F.lit(".")))
    else:
        said = F.create_map(*[F.lit(x) for pair in hints.items() for x in pair])[kind] if hints else F.lit(None).cast("string")
    return F.when(said.isNotNull(), F.concat(said, F.lit(BEFORE_TEXT), col(source))).otherwise(col(source))


def year_month(path: Column | str) -> tuple[Column, Column, Column]:
    """Year, month and last month (padded) of a file name such as `2023年4月.csv` or `2023年11月-2024年1月.xlsx`; blank if there is none.

    The sign of the year is required, and that of the (last) month.
    """
    return months_of(months_named(path))


def months_named(path: Column | str) -> Column:
    """A file name's `year/month/last month` as they stand there, blank where there is none: what months_of reads."""
    name = basename(path)
    found = [F.regexp_replace(name, f"(?s)^.*?{pattern}.*$", to) for pattern, to in ((MONTHS, "$1/$2/$3"), (MONTH, "$1/$2/"))]  # a name has no stroke
    return F.when(F.contains(found[0], F.lit("/")), found[0]).when(F.contains(found[1], F.lit("/")), found[1]).when(name.isNotNull(), "//")


def months_of(named: Column | str) -> tuple[Column, Column, Column]:
    pad = lambda m: F.when(m == "", "").otherwise(F.lpad(m, 2, "0"))
    year, month, last = (F.split_part(col(named), F.lit("/"), F.lit(i)) for i in (1, 2, 3))
    return year, pad(month), F.coalesce(pad(last), F.lit(""))


def basename(path: Column | str) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column | str) -> Column:
    """The file name without its suffix; a leading point begins none."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def suffix(path: Column | str) -> Column:
    """The suffix in small letters, with its point; blank if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"(?<=.)(\.[^.]+)$", 1))


def masked_key(key: Column | str) -> Column:
    return F.concat(F.lit("****"), F.right(key, F.lit(4)))


def view_id(name: Column | str) -> Column:
    return F.concat(F.lit("view."), F.left(F.sha1(name), F.lit(10)))


def glossary(text: Column | str, most: int | None = None) -> Column:
    """Lines `term => rendering` as entries; of the separators in a line the first of this order counts; # begins a comment.
    `most` at most, in order."""
    separators = ("=>", "\t", "->", "→", "＝")

    def entry(line: Column) -> Column:
        at = F.coalesce(*[F.when(F.contains(line, F.lit(s)), F.struct(strip(F.substring_index(line, s, 1)).alias("term"), strip(F.substring(line, F.locate(s, line) + len(s), F.length(line))).alias("rendering"))) for s in separators])
        return at

    lines = F.filter(F.split(text, r"\r?\n"), lambda x: (value(x) != "") & ~value(x).startswith("#"))
    found = F.filter(F.transform(lines, entry), lambda e: e.isNotNull() & (e["term"] != "") & (e["rendering"] != ""))
    return found if most is None else F.slice(found, 1, most)


def sanitized(name: Column | str) -> Column:
    """A file name without characters that file systems refuse."""
    return F.regexp_replace(strip(name), r'[\\/:*?"<>|\x00-\x1f]+', "_")


def cell_number(x: Column | str) -> Column:
    """The number a text cell holds: not of leading zeros, more than twelve digits or anything but digits and one point."""
    s = strip(x)
    digits = F.length(F.regexp_replace(s, r"\D", ""))
    return F.when(s.rlike(r"^-?(?:0|[1-9]\d*|\d+\.\d+)$") & (digits <= 12), s.try_cast("double"))


def wall_seconds(ts: Column | str) -> Column:
    """Seconds since 1970 of a clock time, with or without a time zone."""
    return F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
