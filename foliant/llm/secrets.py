"""Secret scan: named patterns, and a battery of randomness tests on what looks like encoded bytes.

Runs of 16 encoding characters and more are tested against two descriptions. Under "random" the symbols are uniform over
the inferred alphabet: chi-squared over the alphabet, Wald-Wolfowitz runs about its middle and lag-one serial
correlation each give a p-value, joined by Fisher's rule. "Ordinary text" is a chain over the kinds of symbols (small,
capital, digit, mark) with the frequencies of letters within a kind. The likelihood of a run as text over that as even
symbols of its alphabet bounds the chance that text looks as random as the run, at any length and for each alphabet
(Markov's inequality; the alphabet's choice is paid for). The bound falls with the length, and is what the
Benjamini-Hochberg rule controls over the runs of a document. A span is reported when text is rejected and random isn't.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, spread, text_of

KINDS = ("assign", "access", "hex", "random")
FALSE_DISCOVERY, RANDOM_P, MIN_RUN = 0.02, 0.01, 16
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_RUN)
_ASSIGN_HINTS = ("assw", "ecret", "oken", "api")
# Relative frequency of a to z in English text, in per mille.
_LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
_ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base32 small": "abcdefghijklmnopqrstuvwxyz234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
# The kind of the next symbol in words, names, identifiers, paths and dates; rows and columns are small, capital, digit, mark.
_NEXT = ((0.86, 0.04, 0.03, 0.07), (0.45, 0.45, 0.04, 0.06), (0.10, 0.10, 0.65, 0.15), (0.50, 0.20, 0.28, 0.02))
_INDEX = {k: {c: i for i, c in enumerate(v)} for k, v in _ALPHABETS.items()}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the three named kinds, each leftmost and not overlapping within its kind."""
    out = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def encoding(run: str) -> str | None:
    """The smallest alphabet that holds all symbols; None for plain numbers and runs of letters of one case."""
    own = set(run)
    if own <= set("0123456789") or run.isalpha() and (run.islower() or run.isupper() or run.istitle()):
        return None
    return next((k for k, v in _INDEX.items() if own <= v.keys()), None)


def _chi2_tail(x: float, dof: float) -> float:
    """Upper tail by the Wilson-Hilferty cube root."""
    if x <= 0:
        return 1.0
    z = ((x / dof) ** (1 / 3) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _uneven_p(chi: float, size: int, n: int) -> float:
    """Two-sided p-value of chi-squared of n even draws of size symbols, as too even is no chance either: by a gamma law
    with the statistic's exact mean and variance, which few draws of many symbols need (the usual law holds only for many
    draws of each). Half a step is taken off for the statistic's lattice."""
    mean, var = size - 1, 2 * (size - 1) * (n - 1) / n
    above, step = lambda x: _chi2_tail(x * 2 * mean / var, 2 * mean * mean / var), size / n
    return min(1.0, 2 * min(above(chi - step), 1 - above(chi + step)))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _within(c: str) -> float:
    """Log share of a symbol among those of its kind in text; a tenth of the letters fall evenly."""
    k = _kind(c)
    return math.log(0.9 * _LETTERS[ord(c.lower()) - 97] / sum(_LETTERS) + 0.1 / 26 if k < 2 else 1 / 10 if k == 2 else 1 / 4)


_WITHIN = {c: (_kind(c), _within(c)) for c in sorted(set().union(*_ALPHABETS.values()))}
_STEP = [[math.log(p) for p in row] for row in _NEXT]


def text_p(run: str, size: int) -> float:
    """Bound of the chance that ordinary text is as likely as this under even symbols of an alphabet of that size."""
    last, ratio = None, math.log(len(_ALPHABETS) / 4) + len(run) * math.log(size)  # the first symbol's kind is even
    for c in run:
        k, share = _WITHIN[c]
        ratio += share + (0 if last is None else _STEP[last][k])
        last = k
    return math.exp(min(0.0, ratio))


def battery(run: str) -> dict | None:
    """p-values of the three tests, their Fisher join, and the chance of such a run in ordinary text."""
    run = run.rstrip("=")
    kind = encoding(run)
    if kind is None:
        return None
    alphabet, n = _ALPHABETS[kind], len(run)
    at, size = [_INDEX[kind][c] for c in run], len(alphabet)
    chi = size / n * sum(c * c for c in Counter(at).values()) - n
    p_chi = _uneven_p(chi, size, n)
    high = [2 * i >= size for i in at]
    a = sum(high)
    b = n - a
    if a and b:
        mean = 1 + 2 * a * b / n
        var = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        p_runs = _two_sided((1 + sum(x != y for x, y in zip(high, high[1:], strict=False)) - mean) / math.sqrt(var))
    else:
        p_runs = 2.0 ** (1 - n)
    mu = sum(at) / n
    spread_ = sum((x - mu) ** 2 for x in at) or 1e-9
    serial = sum((x - mu) * (y - mu) for x, y in zip(at, at[1:], strict=False)) / spread_
    p_serial = _two_sided((serial + 1 / n) * math.sqrt(n))
    fisher = -2 * sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    return {"encoding": kind, "p_chi": p_chi, "p_runs": p_runs, "p_serial": p_serial, "p_random": _chi2_tail(fisher, 6), "p_text": text_p(run, size)}


def random_spans(text: str, taken: list[tuple[int, int, str]], rate: float = FALSE_DISCOVERY, random_p: float = RANDOM_P) -> list[tuple[int, int, str]]:
    """Runs outside the given spans that the battery calls random, at the given false-discovery rate over the text."""
    tested = []
    for m in _RUN.finditer(text):
        if any(a < m.end() and m.start() < b for a, b, _ in taken):
            continue
        if got := battery(m.group()):
            tested.append((got["p_text"], got["p_random"], m.start(), m.end()))
    tested.sort()
    most = max((i for i, x in enumerate(tested, 1) if x[0] <= rate * i / len(tested)), default=0)
    return [(a, b, "random") for _, p, a, b in tested[:most] if p >= random_p]


def scan(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) in code points, by start, then kind as listed in KINDS."""
    base = base_spans(text)
    return sorted(base + random_spans(text, base), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((x[0], x[1]) for x in spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def redact(text: str, spans, mark: str = "[SECRET]") -> str:
    out, last = [], 0
    for a, b in merged(spans):
        out += [text[last:a], mark]
        last = b
    return "".join([*out, text[last:]])


def secret_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: its spans and, with_text, the text with every span replaced.

    Null counts as empty; an empty text has no spans; repeated rows stay, no rows give none. Whole texts are scanned,
    however long; spans that begin at one place are in the order of KINDS. Other columns are ignored.
    """
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
    schema = pa.schema([("id", pa.int64()), ("spans", pa.list_(span))] + [("redacted", pa.string())] * with_text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, texts = [], b.column(1).to_pylist()
            for text in texts:
                spans.append(scan(text))
            rows = pa.array([[{"start": x, "end": y, "kind": k} for x, y, k in s] for s in spans], pa.list_(span))
            yield batch(schema, [b.column(0), rows] + [[redact(t, s) if s else t for t, s in zip(texts, spans, strict=True)]] * with_text)

    return spread(text_of(docs, id_col, text_col)).mapInArrow(judge, "id long, spans array<struct<start:int,end:int,kind:string>>" + ", redacted string" * with_text)


def redacted_column(text: Column) -> Column:
    """A column of texts with every span replaced; nulls and empty texts stay, equal texts come out equal, long ones are scanned
    whole, and an empty table gives an empty column."""

    @F.arrow_udf("string")
    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for own in texts:
            yield pa.array([t and redact(t, scan(t)) for t in own.to_pylist()], pa.string())

    return judge(text)
