"""Toxicity: a weighted lexicon found by one Aho-Corasick automaton in folded text.

Folding lower-cases, maps look-alike letters of other scripts, accents and digits to plain letters and drops invisible
characters; the folded words stand between single blanks, so that a term is a word (` idiot `) or a beginning (` idio`).
Weights are smoothed log odds of a term's documents among labelled ones. An occurrence inside an exception phrase
doesn't count. What is found, in all and by length, goes through a logistic function fitted on the same rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, saved, spread, text_of

#: Bound on labelled rows that the lexicon and the logistic function are fitted on: those of the smallest hashes of ids.
FIT_ROWS = 40_000
PREFIXES = (4, 5, 6)
MIN_DOCS, MIN_SHARE, MIN_WEIGHT = 4, 0.003, 3.0
# Seed terms with a weight until labels say otherwise, and phrases in which terms are harmless.
SEED = ("clown", "disgusting", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
SEED_WEIGHT = 4.0
EXCEPTIONS = ("class clown", "clown fish", "clown fishes", "idiot proof", "trash bag", "trash bags", "trash bin", "trash bins", "trash can", "trash cans", "trash collection", "worthless check")
# Look-alikes.
_LOOKS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɡ": "g",
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e",
}
_INVISIBLE = {0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF}
_INNER = re.compile(r"(?<=[^\W\d_])[!|](?=[^\W\d_])")


class _Fold(dict):
    """Code point to its folded form, worked out when first met."""

    def __missing__(self, c: int) -> str:
        ch = chr(c)
        if c in _INVISIBLE:
            out = ""
        else:
            out = "".join(self._plain(x) for x in unicodedata.normalize("NFKD", ch.lower()) if not unicodedata.combining(x)) if ch not in _LOOKS else _LOOKS[ch]
            out = out or ("" if unicodedata.combining(ch) else " ")
        self[c] = out
        return out

    def _plain(self, x: str) -> str:
        return _LOOKS.get(x) or (x if x.isalnum() else " ")


_fold = _Fold()


def fold(text: str) -> str:
    """Folded words between single blanks, one at either end; a single blank if there are none."""
    if "!" in text or "|" in text:
        text = _INNER.sub("i", text)
    words = text.translate(_fold).split()
    return f" {' '.join(words)} " if words else " "


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0 if doc_id is not None else False


def terms(folded: str) -> set[str]:
    """Words and their beginnings, as the automaton knows them."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) > n}


@dataclass
class Model:
    weights: dict[str, float]
    coefficients: list[float] = field(default_factory=lambda: [-3.0, 1.5, 1.0])
    exceptions: tuple[str, ...] = EXCEPTIONS

    def compiled(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model) -> None:
        import ahocorasick

        self.coefficients, self.automaton, self.known = model.coefficients, ahocorasick.Automaton(), bool(model.weights)
        for term, w in model.weights.items():
            self.automaton.add_word(term, (len(term), w))
        for phrase in model.exceptions:
            term = fold(phrase)
            self.automaton.add_word(term, (len(term), 0.0))
        if len(self.automaton):
            self.automaton.make_automaton()

    def found(self, folded: str) -> list[tuple[int, int, float]]:
        """Occurrences (start, end, weight) outside exception phrases, the heaviest of those that begin at one place."""
        if not self.known:
            return []
        best: dict[int, tuple[int, float]] = {}
        masks = []
        for last, (n, w) in self.automaton.iter(folded):
            start = last + 1 - n
            if not w:
                while masks and masks[-1][0] >= start:  # inside this one
                    masks.pop()
                if not masks or last > masks[-1][1]:
                    masks.append((start, last))
            elif start not in best or w > best[start][1]:
                best[start] = last + 1, w
        starts = [a for a, _ in masks]  # ends ascend with them
        inside = lambda s: (i := bisect_right(starts, s)) > 0 and s < masks[i - 1][1]
        return [(s, e, w) for s, (e, w) in sorted(best.items()) if not inside(s)]

    def features(self, text: str) -> tuple[float, float]:
        folded = fold(text)
        total = sum(w for _, _, w in self.found(folded))
        return math.log1p(total), math.log1p(100 * total / folded.count(" ")) if total else 0.0

    def score(self, features: tuple[float, float]) -> float:
        z = self.coefficients[0] + sum(c * x for c, x in zip(self.coefficients[1:], features, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Newton's method with a small ridge on all but the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    keep[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", fit_rows: int = FIT_ROWS, seed=SEED, exceptions=EXCEPTIONS) -> Model:
    """Lexicon and logistic function from labelled rows that aren't held out, at most fit_rows of them.

    Null labels and ids don't count; of an id's labels, and of equal texts, the largest holds and counts once. Without toxic
    and clean rows the seed remains. Ties among the smallest hashes go by id. Empty tables leave the seed.
    """
    out = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)) == 0
    marks = labels.select(F.col(f"`{label_id}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where("id is not null and toxic is not null").where(~out)
    marks = marks.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    rows = saved(text_of(docs, id_col, text_col).join(F.broadcast(marks), "id").groupBy(F.sha2("text", 256).alias("k")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")), "labelled")
    count = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = count.get(1, 0), count.get(0, 0)
    model = Model({f" {w} ": SEED_WEIGHT for w in map(str.strip, map(fold, seed))}, exceptions=tuple(exceptions))
    if not toxic or not clean:
        return model

    def counted(wanted: set[str] | None):
        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for b in batches:
                for text in b.column(0).to_pylist():
                    found = terms(fold(text))
                    total.update(found if wanted is None else found & wanted)
            yield batch(pa.schema([("term", pa.string()), ("n", pa.int64())]), [list(total), list(total.values())])

        return own

    def frequencies(of: int, wanted: set[str] | None) -> DataFrame:
        return spread(rows.where(F.col("toxic") == of).select("text")).mapInArrow(counted(wanted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))

    least = max(MIN_DOCS, math.ceil(MIN_SHARE * toxic))
    among = {r.term: r.n for r in frequencies(1, None).where(F.col("n") >= least).collect()}
    others = {r.term: r.n for r in frequencies(0, set(among)).collect()}
    weight = lambda t: math.log((among[t] + 0.5) / (toxic + 1)) - math.log((others.get(t, 0) + 0.5) / (clean + 1))
    learned = {t: w for t in among if (w := weight(t)) >= MIN_WEIGHT}
    # a word adds nothing to a beginning of it that is no less telling, nor a long beginning to a short one
    covered = lambda t: any(learned.get(t[: n + 1], 0) >= learned[t] - 1 for n in PREFIXES if n + 1 < len(t.rstrip()))
    for t in among:
        if t in model.weights and t not in learned:
            del model.weights[t]
    model.weights |= {t: w for t, w in learned.items() if not covered(t)}

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.compiled()
        for b in batches:
            got = [scorer.features(t) for t in b.column(0).to_pylist()]
            yield batch(pa.schema([("a", pa.float64()), ("b", pa.float64()), ("y", pa.int32())]), [[x[0] for x in got], [x[1] for x in got], b.column(1)])

    sample = spread(rows.select("text", "toxic")).mapInArrow(measured, "a double, b double, y int").toPandas()  # fit_rows rows of three numbers
    model.coefficients = _logistic(sample[["a", "b"]].to_numpy(), (sample.y > 0).to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted. Null counts as empty; empty texts get the score of no hit; a null id isn't held out.

    Whole texts are scanned; equal texts have equal scores, repeated rows stay, no rows give none, other columns are ignored.
    """
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.compiled()
        for b in batches:
            got = [scorer.score(scorer.features(t)) for t in b.column(1).to_pylist()]
            yield batch(schema, [b.column(0), [held_out(k) for k in b.column(0).to_pylist()], got, [int(x >= 0.5) for x in got]])

    return spread(text_of(docs, id_col, text_col)).mapInArrow(judge, "id long, held_out boolean, score double, predicted int")


def score_column(model: Model, text: Column) -> Column:
    """The score of a column of texts, for filters that keep a table's other columns. A null text is scored as an empty one, equal
    texts alike, long ones whole; an empty table gives no scores."""

    @F.arrow_udf("double")
    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = model.compiled()
        for own in texts:
            yield pa.array([scorer.score(scorer.features(t or "")) for t in own.to_pylist()], pa.float64())

    return judge(text)
