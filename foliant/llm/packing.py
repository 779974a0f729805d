"""Packing: non-negative least squares over shallow combinations of lengths.

Documents are cut into whole windows and a remainder. Remainders are counted in bins; every combination of up to three
bins that fills the window is a column, and non-negative least squares finds how often each should be used so that the
histogram is met. Counts are rounded and never exceed what is there. What is left over is packed greedily, one after
another, cut at window ends; a last window is cut at powers of two, which need no padding.

Ranks within bins, and places within the left-over stream, are running sums: each task keeps its own, and a table of a row
for each task and bin adds them up by bin. The driver sees a row for each bin. No document is moved (unless that table is
too large to be sent to all machines: then Spark shuffles the tokens once); lengths are added up within a sequence.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, batch, saved, spread, text_of

WINDOW, BIN, END_ID, DEPTH = 4096, 16, 2, 3
CACHED_WORDS, AT_ONCE = 200_000, 2_000_000


#: Words of letters whose composed form and lower case are plain: ASCII's and Latin-1's. A stop or comma may follow.
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


class Merges:
    """Byte-pair merges of many words at once: in each round every word merges its leftmost pair of the lowest rank."""

    NO = np.int32(1 << 30)

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; others follow from 256 up
        char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        self.first, self.last = (np.array([vocab[char[b] + e] for b in range(256)], np.int64) for e in ("", end))
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[x] << 17 | vocab[y] for x, y in pairs], np.int64)
        merged = np.array([vocab[x + y] for x, y in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int32), merged
        bits = 20  # a table by hash, with the sorted keys for the few that collide
        self.shift = np.uint64(64 - bits)
        slot = self._slot(self.keys)
        self.table_key, self.table_rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.NO, np.int32)
        self.table_key[slot], self.table_rank[slot] = self.keys, self.ranks
        self.crowded = np.zeros(1 << bits, bool)
        self.crowded[slot[self.table_key[slot] != self.keys]] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 17 | right
        slot = self._slot(keys)
        out = np.where(self.table_key[slot] == keys, self.table_rank[slot], self.NO)
        if (odd := np.flatnonzero(self.crowded[slot])).size:
            at = np.minimum(np.searchsorted(self.keys, keys[odd]), len(self.keys) - 1)
            out[odd] = np.where(self.keys[at] == keys[odd], self.ranks[at], self.NO)
        return out

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """Ids in two bytes each, of words of letters."""
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8).copy()
        flat[(flat >= 0x41) & (flat <= 0x5A)] += 0x20
        second = np.zeros(len(flat), bool)
        second[1:] = flat[:-1] == 0xC3
        flat[second & (flat <= 0x9E)] += 0x20
        ends = np.cumsum(sizes)
        ids = self.first[flat]
        ids[ends - 1] = self.last[flat[ends - 1]]
        out: list[bytes] = [b""] * len(words)
        which = np.arange(len(words))
        # rank of each symbol with the next one; none at a word's end
        rank = np.full(len(ids), self.NO, np.int32)
        rank[:-1] = self._rank(ids[:-1], ids[1:])
        rank[ends - 1] = self.NO
        starts = ends - sizes
        while len(which):
            low = np.minimum.reduceat(rank, starts)
            done = low == self.NO
            sizes = np.diff(starts, append=len(ids))
            if done.any():
                blob = ids.astype(np.uint16).tobytes()
                for w, a, n in zip(which[done].tolist(), starts[done].tolist(), sizes[done].tolist(), strict=True):
                    out[w] = blob[2 * a : 2 * (a + n)]
                keep = np.repeat(~done, sizes)
                ids, rank, which, sizes, low = ids[keep], rank[keep], which[~done], sizes[~done], low[~done]
                starts = np.cumsum(sizes) - sizes
                if not len(which):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, sizes))
            word = np.repeat(np.arange(len(which)), sizes)[hit]
            at = hit[np.concatenate(([True], word[1:] != word[:-1]))]  # one for each word: the leftmost
            ids[at] = self.merged[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            ids, rank = ids[keep], rank[keep]
            sizes = sizes - 1
            starts = np.cumsum(sizes) - sizes
            ends = starts + sizes - 1
            inner = moved < ends
            rank[moved] = self.NO
            rank[moved[inner]] = self._rank(ids[moved[inner]], ids[moved[inner] + 1])
            before = moved > starts
            rank[moved[before] - 1] = self._rank(ids[moved[before] - 1], ids[moved[before]])
        return out


class Tokens:
    """Ids of texts, word by word: the tokenizer's pieces never cross ASCII white space, so equal words have equal ids.

    Words of plain letters are merged by the vocabulary's own merges, many at once; the tokenizer does all others.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.merges = Tokenizer.from_file(path), Merges(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.signs = {s: self._whole([s])[0] for s in (b".", b",")}

    def _whole(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, np.uint16).tobytes() for e in found]

    def _learn(self, words: set[bytes]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHED_WORDS:  # what was learnt before stays for one generation more
            self.known, self.older, new = {}, self.known, words
        older = self.older
        self.known.update((w, older[w]) for w in new if w in older)
        new = new.difference(self.known)
        plain, stems, signs, others = [], [], [], []
        for w in new:
            m = _LETTERS.match(w)
            sign = w[m.end() :] if m else w
            if not sign:
                plain.append(w)
                stems.append(w)
                signs.append(b"")
            elif m and sign in self.signs:
                plain.append(w)
                stems.append(m.group())
                signs.append(self.signs[sign])
            else:
                others.append(w)
        for at in range(0, len(plain), 20_000):
            part = slice(at, at + 20_000)
            for w, ids, sign in zip(plain[part], self.merges(stems[part]), signs[part], strict=True):
                self.known[w] = ids + sign
        for at in range(0, len(others), 2_000):
            part_ = others[at : at + 2_000]
            self.known.update(zip(part_, self._whole(part_), strict=True))

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids in two bytes each; texts are taken some at a time, so that few words are held."""
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end]) <= AT_ONCE):
                held += len(texts[end])
                end += 1
            split = [t.split() for t in texts[at:end]]
            self._learn(set().union(*split))
            for words in split:
                yield b"".join(map(self.known.__getitem__, words))
            at = end


def _tokenized(path: str, window: int, width: int):
    schema = pa.schema([("slice", pa.int32()), ("id", pa.int64()), ("ids", pa.binary()), ("n", pa.int64()), ("full_before", pa.int64()), ("bin", pa.int32()), ("rank", pa.int64()), ("before", pa.int64())])
    end = np.array([END_ID], np.uint16).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, me = Tokens(path), TaskContext.get().partitionId()
        ranks, sums, full = (np.zeros(window // width + 2, np.int64) for _ in range(3))
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            size = 0
            for k, ids in zip(b.column(0).to_pylist(), tokens(as_bytes(b.column(1))), strict=True):
                ids += end
                n = len(ids) // 2
                rest = n % window
                at = -(-rest // width)
                for to, x in zip(out, (k, ids, n, int(full[at]), at, int(ranks[at]), int(sums[at])), strict=True):
                    to.append(x)
                full[at] += n // window
                ranks[at] += 1
                sums[at] += rest
                size += len(ids)
                if size > 16_000_000:
                    yield batch(schema, [[me] * len(out[0]), *out])
                    out, size = [[] for _ in range(7)], 0
            if out[0]:
                yield batch(schema, [[me] * len(out[0]), *out])

    return run


def combinations(units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Ascending tuples of up to depth bins that add up to units."""
    out: list[tuple[int, ...]] = []

    def go(have: tuple[int, ...], least: int, rest: int) -> None:
        if rest == 0:
            out.append(have)
        elif len(have) + 1 == depth:
            if rest >= least:
                out.append((*have, rest))
        else:
            out.extend([(*have, rest)] if rest >= least and have else [])
            for x in range(least, rest // 2 + 1):
                go((*have, x), x, rest - x)

    go((), 1, units)
    return sorted({*out, (units,)})


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lawson and Hanson's active-set method on the normal equations. No more than three rounds for each column are
    needed in practice; what a stop there leaves unmet goes to the greedy packing."""
    target = a.T @ b
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(3 * a.shape[1]):
        slope = target - a.T @ (a @ x)
        slope[used] = 0
        j = int(slope.argmax())
        if slope[j] <= 1e-9 * (1 + abs(target).max()):
            break
        used[j] = True
        while True:
            own = np.flatnonzero(used)
            sub = a[:, own]
            s = np.linalg.lstsq(sub.T @ sub, target[own], rcond=None)[0]
            if s.min() > 1e-12:
                x[:] = 0
                x[own] = s
                break
            low = s <= 1e-12
            step = np.min(x[own][low] / np.maximum(x[own][low] - s[low], 1e-300))
            x[own] += step * (s - x[own])
            used &= x > 1e-12
            x[~used] = 0
            if not used.any():
                break
    return x


def repeats(histogram: np.ndarray, units: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Combinations with how often each is used; never more of a bin than the histogram has. histogram: by bin, from 0."""
    left = histogram.astype(np.int64).copy()
    shapes = [c for c in combinations(units, depth) if all(left[x] for x in c)]
    if not shapes:
        return []
    a = np.zeros((units + 1, len(shapes)))
    for j, c in enumerate(shapes):
        for x in c:
            a[x, j] += 1
    scale = max(1.0, float(left.max()))
    x = nnls(a, left / scale) * scale
    out = []
    for j in np.argsort(-x, kind="stable"):
        need: dict[int, int] = {}
        for at in shapes[j]:
            need[at] = need.get(at, 0) + 1
        n = int(min([round(float(x[j])), *(left[k] // m for k, m in need.items())]))
        if n > 0:
            out.append((shapes[j], n))
            for k, m in need.items():
                left[k] -= n * m
    return out


class Plan:
    """Where ranks of bins go, and where windows of the left-over stream end."""

    def __init__(self, histogram: np.ndarray, window: int, width: int, first: int) -> None:
        self.window, self.first = window, first
        self.placed = np.zeros(len(histogram), np.int64)
        self.slots: list[list[tuple[int, int, int]]] = [[] for _ in histogram]  # by bin: first rank, first sequence, slot
        for shape, n in repeats(histogram, window // width):
            for slot, at in enumerate(shape):
                self.slots[at].append((int(self.placed[at]), self.first, slot))
                self.placed[at] += n
            self.first += n

    def place(self, at: int, rank: int) -> tuple[int, int]:
        """Sequence and slot of a rank that has one."""
        import bisect

        own = self.slots[at]
        start, sequence, slot = own[bisect.bisect_right(own, (rank, float("inf"), 0)) - 1]
        return sequence + rank - start, slot

    def stream(self, total: int) -> None:
        """The left-over stream's length: whole windows, then powers of two."""
        whole, rest = divmod(total, self.window)
        self.whole, self.tail = whole, [whole * self.window]
        for k in range(self.window.bit_length() - 1, -1, -1):
            if rest >> k & 1:
                self.tail.append(self.tail[-1] + (1 << k))

    def cuts(self, start: int, length: int) -> list[tuple[int, int, int]]:
        """Pieces (offset in the remainder, length, sequence) of a stretch of the stream."""
        edges = [x for x in range((start // self.window + 1) * self.window, min(start + length, self.tail[0] + 1), self.window)]
        edges = sorted({start, *edges, *(x for x in self.tail if start < x < start + length), start + length})
        where = lambda x: x // self.window if x < self.tail[0] else self.whole + next(i for i, (_, b) in enumerate(pairwise(self.tail)) if x < b)
        return [(a - start, b - a, self.first + where(a)) for a, b in pairwise(edges)]


PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long"


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, width: int = BIN) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. tokenizer: a path on every machine.

    Null counts as empty: such a document is its end id alone. Repeated rows, and rows with equal ids, are documents of
    their own; no rows give none. Texts of any length are cut into whole windows. Ties in length go by task and place in it. Other columns are ignored.
    The window is a power of two and a multiple of the bin width.
    """
    bins = window // width + 1
    rows = spread(text_of(docs, id_col, text_col)).mapInArrow(_tokenized(tokenizer, window, width), "slice int, id long, ids binary, n long, full_before long, bin int, rank long, before long")
    tokens = saved(rows, "tokens")
    so_far = Window.partitionBy("bin").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    above = lambda c: F.coalesce(F.sum(c).over(so_far), F.lit(0))
    # a row for each task and bin, not for each document
    counts = tokens.groupBy("slice", "bin").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("n") / window)).alias("full"))
    counts = saved(counts.withColumn("ranks", above("n")).withColumn("fulls", above("full")), "counts")
    n, full = np.zeros(bins, np.int64), np.zeros(bins, np.int64)
    for r in counts.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("full").alias("full")).collect():
        n[r.bin], full[r.bin] = r.n, r.full
    histogram = n.copy()
    histogram[0] = 0
    plan = Plan(histogram, window, width, int(full.sum()))
    spark, by_bin = docs.sparkSession, lambda x: F.array(*[F.lit(int(v)) for v in x])[F.col("bin")]
    # of a task's ranks in a bin, those with a place
    cut = F.least(F.greatest(by_bin(plan.placed) - F.col("ranks"), F.lit(0)), F.col("n"))
    base = by_bin(np.cumsum(full) - full)
    places = counts.select("slice", "bin", "ranks", cut.alias("cut"), (base + F.col("fulls")).alias("fulls"))
    late = F.when(F.col("rank") >= F.col("cut"), F.col("before")), F.when(F.col("rank") >= F.col("cut"), F.col("n") % window)
    rests = tokens.where("bin > 0").select("slice", "bin", "rank", "before", "n").join(places.select("slice", "bin", "cut"), ["slice", "bin"])
    rests = rests.groupBy("slice", "bin").agg(F.min(late[0]).alias("early"), F.coalesce(F.sum(late[1]), F.lit(0)).alias("late"))
    rests = saved(rests.withColumn("above", above("late")), "rests")
    stream = np.zeros(bins, np.int64)
    for r in rests.groupBy("bin").agg(F.sum("late").alias("late")).collect():
        stream[r.bin] = r.late
    plan.stream(int(stream.sum()))
    shift = by_bin(np.cumsum(stream) - stream) + F.col("above") - F.col("early")
    known = saved(places.join(rests.select("slice", "bin", shift.alias("shift")), ["slice", "bin"], "left"), "places")
    held = spark.sparkContext.broadcast(plan)  # of one size, whatever the documents

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = held.value
        schema = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])
        for b in batches:
            out: list[tuple] = []
            for k, ids, n, before, at, rank, cum, cut, ranks, fulls, shift in zip(*(c.to_pylist() for c in b.columns), strict=True):
                pieces = [(i * window, window, fulls + before + i, 0) for i in range(n // window)]
                base = n // window * window
                if at and rank < cut:
                    pieces.append((base, n - base, *plan.place(at, ranks + rank)))
                elif at:
                    where = shift + cum
                    pieces += [(base + x, m, q, where + x) for x, m, q in plan.cuts(where, n - base)]
                own = np.frombuffer(ids, np.uint16).astype("<u4")
                out += [(k, x, m, zlib.crc32(own[x : x + m].tobytes()), n, q, slot) for x, m, q, slot in pieces]
            yield batch(schema, list(map(list, zip(*out, strict=True)))) if out else batch(schema, [[]] * len(schema))

    # sent to all machines only where Spark finds the saved table small enough (spark.sql.autoBroadcastJoinThreshold)
    pieces = tokens.join(known, ["slice", "bin"]).select("id", "ids", "n", "full_before", "bin", "rank", "before", "cut", "ranks", "fulls", "shift").mapInArrow(lay, PIECES)
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("slot")
