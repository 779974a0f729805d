"""Benchmark decontamination: an Aho-Corasick automaton over normalised benchmark texts, each document scanned once.

The automaton runs over words, not over letters, and lies in flat arrays: its tree is one sorted array of (state, word)
keys, where a key's place is the state it leads to, beside an array of links to the longest shorter match. That is 13
bytes a state, at most 13 states a word of the benchmark, and the vocabulary. Texts are cut into lanes that begin a
window early, so that many lanes take a step at once; an occurrence's end is a word's index, and indices map back to
code points.

The benchmark is a query set of stated size: up to PART_WORDS words are one automaton, built once on the driver and
broadcast (195 bytes a word, and 150 for each different one: 690 MB at most at the bound, in each Python worker). A
larger one is met in parts of that size, one after another; items longer than a part are cut into stretches that
overlap by a window less one word, so that no window is lost, and hits of several parts are joined by document.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, batch, saved, spread

#: Words of the benchmark in one automaton.
PART_WORDS = 2_000_000
#: Words that are scanned at once, and of a lane; one longer text is scanned alone.
SCAN_WORDS, LANE = 1 << 18, 64
WINDOW = 13
_SEPARATE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")

SCHEMA = "id long, n_words long, n_hit long, items array<string>, hit_words array<struct<start:int,end:int>>, spans array<struct<start:int,end:int>>"
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_SEPARATE).split() if text else []


class Automaton:
    """Windows of all items; items with an equal window share its state.

    State 0 is the root, and the states of each depth follow one another. Word 0 stands for every word that the benchmark
    hasn't and for the end of a text: it leads to the root from everywhere.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], size: int = WINDOW) -> None:
        self.vocabulary, self.code = sorted({w for _, own in items for w in own}), None
        self.items, self.size = [k for k, _ in items], size
        code, lengths = self._codes(), np.array([len(own) for _, own in items], np.int64)
        flat = np.fromiter((code[w] for _, own in items for w in own), np.int32, int(lengths.sum()))
        n = np.where(lengths > size, lengths - size + 1, np.minimum(lengths, 1))  # windows of each item
        owner = np.repeat(np.arange(len(items), dtype=np.int32), n)
        at = np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(n) - n), n) + np.arange(len(owner))
        self._grow(flat, at, np.minimum(lengths, size)[owner], owner)

    def _codes(self) -> dict[bytes, int]:
        return dict(zip(self.vocabulary, range(1, len(self.vocabulary) + 1), strict=True))

    def _grow(self, flat: np.ndarray, at: np.ndarray, length: np.ndarray, owner: np.ndarray) -> None:
        """The tree depth by depth; links and ends of a depth come from those above it."""
        self.keys, self.fail, self.first = np.empty(0, np.int64), np.zeros(1, np.int32), np.zeros(len(self.vocabulary) + 1, np.int32)
        self.level, ends, state, who = [0, 1], [], np.zeros(len(at), np.int64), owner
        for depth in range(self.size):
            below, inverse = np.unique(state << 32 | flat[at + depth], return_inverse=True)
            if not len(below):
                break
            parent, word = below >> 32, (below & 0xFFFFFFFF).astype(np.int32)
            if depth:
                fail = self._step(self.fail[parent].astype(np.int64), word)
            else:
                fail = np.zeros(len(below), np.int32)
                self.first[word] = np.arange(1, len(below) + 1)
            self.keys, self.fail = np.concatenate([self.keys, below]), np.concatenate([self.fail, fail.astype(np.int32)])
            state = self.level[-1] + inverse
            self.level.append(self.level[-1] + len(below))
            ended = length == depth + 1
            ends.append(np.unique(state[ended] << 32 | who[ended]))
            at, length, state, who = at[~ended], length[~ended], state[~ended], who[~ended]
        pairs = np.concatenate(ends) if ends else np.empty(0, np.int64)  # (state, item), in order, as states rise with depth
        self.owner = (pairs & 0xFFFFFFFF).astype(np.int32)
        self.ended, start = np.unique(pairs >> 32, return_index=True)
        self.bounds = np.append(start, len(pairs))
        self.hit = np.zeros(self.level[-1], bool)
        self.hit[self.ended] = True
        for a, b in zip(self.level[1:], self.level[2:]):
            self.hit[a:b] |= self.hit[self.fail[a:b]]

    def _step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The next state of each lane: down the tree, or by links until there is a way down."""
        out = self.first[word]
        if not len(self.keys):
            return out
        live = np.flatnonzero((state > 0) & (word > 0))
        s, w = state[live].astype(np.int64), word[live]
        while len(live):
            key = s << 32 | w
            to = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[to] == key
            out[live[found]] = to[found] + 1
            live, s, w = live[~found], self.fail[s[~found]].astype(np.int64), w[~found]
            on = s > 0
            live, s, w = live[on], s[on], w[on]
        return out

    def ends(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words at which an entry ends, in order, and their states."""
        lead, lanes = self.size - 1, -(-len(text) // LANE)
        own = np.zeros(lead + lanes * LANE, np.int32)
        own[lead : lead + len(text)] = text
        at, state, found = np.arange(lanes) * LANE, np.zeros(lanes, np.int32), []
        for step in range(lead + LANE):
            state = self._step(state, own[at + step])
            if step >= lead and len(lane := np.flatnonzero(self.hit[state])):
                found.append((lane * LANE + step - lead, state[lane]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        place, state = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(place)
        return place[order], state[order]

    def hits(self, texts: list[np.ndarray]) -> list[tuple[list[tuple[int, int]], set[int]]]:
        """Of each text the ranges of words inside occurrences, joined where they touch, and the items they come from."""
        out: list[tuple[list[tuple[int, int]], set[int]]] = [([], set()) for _ in texts]
        starts = np.cumsum([0, *(len(x) + 1 for x in texts)])
        place, state = self.ends(np.concatenate([x for t in texts for x in (t, np.zeros(1, np.int32))]) if texts else np.empty(0, np.int32))
        if not len(place):
            return out
        doc = np.searchsorted(starts, place, "right") - 1
        end, longest, chain, seen = place - starts[doc] + 1, np.zeros(len(place), np.int64), state.copy(), []
        rows = np.arange(len(place))
        while len(rows):
            k = np.minimum(np.searchsorted(self.ended, chain), len(self.ended) - 1)
            full = self.ended[k] == chain
            depth = np.searchsorted(self.level, chain, "right") - 1
            longest[rows[full]] = np.maximum(longest[rows[full]], depth[full])
            seen.append(np.unique(doc[rows[full]] << 32 | k[full]))
            chain = self.fail[chain]
            more = self.hit[chain]
            rows, chain = rows[more], chain[more]
        for pair in np.unique(np.concatenate(seen)).tolist():
            d, k = pair >> 32, pair & 0xFFFFFFFF
            out[d][1].update(self.owner[self.bounds[k] : self.bounds[k + 1]].tolist())
        for d, a, b in zip(doc.tolist(), (end - longest).tolist(), end.tolist(), strict=True):
            ranges = out[d][0]
            while ranges and ranges[-1][1] >= a:  # a longer window may end later and begin earlier
                a = min(a, ranges.pop()[0])
            ranges.append((a, b))
        return out

    def scan(self, texts: Iterable[bytes | None]) -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
        """Number of words, ranges and items of each text, in order."""
        code, held, n = self._known(), [], 0
        for text in texts:
            own = words(text)
            held.append(np.fromiter(map(code.get, own, repeat(0)), np.int32, len(own)))
            n += len(own)
            if n >= SCAN_WORDS:
                yield from self._scanned(held)
                held, n = [], 0
        yield from self._scanned(held)

    def _scanned(self, held: list[np.ndarray]) -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
        for own, (ranges, found) in zip(held, self.hits(held), strict=True):
            yield len(own), ranges, found

    def _known(self) -> dict[bytes, int]:
        """Codes of words; the list of words goes once they have codes."""
        if self.code is None:
            self.code, self.vocabulary = self._codes(), []
        return self.code

    def __getstate__(self) -> dict:
        return self.__dict__ | {"vocabulary": b" ".join(self.code or self.vocabulary), "code": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.vocabulary = self.vocabulary.split()

    def named(self, found: set[int]) -> list[str]:
        return sorted({self.items[i] for i in found} - {None})


def word_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words as ranges of code points of the original text."""
    if not ranges:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def _arrow(ids, n_words, n_hit, items, ranges, spans) -> pa.RecordBatch:
    dicts = lambda rows: pa.array([[{"start": a, "end": b} for a, b in r] for r in rows], _ARROW_SPANS)
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("hit_words", _ARROW_SPANS), ("spans", _ARROW_SPANS)])
    return batch(schema, [ids, n_words, n_hit, items, dicts(ranges), dicts(spans)])


def _pieces(bench: DataFrame, item_col: str, item_text: str, window: int, most: int) -> DataFrame:
    """Items' words joined by blanks, in stretches of at most `most` words: item, n, words. Equal stretches of an item are one."""
    rows = bench.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text")).where("text is not null")
    schema = pa.schema([("item", pa.string()), ("n", pa.int64()), ("words", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                own = words(text)
                parts = [own[i : i + most] for i in range(0, max(1, len(own) - window + 1), most - window + 1)]
                yield batch(schema, [[item] * len(parts), list(map(len, parts)), list(map(b" ".join, parts))])

    return rows.mapInArrow(cut, "item string, n long, words binary").where("n > 0").distinct()


class Parts:
    """The benchmark in blocks, one at a time on the driver and the machines; the pieces are a table in the shared folder."""

    def __init__(self, bench: DataFrame, item_col: str, item_text: str, window: int, most: int) -> None:
        most = min(most, PART_WORDS)
        piece = max(4 * window, most // 8)  # words of a stretch
        if most < 2 * piece:
            raise ValueError(f"parts of {most} words are too small for windows of {window}")
        pieces = saved(_pieces(bench, item_col, item_text, window, piece), "benchmark")
        total = pieces.agg(F.sum("n")).first()[0] or 0
        if total <= most:
            self.n, self.pieces = 1, pieces.withColumn("part", F.lit(0))
        else:  # slices by hash, of sixteen parts or so; the stretch that crosses a part's end still fits
            slices = -(-total // (16 * most))
            own = Window.partitionBy("slice").orderBy(F.xxhash64("words"), "words", "item").rowsBetween(Window.unboundedPreceding, 0)
            numbered = pieces.withColumn("slice", F.pmod(F.xxhash64("item", "words"), F.lit(slices))).withColumn("within", F.floor((F.sum("n").over(own) - 1) / F.lit(most - piece)))
            found = saved(numbered.drop("words").groupBy("slice", "within").agg(F.sum("n").alias("size")), "parts")
            keys = found.select("slice", "within").sort("slice", "within").collect()  # a row for each part
            self.n = len(keys)
            known = pieces.sparkSession.createDataFrame([(r.slice, r.within, i) for i, r in enumerate(keys)], "slice long, within long, part int")
            self.pieces = saved(numbered.join(F.broadcast(known), ["slice", "within"]).drop("slice", "within"), "pieces")
        self.window = window

    def rows(self, part: int) -> list[tuple[str | None, list[bytes]]]:
        return [(r.item, bytes(r.words).split()) for r in self.pieces.where(F.col("part") == part).sort("item", "words").collect()]

    def held(self, part: int) -> Broadcast:
        return self.pieces.sparkSession.sparkContext.broadcast(Automaton(self.rows(part), self.window))


def contamination(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """Per document: its words, the words inside an occurrence of any item's window, those items and the places.

    Null and empty texts have no words and no hits; an empty benchmark hits nothing; repeated items are told apart by
    their ids alone (equal ids count once). An item without an id counts in n_hit and the places; items leaves it out.
    Rows with equal ids stay separate rows. Very long texts and items are taken whole; other columns are ignored.
    """
    docs = spread(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")))
    parts = Parts(bench, item_col, item_text, window, part_words)

    def scan(held: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[tuple] = []
                texts = as_bytes(b.column(1))
                for k, text, (n, ranges, found) in zip(b.column(0).to_pylist(), texts, held.value.scan(texts), strict=True):
                    out.append((k, n, sum(y - x for x, y in ranges), held.value.named(found), ranges, word_spans(text.decode(), ranges) if ranges else []))
                if out:
                    yield _arrow(*map(list, zip(*out, strict=True)))

        return run

    if parts.n == 1:
        return docs.mapInArrow(scan(parts.held(0)), SCHEMA)
    row = F.sha2(F.concat_ws("\x00", F.coalesce(F.col("id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))), 256)
    return _in_blocks(docs.withColumn("row", row), parts).drop("row")


def _in_blocks(rows: DataFrame, parts: Parts) -> DataFrame:
    """Rows (id, text, row) against part after part; each part's hits are a table, joined to the rows by row at the end."""
    found = None
    schema = pa.schema([("row", pa.string()), ("items", pa.list_(pa.string())), ("hit_words", _ARROW_SPANS)])

    def scan(held: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[list] = [[], [], []]
                for k, (_, ranges, own) in zip(b.column(0).to_pylist(), held.value.scan(as_bytes(b.column(1))), strict=True):
                    if ranges:
                        for to, x in zip(out, (k, held.value.named(own), [{"start": x, "end": y} for x, y in ranges]), strict=True):
                            to.append(x)
                yield batch(schema, out)

        return run

    for part in range(parts.n):
        held = parts.held(part)
        own = saved(rows.select("row", "text").mapInArrow(scan(held), "row string, items array<string>, hit_words array<struct<start:int,end:int>>").distinct(), "hits")
        held.destroy()
        found = own if found is None else found.union(own)
    hits = found.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("hit_words")).alias("at"))  # a row for each part at most

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, text, items, at in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                own, ranges = words(text), []
                for x, y in sorted((x["start"], x["end"]) for x in at or []):
                    if ranges and ranges[-1][1] >= x:
                        ranges[-1] = (ranges[-1][0], max(ranges[-1][1], y))
                    else:
                        ranges.append((x, y))
                out.append((k, len(own), sum(y - x for x, y in ranges), sorted(items or []), ranges, word_spans(text.decode(), ranges) if ranges else []))
            if out:
                own = _arrow(*map(list, zip(*out, strict=True)))
                yield pa.RecordBatch.from_arrays([*own.columns, b.column(4)], names=[*own.schema.names, "row"])

    return rows.join(hits, "row", "left").select("id", "text", "items", "at", "row").mapInArrow(mark, SCHEMA + ", row string")


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit"):
    """At least a twentieth of the words are hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def clean(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """The rows that aren't contaminated, with all their columns; null and empty texts are clean, repeated rows stay.

    Of several rows with one id each is judged by its own text. An empty table gives none; an empty benchmark keeps all.
    """
    parts = Parts(bench, item_col, item_text, window, part_words)
    if parts.n > 1:
        # by the text's digest: equal texts are equally clean, whatever their ids
        text = F.col(f"`{text_col}`").cast("string")
        own = docs.select(F.lit(None).cast("long").alias("id"), text.alias("text"), F.sha2(text, 256).alias("row")).where("row is not null").distinct()
        dirty = _in_blocks(own, parts).where(contaminated()).select(F.col("row").alias("_dirty")).distinct()
        return docs.join(dirty, F.sha2(text, 256) == F.col("_dirty"), "left_anti")
    held = parts.held(0)

    @F.arrow_udf("boolean")
    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for own in texts:
            hit = ((n, sum(b - a for a, b in ranges)) for n, ranges, _ in held.value.scan(as_bytes(own)))
            yield pa.array([h == 0 or 20 * h < n for n, h in hit], pa.bool_())

    return docs.where(judge(F.col(f"`{text_col}`")))
