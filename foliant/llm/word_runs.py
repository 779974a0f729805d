"""Periodic runs of words, by the runs theorem.

Every run has a root that is a longest Lyndon word under an order of the words or under its reverse. Longest Lyndon words
end at the next smaller suffix, so a suffix array's inverse gives those of both orders: next smaller values for the one,
next larger values for the other. Each root is extended by longest common extensions, which are range minima over common
prefixes (a sparse table), to the right over the words and to the left over the words reversed.

All of a block of documents is worked out at once, in arrays; suffixes are sorted by document first, so that nothing meets
across documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, spread, text_of

LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of a block; a longer document is a block of its own. A block takes some 200 bytes a word.
BLOCK_WORDS = 1 << 18
#: Jumps after which next values are looked for document by document.
JUMPS = 64


class Suffixes:
    """Suffix order of a block: sa, its inverse, lcp (of each suffix with the one before), and classes of equal beginnings
    by their length in words (1, 2, 4, ...), as far as suffixes of a document share them."""

    def __init__(self, codes: np.ndarray, doc: np.ndarray, end: np.ndarray) -> None:
        n, top = len(codes), int(codes.max()) + 2
        if (int(doc[-1]) + 1) * top * top >= 1 << 63:
            raise ValueError("too many words in a block")
        first = doc * top + codes
        follows = np.zeros(n, np.int64)
        follows[:-1] = codes[1:] + 1
        follows[end - 1] = 0
        key = first * top + follows
        self.sa = sa = np.argsort(key, kind="stable")
        ordered = key[sa]
        new = np.ones(n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        self.lcp = lcp = np.zeros(n, np.int32)
        lcp[1:] = first[sa[1:]] == first[sa[:-1]]
        lcp[~new] = 0
        rank = np.empty(n + 1, np.int64)
        rank[n] = -1
        rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.classes = {1: np.append(first, -1), 2: rank.astype(np.int32)}
        size, open_ = 2, _shared(new)
        while len(open_):
            s = sa[open_]
            beyond = s + size
            second = np.where(beyond < end[s], rank[np.minimum(beyond, n)] + 1, 0)
            head = rank[s]
            key = head * (n + 2) + second
            order = np.argsort(key, kind="stable")
            s, key = s[order], key[order]
            sa[open_] = s
            apart = np.ones(len(s), bool)
            apart[1:] = key[1:] != key[:-1]
            inner = np.flatnonzero(apart[1:] & (head[1:] == head[:-1])) + 1
            lcp[open_[inner]] = size + self._shared_words(s[inner - 1] + size, s[inner] + size, size)
            rank[s] = np.maximum.accumulate(np.where(apart, open_, 0))
            size *= 2
            self.classes[size] = rank.astype(np.int32)
            open_ = open_[_shared(apart)]
        self.isa = rank[:n]

    def _shared_words(self, i: np.ndarray, j: np.ndarray, below: int) -> np.ndarray:
        """Words that suffixes share, fewer than `below`, from the classes."""
        n, found = len(self.sa), np.zeros(len(i), np.int32)
        for size in sorted((k for k in self.classes if k < below), reverse=True):
            own = self.classes[size]
            found += size * (own[np.minimum(i + found, n)] == own[np.minimum(j + found, n)])
        return found


def _shared(new: np.ndarray) -> np.ndarray:
    """Places in groups of two or more, given where groups begin."""
    lone = new.copy()
    lone[:-1] &= new[1:]
    return np.flatnonzero(~lone)


def next_smaller(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each place of distinct values the next with a smaller one, else the length.

    Pointers jump to the pointer of the place they are at; what is open after JUMPS rounds is done by a stack, one
    document after another (starts: where they begin).
    """
    n = len(values)
    padded, to = np.append(values, values.min() - 1), np.minimum(np.arange(1, n + 2), n)
    open_ = np.flatnonzero(padded[to[:n]] > values)
    for _ in range(JUMPS):
        if not len(open_):
            return to[:n]
        jumped = to[to[open_]]
        to[open_] = jumped
        open_ = open_[padded[jumped] > values[open_]]
    for d in np.unique(np.searchsorted(starts, open_, "right") - 1):
        a, b = int(starts[d]), int(starts[d + 1]) if d + 1 < len(starts) else n
        own, stack, found = values[a:b].tolist(), [], [n] * (b - a)
        for i in range(b - a - 1, -1, -1):
            while stack and own[stack[-1]] > own[i]:
                stack.pop()
            found[i] = a + stack[-1] if stack else n
            stack.append(i)
        to[a:b] = found
    return to[:n]


class Extensions:
    """Longest common extensions of places, from a sparse table of minima over common prefixes."""

    def __init__(self, isa: np.ndarray, lcp: np.ndarray) -> None:
        self.isa, n = isa, len(lcp)
        self.minima = [lcp]
        while 2 << len(self.minima) - 1 <= n:
            last, half = self.minima[-1], 1 << len(self.minima) - 1
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.isa[i], self.isa[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1  # the greatest power of two within
        out = np.zeros(len(i), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << int(k)) + 1])
        return out


def runs(codes: np.ndarray, lengths: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (document, start, length, period) of all runs of at least `least` words and `periods` (3 or more) periods, in order.

    codes: the words of documents behind each other, as numbers; lengths: how many words each has, one or more.

    A run of that length holds a root within its first period whose extension to the right is longer than what is left of
    these bounds, so roots that extend less belong to shorter runs or aren't their run's first.
    """
    doc = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    begin, end = (ends - lengths)[doc], ends[doc]
    own = Suffixes(codes, doc, end)
    most = least // periods
    sure = 1 << (min(least - 2 * most, (periods - 2) * (most + 1)) + 1).bit_length() - 1  # all first roots extend that far
    none = np.zeros((0, 4), np.int64)
    if sure not in own.classes:
        return none
    roots = []
    for order in (own.isa, -own.isa):  # the reverse order's inverse suffix array, where the end is the largest
        i, j = np.arange(len(codes)), next_smaller(order, ends - lengths)
        within = (j < end) & (periods * (j - i) <= lengths[doc])
        i, j = i[within], j[within]
        again = own.classes[sure][i] == own.classes[sure][j]
        roots.append(np.stack([i[again], j[again]]))
    i, j = np.concatenate(roots, 1)
    if not len(i):
        return none
    # only documents that hold roots go on
    held = np.zeros(len(lengths), bool)
    held[doc[i]] = True
    mask = held[doc]
    place = np.cumsum(mask) - 1
    right = Extensions(place[own.isa[mask]], own.lcp[mask])
    extended = right(place[i], place[j])
    period = j - i
    enough = extended > np.maximum(least, periods * period) - 2 * period
    i, j, period, extended = i[enough], j[enough], period[enough], extended[enough]
    m = int(mask.sum())
    back_lengths = lengths[held][::-1]
    back = Suffixes(codes[mask][::-1], np.repeat(np.arange(len(back_lengths)), back_lengths), np.repeat(np.cumsum(back_lengths), back_lengths))
    left = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > begin[i])
    left[inner] = Extensions(back.isa, back.lcp)(m - place[i[inner]], m - place[j[inner]])
    start, length = i - left, period + extended + left
    long = length >= np.maximum(least, periods * period)
    # roots of one run give the same start and period
    _, once = np.unique(start[long] * (len(codes) + 1) + period[long], return_index=True)
    at = np.flatnonzero(long)[once]
    return np.stack([doc[i[at]], start[at] - begin[i[at]], length[at], period[at]], 1)


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """Per row: id, n_words, runs (start word, length, period; by start, then period), collapsed text.

    Words are what stands between the six white-space signs of ASCII. A run is a stretch that repeats with its least
    period and can't be made longer with it, of at least `least` words and `periods` (3 or more) periods. Collapsed: the
    words joined by one blank, without those that a run holds behind its first period. Null counts as empty: no words, no
    runs, an empty collapsed text. Repeated rows stay, no rows give none, other columns are ignored. Whole texts, however
    long; a document is one task's.
    """
    if periods < 3 or least < 3 * periods:
        raise ValueError("3 periods or more, of 3 words each")
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])

    def block(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        some = [t for t in texts if t]
        found = np.zeros((0, 4), np.int64)
        if some:
            codes = pa.array([w for t in some for w in t], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
            found = runs(codes, np.fromiter(map(len, some), np.int64, len(some)), least, periods)
        bounds = np.searchsorted(found[:, 0], np.arange(len(some) + 1))
        lists, collapsed, k = [], [], 0
        for words in texts:
            own = found[bounds[k] : bounds[k + 1], 1:] if words else found[:0, 1:]
            k += bool(words)
            lists.append([dict(zip(("start", "length", "period"), x, strict=True)) for x in own.tolist()])
            if len(own):
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, own[:, 0] + own[:, 2], 1)
                np.add.at(cover, own[:, 0] + own[:, 1], -1)
                words = [w for w, c in zip(words, np.cumsum(cover).tolist(), strict=False) if not c]
            collapsed.append(b" ".join(words))
        return batch(schema, [ids, [len(t) for t in texts], pa.array(lists, pa.list_(run)), pa.array(collapsed, pa.binary()).cast(pa.string())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, n = [], [], 0
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = text.as_buffer().to_pybytes().split()
                if texts and n + len(words) > BLOCK_WORDS:
                    yield block(ids, texts)
                    ids, texts, n = [], [], 0
                ids.append(k)
                texts.append(words)
                n += len(words)
        if texts:
            yield block(ids, texts)

    return spread(text_of(docs, id_col, text_col)).mapInArrow(judge, "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
