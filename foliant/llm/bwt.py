"""Burrows-Wheeler transform and common prefixes of many strings, built column by column.

Round after round one symbol of every string is put before the suffix it had: the symbol enters the transform at that
suffix's place, the longer suffix enters the list at the place that the transform's counts give, and its common prefix
with its neighbours is one more than the smallest between the two suffixes it came from. Strings start in the round that
lets all end together. The transform and the prefixes are columns that a round reads from front to back and writes anew:
in memory while they are small, else in external files. Only a place for each string is kept beside them.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

END = 0xFF  # no byte of UTF-8
BLOCK, IN_MEMORY = 1 << 20, 1 << 24


class Columns:
    """The transform and the common prefixes, written and read in blocks."""

    def __init__(self, size: int, folder: str | None, block: int) -> None:
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []
        self.path = os.path.join(folder, f"columns-{os.urandom(4).hex()}") if folder else None
        self.to = open(self.path, "wb") if self.path else None
        self.size, self.block, self.lengths = size, block, []

    def write(self, bwt: np.ndarray, lcp: np.ndarray) -> None:
        for at in range(0, len(bwt), self.block):
            b, p = bwt[at : at + self.block], lcp[at : at + self.block]
            if self.to:
                b.tofile(self.to)
                p.tofile(self.to)
                self.lengths.append(len(b))
            else:
                self.blocks.append((b, p))

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not self.path:
            yield from self.blocks
            return
        self.to.flush()
        with open(self.path, "rb") as f:
            for n in self.lengths:
                yield np.fromfile(f, np.uint8, n), np.fromfile(f, np.uint8, n)

    def drop(self) -> None:
        self.blocks = []
        if self.to:
            self.to.close()
            os.unlink(self.path)


def _round(old: Columns, places: np.ndarray, symbols: np.ndarray, after: np.ndarray, totals: np.ndarray, folder: str | None) -> tuple[Columns, np.ndarray]:
    """places: of each running string's suffix, ascending; symbols: what comes before it; after: what comes before that.

    totals: how often each symbol is in the transform, these included. Returns the new columns and, string by string,
    the place of the new suffix.
    """
    first = np.concatenate(([0], np.cumsum(totals)[:-1]))  # where the suffixes of each symbol begin
    seen = np.zeros(256, np.int64)
    gap = np.full(256, 255, np.int64)  # smallest common prefix since a symbol was last seen
    last_new = np.zeros(256, bool)  # whether what was seen last is new
    to, prefix = np.empty(len(places), np.int64), np.empty(len(places), np.int64)
    fixed_at, fixed = [], []
    start, done = 0, 0
    for bwt, lcp in old:
        n = len(bwt)
        upto = int(np.searchsorted(places, start + n))
        own = places[done:upto] - start
        if len(own):
            bwt = bwt.copy()
            bwt[own] = symbols[done:upto]
        new = np.zeros(n, bool)
        new[own] = True
        order = np.argsort(bwt, kind="stable")
        count = np.bincount(bwt, minlength=256)
        count[END] = 0
        order = order[: count.sum()]  # without string ends
        begin = np.concatenate(([0], np.cumsum(count)[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(len(order))
        wanted = lambda at: first[bwt[at]] + seen[bwt[at]] + rank[at] - begin[bwt[at]]
        k = rank[own]
        to[done:upto] = wanted(own)
        # pairs of neighbours under one symbol of which one is new: the new one as the later, and as the earlier
        heads = begin[bwt[own]]
        later = k[k > heads]
        sure = np.zeros(len(own), np.int64)
        pairs = np.stack([order[later - 1] + 1, order[later] + 1], axis=1)
        padded = np.append(lcp, np.uint8(255))
        if len(later):
            sure[k > heads] = np.minimum.reduceat(padded, pairs.ravel())[::2].astype(np.int64) + 1
        head = np.flatnonzero(k == heads)
        if len(head):
            x, at = bwt[own[head]], own[head]
            low = np.minimum.accumulate(lcp)[at].astype(np.int64)
            sure[head] = np.where(seen[x] > 0, np.minimum(gap[x], low) + 1, 0)
        prefix[done:upto] = sure
        nxt = k[(k + 1 < begin[bwt[own]] + count[bwt[own]])] + 1
        nxt = nxt[~new[order[nxt]]] if len(nxt) else nxt
        if len(nxt):
            pairs = np.stack([order[nxt - 1] + 1, order[nxt] + 1], axis=1)
            fixed.append(np.minimum.reduceat(padded, pairs.ravel())[::2].astype(np.int64) + 1)
            fixed_at.append(wanted(order[nxt]))
        here = np.flatnonzero(count)
        if start:  # the first of a symbol in this block, when the last before it was new
            x = here[last_new[here]]
            at = order[begin[x]]
            keep = ~new[at]
            if keep.any():
                x, at = x[keep], at[keep]
                fixed.append(np.minimum(gap[x], np.minimum.accumulate(lcp)[at].astype(np.int64)) + 1)
                fixed_at.append(wanted(at))
        tail = order[begin[here] + count[here] - 1]
        from_right = np.minimum.accumulate(padded[::-1])[::-1]
        gap = np.minimum(gap, int(lcp.min()) if n else 255)
        gap[here] = from_right[tail + 1]
        last_new[here] = new[tail]
        seen += count
        start += n
        done = upto
    # the new suffixes enter between the old ones
    order = np.argsort(to, kind="stable")
    at, symbol, common = to[order], after[order], prefix[order]
    over_at, over = (np.concatenate(fixed_at), np.concatenate(fixed)) if fixed else (np.empty(0, np.int64), np.empty(0, np.int64))
    o = np.argsort(over_at, kind="stable")
    over_at, over = over_at[o], over[o]
    before = at - np.arange(len(at))  # old suffixes in front of each
    out = Columns(old.size + len(at), folder, old.block)
    start, new_start, done, total = 0, 0, 0, old.size
    for bwt, lcp in old:
        n = len(bwt)
        a, b = np.searchsorted(places, [start, start + n])
        if b > a:
            bwt = bwt.copy()
            bwt[places[a:b] - start] = symbols[a:b]
        upto = len(at) if start + n == total else int(np.searchsorted(before, start + n))
        spots = at[done:upto] - new_start
        bigger = np.empty(n + len(spots), np.uint8)
        keep = np.ones(len(bigger), bool)
        keep[spots] = False
        bigger[keep] = bwt
        bigger[spots] = symbol[done:upto]
        prefixes = np.empty(len(bigger), np.uint8)
        prefixes[keep] = lcp
        prefixes[spots] = np.minimum(common[done:upto], 255)
        a, b = np.searchsorted(over_at, [new_start, new_start + len(bigger)])
        prefixes[over_at[a:b] - new_start] = np.minimum(over[a:b], 255)
        out.write(bigger, prefixes)
        start, new_start, done = start + n, new_start + len(bigger), upto
    return out, to


def build(strings: list[bytes], block: int = BLOCK, in_memory: int = IN_MEMORY) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Transform, common prefixes (at most 255) and, by string, the places of its suffixes: of the whole string first.

    Strings are without the byte END and at most 254 symbols long (of longer ones prefixes are cut short). The list holds all suffixes,
    the empty ones last.
    """
    m = len(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    longest, total = int(sizes.max(initial=0)), int(sizes.sum()) + m
    letters = np.full((m, longest + 1), END, np.uint8)  # right-aligned, an end in front
    flat = np.frombuffer(b"".join(strings), np.uint8)
    rows = np.repeat(np.arange(m), sizes)
    letters[rows, longest + 1 - np.repeat(sizes, sizes) + np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    with tempfile.TemporaryDirectory() if total > in_memory else _no_folder() as folder:
        columns = Columns(m, folder, block)
        columns.write(np.full(m, END, np.uint8), np.zeros(m, np.uint8))
        totals, places, running = np.zeros(256, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        for j in range(1, longest + 1):
            fresh = np.flatnonzero(sizes == longest - j + 1)
            running, places = np.concatenate([running, fresh]), np.concatenate([places, columns.size - m + fresh])
            order = np.argsort(places, kind="stable")
            running, places = running[order], places[order]
            done = sizes[running] - (longest - j)  # the symbols of each string that are in after this round
            symbols = letters[running, longest + 1 - done]
            totals += np.bincount(symbols, minlength=256)
            grown, to = _round(columns, places, symbols, letters[running, longest - done], totals, folder)
            columns.drop()
            columns, places = grown, to
        found = list(columns)
        columns.drop()
    bwt = np.concatenate([b for b, _ in found]) if found else np.empty(0, np.uint8)
    lcp = np.concatenate([p for _, p in found]) if found else np.empty(0, np.uint8)
    # from the empty suffixes back through the transform
    order = np.argsort(bwt, kind="stable")
    step = np.empty(len(bwt), np.int64)
    step[order] = np.arange(len(order))
    at, steps = len(bwt) - m + np.arange(m), []
    for _ in range(longest):
        at = np.where(bwt[at] != END, step[at], -1)
        steps.append(at.copy())
        at = np.maximum(at, 0)
        at = np.where(steps[-1] < 0, len(bwt) - m, at)
        at = np.where(steps[-1] < 0, _stuck(bwt, at), at)
    table = np.stack(steps) if steps else np.empty((0, m), np.int64)
    return bwt, lcp, [table[: sizes[i], i][::-1] for i in range(m)]


def _stuck(bwt: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A place with an end before it, at which finished strings stay."""
    return np.full(len(at), int(np.argmax(bwt == END)))


class _no_folder:
    def __enter__(self) -> None:
        return None

    def __exit__(self, *_: object) -> None:
        return None
