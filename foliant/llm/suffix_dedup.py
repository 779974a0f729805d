"""Removal of repeated byte strings by column-wise construction of a collection's Burrows-Wheeler transform.

Equal windows have equal anchors (the k-gram of the smallest hash), so only texts' stretches around anchors that occur
twice can repeat. Anchors are dealt with the digests of their stretches: of equal stretches all but the earliest are
marked there, and only where an anchor has different ones is the earliest of each cut out, dealt by anchor and compared.
Of these the transform and common prefixes are built column by column (see bwt.py); suffixes between which no common
prefix falls under the window's length begin with one window, of which all but the earliest occurrence are marked. The
marks go back to the documents.

So a copy costs a digest and a mark, not its bytes, however many there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bwt
from .anchors import GRAM, anchors
from .common import as_bytes, batch, fragments, spread

_U = np.uint64

WINDOW = 100
FLUSH, SYMBOLS = 1 << 19, 1 << 18  # anchors held, symbols of a transform (but for one anchor)
BUCKETS, AT_ONCE = 8, 500  # buckets of anchors for each fragment, texts taken at once
_NONE = -(1 << 63)  # stands for a null id: before all others
#: Of anchors: low bytes of the hash, the stretch's digest, its start, its windows less one, the anchor's place in it.
_ANCHOR = (("token", 6), ("digest", 8), ("start", 4), ("more", 1), ("at", 1))
_WIDTH = sum(n for _, n in _ANCHOR)
_SENT = pa.schema([("fragment", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()), ("anchors", pa.binary())])
_SENT_SQL = "fragment int, rows binary, ids binary, counts binary, anchors binary"
_COPY = np.dtype([("start", "<u4"), ("more", "u1")])
_WANTED = np.dtype([("token", "<u8"), ("start", "<u4"), ("more", "u1"), ("at", "u1")])
_STRETCH = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("seg", pa.binary()), ("at", pa.int32()), ("id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("marks", pa.binary())])
_STRETCH_SQL = "bucket int, key long, seg binary, at int, id long, row long, start long, marks binary"
_MARKS = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("marks", pa.binary())])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few texts at a time, so that few are held twice."""
    for b in batches:
        for at in range(0, b.num_rows, AT_ONCE):
            yield b.slice(at, AT_ONCE)


def _found(n: int, window: int):
    """Anchors of all texts, to their fragments, with the row, its id and the stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in _slices(batches):
            for k, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), strict=True):
                place, own, first, last = anchors(text, window)
                if len(place):
                    digests = [xxhash.xxh3_64_intdigest(text[a:e]) for a, e in zip(first.tolist(), (last + window).tolist(), strict=True)]
                    held.append((row, _NONE if k is None else k, own, np.array(digests, _U), first.astype(np.uint32), (last - first).astype(np.uint8), (place - first).astype(np.uint8)))
                    size += len(place)
                if size >= FLUSH:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)

    def send(held: list[tuple]) -> pa.RecordBatch:
        rows, ids = (np.array([x[i] for x in held], np.int64) for i in (0, 1))
        tokens, digests, starts, more, places = (np.concatenate([x[i] for x in held]) for i in range(2, 7))
        owner = np.repeat(np.arange(len(held)), [len(x[2]) for x in held])
        # by low bits: an anchor is the smallest of many hashes, so most begin with zeros
        fragment = ((tokens & _U(0xFFFFFFFF)) * _U(n) >> _U(32)).astype(np.int32)
        order = np.argsort(fragment, kind="stable")
        fragment, owner = fragment[order], owner[order]
        fields = [x[order] for x in (tokens, digests, starts, more, places)]
        cuts = np.flatnonzero(np.concatenate(([True], fragment[1:] != fragment[:-1]))).tolist()
        out: list[list] = [[] for _ in _SENT]
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            new = np.flatnonzero(np.concatenate(([True], owner[a + 1 : b] != owner[a : b - 1])))
            who = owner[a:b][new]
            own = [x[a:b] for x in fields]
            steps = np.diff(own[2], prepend=np.uint32(0))  # small numbers, of which a byte each is set by side, compress well
            steps[new] = own[2][new]
            own[2] = steps
            planes = [np.ascontiguousarray(x).view(np.uint8).reshape(b - a, -1)[:, :width].T.tobytes() for x, (_, width) in zip(own, _ANCHOR, strict=True)]
            for to, x in zip(out, (int(fragment[a]), rows[who].tobytes(), ids[who].tobytes(), np.diff(new, append=b - a).astype(np.uint32).tobytes(), b"".join(planes)), strict=True):
                to.append(x)
        return batch(_SENT, out)

    return run


def _field(raw: bytes, name: str) -> np.ndarray:
    """A field of packed anchors."""
    m, names = len(raw) // _WIDTH, [x for x, _ in _ANCHOR]
    width = dict(_ANCHOR)[name]
    before = sum(w for _, w in _ANCHOR[: names.index(name)])
    own = np.frombuffer(raw, np.uint8, m * width, m * before).reshape(width, m).T
    if width == 1:
        return own.ravel()
    out = np.zeros((m, 8 if width > 4 else 4), np.uint8)
    out[:, :width] = own
    return out.view(_U if width > 4 else np.uint32).ravel()


def _strings(x: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary values of so many items each."""
    ends = np.concatenate(([0], np.cumsum(counts) * x.dtype.itemsize))
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(x.tobytes())]).cast(pa.binary())


def _repeated(t: pa.Table) -> pa.Table:
    """Of a fragment: by row, stretches of which an equal one comes earlier, and the earliest ones of anchors with different ones."""
    raws = t.column("anchors").to_pylist()
    tokens = np.concatenate([_field(raw, "token") for raw in raws])
    order = np.argsort(tokens)
    same = tokens[order][1:] == tokens[order][:-1]
    again = np.zeros(len(tokens), bool)
    again[order] = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    tokens, parts, at = tokens[again], [], 0
    del order, same
    for raw, rows, ids, counts in zip(raws, *(t.column(c).to_pylist() for c in ("rows", "ids", "counts")), strict=True):
        m = len(raw) // _WIDTH
        kept, counts = again[at : at + m], np.frombuffer(counts, np.uint32)
        at += m
        start = np.cumsum(_field(raw, "start"), dtype=np.int64)
        start -= np.repeat(np.concatenate(([0], start[np.cumsum(counts)[:-1] - 1])), counts)
        parts.append([np.repeat(np.frombuffer(x, np.int64), counts)[kept] for x in (rows, ids)] + [start[kept]] + [_field(raw, c)[kept] for c in ("digest", "more", "at")])
    rows, ids, start, digest, more, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((start, ids, digest, tokens))
    tokens, rows, ids, start, digest, more, place = (x[order] for x in (tokens, rows, ids, start, digest, more, place))
    anchor = np.concatenate(([True], tokens[1:] != tokens[:-1]))[: len(tokens)]
    head = anchor | np.concatenate(([True], digest[1:] != digest[:-1]))[: len(tokens)]
    lead = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
    late = ~head & ((ids != ids[lead]) | (start != start[lead]))
    which = np.cumsum(anchor) - 1
    want = head & (np.bincount(which[head], minlength=1)[which] > 1)
    order = np.lexsort((start, ids, rows))
    order = order[(late | want)[order]]
    tokens, rows, ids, start, more, place, late, want = (x[order] for x in (tokens, rows, ids, start, more, place, late, want))
    new = np.concatenate(([True], (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])))[: len(rows)]
    group, n = np.cumsum(new) - 1, int(new.sum())

    def packed(kind: np.dtype, own: np.ndarray) -> pa.Array:
        out = np.zeros(int(own.sum()), kind)
        for name, x in (("token", tokens), ("start", start), ("more", more), ("at", place)):
            if name in kind.names:
                out[name] = x[own]
        return _strings(out, np.bincount(group[own], minlength=n))

    return pa.table([pa.array(rows[new], pa.int64()), pa.array(ids[new], pa.int64()), packed(_COPY, late), packed(_WANTED, want)], names=["mark_row", "mark_id", "copies", "wanted"])


class _Marks:
    """Byte ranges to remove, by row and id: the digests of rows of different ids may clash."""

    def __init__(self) -> None:
        self.own: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def add(self, row: int, k: int, start: int, end: int) -> None:
        own = self.own.setdefault((row, k), [])
        if own and own[-1][1] == start or own and own[-1][0] <= start <= own[-1][1]:
            own[-1] = own[-1][0], max(end, own[-1][1])
        else:
            own.append((start, end))

    def table(self) -> list[tuple[int, int, bytes]]:
        return [(row, k, np.array(own, np.int64).tobytes()) for (row, k), own in self.own.items()]


def _stretches(buckets: int, window: int):
    """Texts with what was found of them to the stretches wanted, and marks for copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            cut, done = [], []
            for k, row, text, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3).to_pylist(), strict=True):
                k = _NONE if k is None else k
                found = [x for x in found or () if x["mark_id"] == k]
                wanted = np.frombuffer(b"".join(x["wanted"] for x in found), _WANTED)
                for token, a, more, at in wanted.tolist():
                    cut.append((token, text[a : a + more + window], at, k, row, a))
                copies = np.frombuffer(b"".join(x["copies"] for x in found), _COPY)
                if len(copies):
                    a = copies["start"].astype(np.int64)
                    runs = removed_runs([np.stack((a, a + copies["more"] + window), axis=1).tobytes()])
                    done.append((row, k, np.array(runs, np.int64).tobytes()))
            for at in range(0, len(cut), 5_000):
                part = cut[at : at + 5_000]
                keys = np.array([x[0] for x in part], _U)
                bucket = ((keys >> _U(16)) * _U(buckets) >> _U(32)).astype(np.int32)
                yield batch(_STRETCH, [bucket.tolist(), keys.view(np.int64).tolist(), *([x[i] for x in part] for i in range(1, 6)), [None] * len(part)])
            if done:
                none = [None] * len(done)
                yield batch(_STRETCH, [[x[0] % buckets for x in done], none, none, none, [x[1] for x in done], [x[0] for x in done], none, [x[2] for x in done]])

    return run


def _may_repeat(group: list[tuple], window: int, gram: int = GRAM, parts: int = 4) -> list[tuple]:
    """An anchor's stretches (seg, at, ...) that share enough bytes around it to share a window.

    A window's bytes beside the anchor are cut in parts; wherever the anchor lies in it, all but one part's worth of them
    are whole parts to its left and right. Stretches without company in any of these divisions share no window.
    """
    step = (window - gram) // parts
    needs = [(step * j, window - gram - step * (j + 1)) for j in range(parts)]
    if (window - gram) % parts:
        needs = [(left, step * (parts - 1 - j)) for j, (left, _) in enumerate(needs)] + [(step * parts, 0)]
    seen: dict[tuple, int] = {}
    keys = []
    for seg, at, *_ in group:
        after = at + gram
        own = [(j, seg[at - a : at], seg[after : after + b]) for j, (a, b) in enumerate(needs) if at >= a and len(seg) - after >= b]
        for k in own:
            seen[k] = seen.get(k, 0) + 1
        keys.append(own)
    return [x for x, own in zip(group, keys, strict=True) if any(seen[k] > 1 for k in own)]


def _mark_windows(strings: list[tuple], window: int, marks: _Marks) -> None:
    """strings: (seg, at, id, row, start), all different. Marks windows of which an equal one comes earlier."""
    if len(strings) < 2:
        return
    _, lcp, places = bwt.build([x[0] for x in strings])
    group = np.cumsum(lcp < window)
    counts = [len(x[0]) - window + 1 for x in strings]
    which = np.repeat(np.arange(len(strings)), counts)
    offset = np.concatenate([np.arange(n) for n in counts])
    kind = group[np.concatenate([p[:n] for p, n in zip(places, counts, strict=True)])]
    ids, starts = np.array([x[2] for x in strings], np.int64)[which], np.array([x[4] for x in strings], np.int64)[which] + offset
    order = np.lexsort((starts, ids, kind))
    kind, which, ids, starts = kind[order], which[order], ids[order], starts[order]
    head = np.concatenate(([True], kind[1:] != kind[:-1]))
    lead = np.maximum.accumulate(np.where(head, np.arange(len(kind)), 0))
    late = ~head & ((ids != ids[lead]) | (starts != starts[lead]))
    w, s = which[late], starts[late]
    o = np.lexsort((s, w))
    for i, a in zip(w[o].tolist(), s[o].tolist(), strict=True):
        marks.add(strings[i][3], strings[i][2], a, a + window)


def _marked(window: int, symbols: int):
    """Of a bucket of anchors: marks of repeated windows, and those that came along."""

    def run(t: pa.Table) -> pa.Table:
        marks, best, out = _Marks(), {}, []
        for part in t.to_batches(max_chunksize=5_000):
            _, key, seg, at, k, row, start, along = (c.to_pylist() for c in part.columns)
            for a, s, p, i, r, b, m in zip(key, seg, at, k, row, start, along, strict=True):
                if m is not None:
                    out.append((r, i, m))
                    continue
                had = best.get(s)
                if had is None:
                    best[s] = (a, p, i, r, b)
                elif (i, b) < (had[2], had[4]):
                    marks.add(had[3], had[2], had[4], had[4] + len(s))
                    best[s] = (a, p, i, r, b)
                elif (i, b) > (had[2], had[4]):
                    marks.add(r, i, b, b + len(s))
        del t
        groups: dict[int, list[tuple]] = {}
        for s, (a, *rest) in best.items():
            groups.setdefault(a, []).append((s, *rest))
        held: list[tuple] = []
        size = 0
        for own in groups.values():
            own = _may_repeat(own, window) if len(own) > 1 else []
            held += own
            size += sum(len(x[0]) + 1 for x in own)
            if size >= symbols:
                _mark_windows(held, window, marks)
                held, size = [], 0
        _mark_windows(held, window, marks)
        out += marks.table()
        return pa.table([pa.array([x[j] for x in out], f.type) for j, f in enumerate(_MARKS)], schema=_MARKS)

    return run


def removed_runs(marks: list[bytes] | None) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes."""
    if not marks:
        return []
    own = np.concatenate([np.frombuffer(m, np.int64) for m in marks]).reshape(-1, 2)
    own = own[np.argsort(own[:, 0], kind="stable")]
    end = np.maximum.accumulate(own[:, 1])
    new = np.concatenate(([True], own[1:, 0] > end[:-1]))
    return list(zip(own[new, 0].tolist(), end[np.append(np.flatnonzero(new)[1:] - 1, len(own) - 1)].tolist(), strict=True))


def repeated_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_kept: bool = False, symbols: int = SYMBOLS) -> DataFrame:
    """Per row: id, n_bytes, the maximal runs of removed bytes, kept_sha256 and, with_kept, the bytes that stay.

    Null counts as empty; texts shorter than the window lose nothing across rows. A null id comes before all others.
    Of rows with equal ids the start alone decides; rows equal in id and text are one, and both keep what it keeps.
    The window is longer than an anchor's k-gram and at most 127 bytes (a stretch then has at most 254). Stretches are told
    apart by their anchor's 48 bits and 64 bits of their own.
    """
    if not GRAM < window <= 127:
        raise ValueError(f"a window of {window} bytes")
    n = min(65_535, fragments(docs.sparkSession))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = spread(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"))).select("id", F.xxhash64("id", "text").alias("row"), "text")
    found = rows.mapInArrow(_found(n, window), _SENT_SQL).groupBy("fragment").applyInArrow(_repeated, "mark_row long, mark_id long, copies binary, wanted binary")
    found = found.groupBy("mark_row").agg(F.collect_list(F.struct("mark_id", "copies", "wanted")).alias("found"))  # of one row: no more than it has anchors
    # the texts are dealt by row once; both joins use that exchange
    held = rows.join(found, rows.row == found.mark_row, "left").select("id", "row", "text", "found")
    stretches = held.mapInArrow(_stretches(BUCKETS * n, window), _STRETCH_SQL)
    marks = stretches.groupBy("bucket").applyInArrow(_marked(window, symbols), "row long, id long, marks binary")
    marks = marks.groupBy(F.col("row").alias("mark_row")).agg(F.collect_list(F.struct("id", "marks")).alias("found"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(span)), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * with_kept)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            out: list[list] = [[] for _ in schema]
            for k, text, own in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                runs, last, parts = removed_runs(own), 0, []
                for x, y in runs:
                    parts.append(text[last:x])
                    last = y
                kept = b"".join([*parts, text[last:]])
                for to, x in zip(out, (k, len(text), [{"start": x, "end": y} for x, y in runs], hashlib.sha256(kept).hexdigest(), kept), strict=False):
                    to.append(x)
            yield batch(schema, out)

    # joined by row, for which the texts are dealt already; ids settle clashes of its 64 bits
    own = F.transform(F.filter("found", lambda x: x["id"] == F.coalesce("id", F.lit(_NONE))), lambda x: x["marks"])
    final = rows.join(marks, rows.row == marks.mark_row, "left").withColumn("marks", own).select("id", "text", "marks")
    return final.mapInArrow(remove, "id long, n_bytes long, removed array<struct<start:long,end:long>>, kept_sha256 string" + ", kept binary" * with_kept)
