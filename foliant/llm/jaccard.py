"""N-gram Jaccard join by vertical partitioning, and the components of its links.

Shingles are in a global order, that of their hashes, which is cut into fragments, as many as keep a fragment's tokens
within a bound. Each fragment gets every distinct set's tokens of its range once, counts how many sets hold a token, and
hands shared tokens back; partial counts are summed per set. A set of which too few tokens are shared can't link with
any other and is done. Of the rest, the rarest tokens bring candidate pairs, filtered by sizes and positions; a pair's
overlap is counted in each segment of the order (neighbouring fragments) apart, and summed, exactly.

Pairs within a component that is already known add nothing, so that candidates are met in rounds: first each set with
one central set under the same token, for some rounds, then all pairs still in different components.
Equal sets are one set from the start, told apart by 64 bits of a digest of their tokens: of N different sets about
N squared over 2^65 pairs would be taken for equal (one in 4,000 runs over 1e8 documents).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, fragments, saved, spread, text_of
from .components import components
from .shingles import shingle_set

SHINGLE, THRESHOLD = 5, (4, 5)
FLUSH = 1 << 20  # tokens held in memory before rows are handed on
ROUNDS = 2  # in which sets meet one other set under each token, before all pairs still apart do
PARTS = 4  # segments of the global order in which a pair's overlap is counted
FRAGMENT_TOKENS = 4_000_000  # that a fragment holds on average, at most
MOST_FRAGMENTS = 1 << 20
_U = np.uint64
_LOW = _U((1 << 48) - 1)
_TOKEN_BITS = 44  # of a token beside its fragment, which has the 20 above them
_PACKED = "{} int, sigs binary, sizes binary, counts binary, tokens binary"


def _signature(own: np.ndarray) -> int:
    return np.array(xxhash.xxh3_64_intdigest(own.tobytes()), _U).astype(np.int64).item() if len(own) else 0


def _pack(key: str, keys: np.ndarray, tokens: np.ndarray, owner: np.ndarray, sigs: np.ndarray, sizes: np.ndarray, extra: np.ndarray | None = None) -> pa.Table:
    """A row for each key: the owners there, their numbers of tokens, and the tokens in six bytes each."""
    order = np.argsort(keys, kind="stable")
    keys, tokens, owner = keys[order], tokens[order], owner[order]
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
    ends = [*cuts[1:], len(keys)][: len(cuts)]
    rows: list[list] = [[] for _ in range(5 + (extra is not None))]
    for a, b in zip(cuts.tolist(), map(int, ends), strict=True):
        own = owner[a:b]
        new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        who = own[new]
        row = [int(keys[a]), sigs[who].tobytes(), sizes[who].astype(np.uint32).tobytes(), np.diff(new, append=b - a).astype(np.uint32).tobytes(), tokens[a:b].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()]
        for to, x in zip(rows, row + ([extra[order][a:b].tobytes()] if extra is not None else []), strict=True):
            to.append(x)
    names = [key, "sigs", "sizes", "counts", "tokens"] + ["freqs"] * (extra is not None)
    return pa.table([pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])], names=names)


def _unpack(t: pa.Table) -> tuple[np.ndarray, ...]:
    """Tokens with their owners' signatures and sizes."""
    col = lambda name, kind: np.frombuffer(b"".join(t.column(name).to_pylist()), kind)
    raw = col("tokens", np.uint8).reshape(-1, 6)
    tokens = np.zeros((len(raw), 8), np.uint8)
    tokens[:, :6] = raw
    counts = col("counts", np.uint32)
    return tokens.view(_U).ravel(), np.repeat(col("sigs", np.int64), counts), np.repeat(col("sizes", np.uint32), counts)


def _ranges(n: int, size: int):
    """Texts to rows for each fragment; equal sets of a batch are sent once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets: dict[int, np.ndarray] = {}
            seen: set[int] = set()
            held = 0
            texts = as_bytes(b.column(1))
            for i, text in enumerate(texts):
                own = shingle_set(text, size)
                sig = _signature(own)
                if len(own) and sig not in seen:
                    seen.add(sig)
                    sets[sig] = own
                    held += len(own)
                if sets and (held >= FLUSH or i == len(texts) - 1):
                    yield from send(sets)
                    sets, held = {}, 0
            if sets:
                yield from send(sets)

    def send(sets: dict[int, np.ndarray]) -> list[pa.RecordBatch]:
        tokens = np.concatenate(list(sets.values()))
        sizes = np.array([len(x) for x in sets.values()])
        at = ((tokens >> _U(32)) * _U(n) >> _U(32)).astype(np.uint32)
        return _pack("fragment", at, tokens & _LOW, np.repeat(np.arange(len(sets)), sizes), np.array(list(sets), np.int64), sizes).to_batches()

    return cut


def _shared(blocks: int):
    """Of a fragment: tokens of at least two sets, handed back to the blocks of those sets with how many hold them."""

    def count(key: tuple, t: pa.Table) -> pa.Table:
        tokens, sigs, sizes = _unpack(t)
        order = np.argsort(tokens)
        same = tokens[order][1:] == tokens[order][:-1]
        kept = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(order) else order
        tokens, sigs, sizes = tokens[kept], sigs[kept], sizes[kept]
        order = np.lexsort((sigs, tokens))
        tokens, sigs, sizes = tokens[order], sigs[order], sizes[order]
        new = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (sigs[1:] != sigs[:-1])))[: len(tokens)]
        tokens, sigs, sizes = tokens[new], sigs[new], sizes[new]
        starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))[: len(tokens)])
        many = np.repeat(np.diff(starts, append=len(tokens)), np.diff(starts, append=len(tokens)))
        tokens, sigs, sizes, many = (x[many > 1] for x in (tokens, sigs, sizes, many))
        order = np.argsort(sigs, kind="stable")
        tokens, sigs, sizes, many = (x[order] for x in (tokens, sigs, sizes, many))
        own, first, owner = np.unique(sigs, return_index=True, return_inverse=True)
        out = _pack("block", (own.view(_U) % _U(blocks)).astype(np.uint32)[owner], tokens, owner, own, sizes[first], np.minimum(many, 65535).astype(np.uint16))
        where = key[0].as_py() if hasattr(key[0], "as_py") else key[0]
        return out.append_column("fragment", pa.array([where] * len(out), pa.int32()))

    return count


def _linkable(num: int, den: int):
    """Of a block: sets of which enough tokens are shared, with those tokens in the global order."""

    def keep(t: pa.Table) -> pa.Table:
        tokens, sigs, sizes = _unpack(t)
        many = np.frombuffer(b"".join(t.column("freqs").to_pylist()), np.uint16)
        counts = [len(x) // 2 for x in t.column("freqs").to_pylist()]
        where = np.repeat(np.array(t.column("fragment").to_pylist(), np.uint64), counts)
        full = where << _U(_TOKEN_BITS) | tokens & _U((1 << _TOKEN_BITS) - 1)
        order = np.lexsort((full, many, sigs))
        full, sigs, sizes = full[order], sigs[order], sizes[order].astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], sigs[1:] != sigs[:-1]))[: len(sigs)])
        n = np.diff(starts, append=len(sigs))
        good = n * den >= sizes[starts] * num
        out = [(int(sigs[a]), int(sizes[a]), full[a : a + m].view(np.int64)) for a, m in zip(starts[good], n[good], strict=True)]
        schema = pa.schema([("sig", pa.int64()), ("n", pa.int32()), ("tokens", pa.list_(pa.int64()))])
        return pa.table([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return keep


def overlaps(pairs: DataFrame, sets: DataFrame, n: int, parts: int = PARTS) -> DataFrame:
    """Pairs a, b with the sizes na, nb and the exact overlap: counted in each segment of n fragments' order, then summed."""
    at = lambda x: F.floor(F.shiftrightunsigned(x, _TOKEN_BITS) * parts / n)
    segment = lambda p: F.struct(F.lit(p).alias("part"), F.filter("tokens", lambda x: at(x) == p).alias("own"))
    own = sets.select("sig", F.explode(F.array(*map(segment, range(parts)))).alias("s")).select("sig", "s.*")
    left, right = own.select(F.col("sig").alias("a"), "part", F.col("own").alias("ta")), own.select(F.col("sig").alias("b"), "part", F.col("own").alias("tb"))
    met = pairs.join(left, "a").join(right, ["b", "part"])
    return met.groupBy("a", "b", "na", "nb").agg(F.sum(F.size(F.array_intersect("ta", "tb"))).alias("overlap"))


def _linked(pairs: DataFrame, sets: DataFrame, n: int, num: int, den: int) -> DataFrame:
    ok = den * F.col("overlap") >= num * (F.col("na") + F.col("nb") - F.col("overlap"))
    return overlaps(pairs, sets, n).where(ok).select("a", "b")


def _possible(na: str, pa_: str, nb: str, pb: str, num: int, den: int) -> F.Column:
    """Sizes and positions of the first common token allow the threshold."""
    a, b, i, j = F.col(na), F.col(nb), F.col(pa_), F.col(pb)
    return (den * F.least(a, b) >= num * F.greatest(a, b)) & ((num + den) * F.least(a - i, b - j) >= num * (a + b))


def set_links(sets: DataFrame, fragments_: int, num: int, den: int) -> DataFrame:
    """sets: sig, n, tokens (the shared ones in the global order). Returns node, root of the components of linked sets; None without links."""
    unique = F.col("n") - F.size("tokens")
    prefix = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * num / den) + 1 - unique).cast("int")
    posted = sets.withColumn("u", unique).select("sig", "n", "u", F.posexplode(F.slice("tokens", F.lit(1), prefix))).select(F.col("col").alias("token"), "sig", "n", (F.col("pos") + F.col("u")).cast("int").alias("at"))
    posted = saved(posted, "prefixes")
    member = F.struct("at", "n", "sig", "root")
    own, links, roots, tested = posted.withColumn("root", F.col("sig")), None, None, None
    for _ in range(ROUNDS):
        # under each token the set with the fewest rare tokens before it, and such a set of another component
        first = own.groupBy("token").agg(F.min(member).alias("x"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").drop("low", "high")
        both = own.join(first, "token")
        second = both.where("root <> x.root").groupBy("token").agg(F.min(member).alias("y"))
        met = both.join(second, "token").withColumn("z", F.when(F.col("root") != F.col("x.root"), F.col("x")).otherwise(F.col("y")))
        met = met.select("sig", "n", "at", F.col("z.sig").alias("sig2"), F.col("z.n").alias("n2"), F.col("z.at").alias("at2")).where(_possible("n", "at", "n2", "at2", num, den))
        met = _pairs(met)
        met = saved(met if tested is None else met.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "met")
        found = saved(_linked(met, sets, fragments_, num, den), "links")
        tested = met if tested is None else tested.union(met)
        if not found.head(1):
            break
        links = found if links is None else links.union(found)
        roots = components(links)
        own = posted.join(roots, posted.sig == roots.node, "left").select("token", "sig", "n", "at", F.coalesce("root", "sig").alias("root"))
    # all pairs that are still apart
    mixed = own.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
    own = saved(own.join(mixed, "token", "left_semi"), "mixed")
    other = own.select("token", *(F.col(c).alias(f"{c}2") for c in ("sig", "n", "at", "root")))
    rest = own.join(other, "token").where((F.col("root") != F.col("root2")) & (F.col("sig") < F.col("sig2")) & _possible("n", "at", "n2", "at2", num, den))
    rest = _pairs(rest)
    rest = rest if tested is None else rest.join(tested.select("a", "b"), ["a", "b"], "left_anti")
    found = saved(_linked(rest, sets, fragments_, num, den), "links")
    if found.head(1):
        roots = components(found if links is None else links.union(found))
    return roots


def _pairs(met: DataFrame) -> DataFrame:
    """Distinct pairs, the smaller signature first."""
    less = F.col("sig") < F.col("sig2")
    pick = lambda x, y: F.when(less, F.col(x)).otherwise(F.col(y))
    return met.select(pick("sig", "sig2").alias("a"), pick("n", "n2").alias("na"), pick("sig2", "sig").alias("b"), pick("n2", "n").alias("nb")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable by links of similarity num/den or more).

    Null, empty and blank texts have empty sets and link with nothing; fewer words than a shingle make one shingle;
    rows with equal ids are rows of their own, with the same component where their texts link. A null id stays null
    and never names a component that has another. Texts of any length are taken whole; ties in the order of tokens go by
    hash. Other columns are ignored.
    """
    num, den = threshold
    spark = docs.sparkSession
    rows = spread(text_of(docs, id_col, text_col))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("sig", pa.int64())])
        for b in batches:
            own = [shingle_set(t, size) for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array([_signature(x) for x in own], pa.int64())], schema=schema)

    known = saved(rows.mapInArrow(measure, "id long, n long, sig long"), "sizes")
    tokens = known.agg(F.sum("n")).first()[0] or 0
    n = min(MOST_FRAGMENTS, max(fragments(spark), -(-tokens // FRAGMENT_TOKENS)))
    cut = rows.mapInArrow(_ranges(n, size), _PACKED.format("fragment"))
    shared = cut.groupBy("fragment").applyInArrow(_shared(n), _PACKED.format("block") + ", freqs binary, fragment int")
    sets = saved(shared.groupBy("block").applyInArrow(_linkable(num, den), "sig long, n int, tokens array<long>"), "sets")
    roots = set_links(sets, n, num, den)
    # the smallest id of each set, and of its component: tables by set, so that no document is dealt by its component
    lows = known.where("n > 0").groupBy("sig").agg(F.min("id").alias("first"))
    if roots is not None:
        lows = saved(lows, "lows")
        least = roots.join(lows, roots.node == lows.sig).groupBy("root").agg(F.min("first").alias("least"))
        least = roots.join(saved(least, "least"), "root").select(F.col("node").alias("sig"), "least")
        lows = lows.join(least, "sig", "left").select("sig", F.coalesce("least", "first").alias("first"))
    placed = known.join(saved(lows, "firsts"), "sig", "left")
    return placed.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("id")).alias("component_id"))
