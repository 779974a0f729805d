"""Whitening of embeddings by their leading components, without a covariance matrix.

Block subspace iteration: each pass over the rows gives X'(XQ) of the centred rows for a block Q of a few columns, which is
made orthonormal (QR) and turned to its Ritz vectors, until the residuals of all wanted components certify them. Where
residuals fall too slowly for the gap at the block's end, the block takes in its residuals' directions, up to the whole
dimension, where one pass is exact.

What reaches the driver is a block of (dimension x block width) numbers; rows never do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, saved, spread

SCALE = 256
COMPONENTS = 4
#: Columns of the first block beyond the components.
BEYOND = 12
#: Residual over the gap to the nearest other value, at most; and over the largest value, as much as rounding makes.
CERTAIN, ROUNDING = 1e-13, 2e-14
#: Passes that the present block may still take before it is widened.
PATIENCE = 6
#: Values below this share of the largest are none.
RANK = 1e-12
#: Rows of a product at once.
ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: np.ndarray
    values: np.ndarray
    #: A column for each component; its largest entry is positive.
    vectors: np.ndarray
    trace: float
    identity_error: float
    passes: int


def integers(vectors: Column) -> Column:
    """floor(256 c) of each entry as longs; null for a vector that is null or holds null or non-finite entries."""
    c = lambda x: x.cast("double")
    usable = F.forall(vectors, lambda x: F.coalesce(~F.isnan(c(x)) & (F.abs(c(x)) < float("inf")), F.lit(False)))
    bound = float(1 << 62)
    return F.when(usable, F.transform(vectors, lambda x: F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), c(x) * SCALE)))))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a column of lists, shorter ones filled up with noughts."""
    sizes = column.value_lengths().to_numpy()
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _parts(rows: DataFrame, dim: int, f, width: int) -> np.ndarray:
    """Sum of f(x) over blocks of rows, a (dim x width) matrix: one for each task, summed row by row by Spark."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, width))
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                total += f(matrix(b.column(0).slice(i, ROWS), dim))
        yield pa.RecordBatch.from_pydict({"at": np.arange(dim), "part": list(total)})

    parts = rows.select("x").mapInArrow(own, "at long, part array<double>")
    sums = parts.select("at", F.posexplode("part")).groupBy("at", "pos").agg(F.sum("col").alias("total"))
    rows_ = sums.groupBy("at").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "total"))), lambda x: x["total"]).alias("own")).collect()
    return np.array([r.own for r in sorted(rows_, key=lambda r: r.at)]) if rows_ else np.zeros((dim, width))


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """distinct: the fit list, a row for each x vector, in a table. None where no direction varies (no rows, or equal ones)."""
    found = distinct.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dim")).first()
    n, dim = found.n, found.dim or 0
    if not n or not dim:
        return None
    sums = np.zeros(dim, object)
    for r in distinct.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total")).collect():  # a row for each dimension
        sums[r.pos] = int(r.total)
    mean = np.array([s / n for s in sums])  # of whole numbers, rounded once
    trace = float(_parts(distinct, dim, lambda x: ((x - mean) ** 2).sum(0)[:, None], 1).sum()) / n
    if trace == 0:
        return None
    k = min(components, dim)
    block = np.linalg.qr(np.random.default_rng(0).standard_normal((dim, min(dim, k + BEYOND))))[0]
    passes, last = 0, None
    while True:

        def product(x: np.ndarray, block: np.ndarray = block) -> np.ndarray:
            x = x - mean
            return x.T @ (x @ block)

        image = _parts(distinct, dim, product, block.shape[1]) / n
        passes += 1
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, image = block @ turn, image @ turn
        rest = image - ritz * values
        wanted = [i for i in range(k) if values[i] > RANK * values[0]]
        ratios = []
        for i in wanted:
            gap = np.abs(np.delete(values, i) - values[i]).min() if len(values) > 1 else values[0]
            ratios.append(np.linalg.norm(rest[:, i]) / max(CERTAIN * gap, ROUNDING * values[0]))
        worst = max(ratios)
        if worst <= 1 or block.shape[1] == dim:
            break
        slow = last is not None and (worst >= last or np.log(worst) / np.log(last / worst) > PATIENCE)
        if slow:
            block, last = np.linalg.qr(np.hstack([image, rest])[:, :dim])[0], None
        else:
            block, last = np.linalg.qr(image)[0], worst
    vectors = ritz[:, wanted]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(wanted))])
    values = values[wanted]

    def whitened(x: np.ndarray) -> np.ndarray:
        own = ((x - mean) @ vectors) / np.sqrt(values)
        out = np.zeros((dim, len(wanted) + 1))
        out[: len(wanted), :-1] = own.T @ own
        out[: len(wanted), -1] = own.sum(0)
        return out

    second = _parts(distinct, dim, whitened, len(wanted) + 1)[: len(wanted)] / n
    covariance = second[:, :-1] - np.outer(second[:, -1], second[:, -1])
    return Whitening(n, sums, values, vectors, trace, float(np.abs(covariance - np.eye(len(wanted))).max()), passes)


def whiten(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per usable row and component (from 1): id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries are left out. Components with no variance (equal vectors,
    fewer of them than components) are left out for all rows, so that a table without two different vectors gives no rows.
    The fit list has each x once, repeated rows each have their own results. Shorter vectors count as filled up with
    noughts. Entries beyond 2^62 count as 2^62; a deviation that doesn't fit a long is null. Null ids stay, other columns
    are ignored.
    """
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("id"), integers(F.col(f"`{vector_col}`")).alias("x")).where("x is not null")
    # a vector of many rows is one row of each task before it moves
    model = fit(saved(rows.select("x").distinct(), "vectors"), components)
    sql = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return embeddings.sparkSession.createDataFrame([], sql)
    schema = pa.schema([("id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
    dim, k, n = len(model.sums), len(model.values), model.n
    mean = np.array([s / n for s in model.sums])
    low = np.array([((int(s) + (1 << 63)) % (1 << 64)) - (1 << 63) for s in model.sums], np.int64)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                x = matrix(b.column(1), dim)
                own = (x - mean) @ (model.vectors / np.sqrt(model.values))
                # whole numbers modulo 2^64, which is exact for all that fit; the sum of doubles tells which do
                with np.errstate(over="ignore"):
                    deviation = ((np.int64(n) * x - low) ** 2).sum(1)
                fits = ((x - mean) ** 2).sum(1) * float(n) ** 2 < 2.0**63 * (1 - 1e-9)
                exact = pa.array(np.repeat(deviation, k), mask=np.repeat(~fits, k))
                ids = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), k)))
                m = b.num_rows
                yield batch(schema, [ids, np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n), exact, own.ravel(), np.tile(model.values / model.trace, m), np.full(m * k, model.identity_error)])

    return spread(rows).mapInArrow(project, sql)
