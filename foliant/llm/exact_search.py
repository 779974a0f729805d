"""Exact top-k by inner product: a stated set of queries against all rows, term at a time.

Rows are dealt into blocks of a bounded size, and every query goes to every block. There a dimension is a term with its
postings (rows whose entry isn't nought, and the entries); a query's terms, where they aren't nought, scatter weighted
postings into a dense array of scores. The best k of each array are picked by partition, and the picks of all blocks merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, saved
from .whitening import integers, matrix

K = 5
#: Entries of a block; its rows are as many as have so many entries, one at least.
ENTRIES = 1 << 19
#: Tasks at most: more blocks than that come to a task one after another.
TASKS = 20_000
#: Queries between two writings of their picks.
QUERIES = 2048


class Postings:
    """A block by term. Ids in ascending order, null ids last, so that of equal scores the first place wins."""

    def __init__(self, at: np.ndarray, ids: pa.Array, x: np.ndarray) -> None:
        null = ids.is_null().to_numpy(zero_copy_only=False)
        order = np.lexsort((at, ids.fill_null(0).to_numpy(), null))
        self.at, self.ids, x = at[order], ids.take(pa.array(order)), x[order]
        self.place = {k: i for i, k in enumerate(self.at.tolist())}
        self.largest = int(np.abs(x).max(initial=0))
        self.terms = []
        for t in range(x.shape[1]):
            rows = np.flatnonzero(x[:, t])
            whole = 2 * len(rows) > len(x)
            self.terms.append((None if whole else rows, x[:, t] if whole else x[rows, t]))
        self.cast: dict[type, list] = {}

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Exact: doubles where all sums are whole numbers below 2^53, else Python's integers."""
        small = self.largest * int(np.abs(query).max(initial=0)) * len(query) < 1 << 53
        kind = np.float64 if small else object
        if kind not in self.cast:
            self.cast[kind] = [(rows, own.astype(kind)) for rows, own in self.terms]
        total = np.zeros(len(self.at), kind)
        for t in np.flatnonzero(query):
            rows, own = self.cast[kind][t]
            weight = kind(query[t]) if small else int(query[t])
            if rows is None:
                total += own * weight
            else:
                total[rows] += own * weight
        return total

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the best k, without the row `own`."""
        score, places = self.scores(query), np.arange(len(self.at))
        if own in self.place:
            score, places = np.delete(score, self.place[own]), np.delete(places, self.place[own])
        if len(score) > k:
            cut = len(score) - k
            least = (np.partition(score, cut) if score.dtype != object else np.sort(score))[cut]
            above = np.flatnonzero(score > least)
            picked = np.append(above, np.flatnonzero(score == least)[: k - len(above)])
            score, places = score[picked], places[picked]
        return places, score


def top_k(rows: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """Per query row: query_id, rank (from 1), id, score of the k rows with the highest products; all, if there are fewer.

    is_query: a condition on the column `id`. Vectors are floor(256 x); those that are null or hold null or non-finite
    entries take no part; of unlike lengths the shorter count as filled up with noughts. A row isn't its own candidate, but
    rows that repeat it are. Ties go to the smaller id, null ids last. A score beyond a long is null (ranks are exact).
    No usable rows give none; other columns are ignored.
    """
    spark = rows.sparkSession
    usable = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), integers(F.col(f"`{vector_col}`")).alias("x")).where("x is not null")
    own = saved(usable.withColumn("at", F.monotonically_increasing_id()), "rows")
    found = own.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dim")).first()
    sql = "query_id long, rank int, id long, score long"
    if not found.n:
        return spark.createDataFrame([], sql)
    dim = max(1, found.dim)
    blocks = max(1, -(-found.n * dim // ENTRIES))
    candidates = own.select(F.pmod("at", F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "at", "id", "x")
    queries = own.where(F.coalesce(is_query, F.lit(False))).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "at", "id", "x")
    tasks = min(blocks, TASKS)
    placed = candidates.union(queries).repartitionById(tasks, F.pmod("block", F.lit(tasks))).sortWithinPartitions("block", "asks")
    schema = pa.schema([("at", pa.int64()), ("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.decimal128(38, 0))])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, postings = None, [], None
        for b in batches:
            edges = [0, *(np.flatnonzero(np.diff(b.column(0).to_numpy()) | np.diff(b.column(1).to_numpy(zero_copy_only=False))) + 1).tolist(), b.num_rows]
            for part in (b.slice(i, j - i) for i, j in zip(edges, edges[1:], strict=False) if j > i):
                if part.column(0)[0].as_py() != block:
                    block, held, postings = part.column(0)[0].as_py(), [], None
                if not part.column(1)[0].as_py():
                    held.append((part.column(2).to_numpy(), part.column(3), matrix(part.column(4), dim)))
                    continue
                if postings is None:
                    postings = Postings(np.concatenate([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]), np.concatenate([h[2] for h in held])) if held else Postings(np.zeros(0, np.int64), pa.array([], pa.int64()), np.zeros((0, dim), np.int64))
                    held = []
                asked = matrix(part.column(4), dim)
                for i in range(0, len(asked), QUERIES):
                    yield _picks(schema, postings, part.slice(i, QUERIES), asked[i : i + QUERIES], k)

    picks = placed.mapInArrow(answer, "at long, query_id long, id long, score decimal(38,0)")
    order = Window.partitionBy("at").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = picks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "id", F.col("score").try_cast("long").alias("score"))


def _picks(schema: pa.Schema, postings: Postings, part: pa.RecordBatch, asked: np.ndarray, k: int) -> pa.RecordBatch:
    places, scores, counts = [], [], []
    for at, query in zip(part.column(2).to_pylist(), asked, strict=True):
        place, score = postings.best(query, at, k)
        places.append(place)
        scores += [int(s) for s in score]
        counts.append(len(place))
    of = pa.array(np.repeat(np.arange(len(asked)), counts))
    return batch(schema, [part.column(2).take(of), part.column(3).take(of), postings.ids.take(pa.array(np.concatenate(places))), pa.array(scores, pa.decimal128(38, 0))])
