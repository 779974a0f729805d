"""Numbers, sums and last values along a sequence that is too long for one task.

Rows are dealt into ranges of the sequence; each range works out its own windows, and what the ranges before it carry in
(how many rows, the sum, the last value) is added. What is carried is a row for each range and each sequence that reaches
over its edge: two for each range at most, whatever the number of rows or keys. So one long sequence, or a key that holds a
third of all rows, is the work of many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

#: count: the row's number from 1. sum: of values up to the row. last: the last value that isn't null up to the row,
#: before: up to the row ahead of it. previous: the value of the row ahead, null or not.
KINDS = ("count", "sum", "last", "before", "previous")


@dataclass(frozen=True)
class Scan:
    kind: str
    value: Column | str | None = None

    @property
    def column(self) -> Column:
        return F.lit(1) if self.value is None else F.col(self.value) if isinstance(self.value, str) else self.value


def along(rows: DataFrame, scans: Mapping[str, Scan], order: Sequence[Column | str], keys: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Rows with a column for each scan over their sequence (of equal keys, null ones too), in the given order.

    The order should tell all rows of a sequence apart: rows that it doesn't stand in any order, and in one range. Sums of
    nothing but nulls are null, an empty table stays empty. ranges: as many as shuffles have partitions, if not given.
    """
    if bad := [s.kind for s in scans.values() if s.kind not in KINDS]:
        raise ValueError(f"no scan {bad[0]}")
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*map(F.col, keys), *(F.col(c) if isinstance(c, str) else c for c in order)]
    own = rows.withColumns({f"_v{i}": s.column for i, s in enumerate(scans.values())})
    dealt = own.repartitionByRange(n, *by).withColumn("_range", F.spark_partition_id()).repartitionById(n, "_range")
    w = Window.partitionBy("_range", *keys).orderBy(*by[len(keys) :])
    upto, ahead = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)
    local = {"_at": F.row_number().over(w).cast("long")}
    for i, s in enumerate(scans.values()):
        v = F.col(f"_v{i}")
        local[f"_l{i}"] = {"count": lambda: F.row_number().over(w).cast("long"), "sum": lambda v=v: F.sum(v).over(upto), "last": lambda v=v: F.last(v, ignorenulls=True).over(upto), "before": lambda v=v: F.last(v, ignorenulls=True).over(ahead), "previous": lambda v=v: F.lag(v).over(w)}[s.kind]()
    # the ranges' edges are drawn from a sample: they are drawn once
    placed = cut(dealt.withColumns(local))
    whole = {"_n": F.count("*")}
    for i, s in enumerate(scans.values()):
        v, at = F.col(f"_v{i}"), F.col("_at")
        whole[f"_w{i}"] = {"count": lambda: F.count("*"), "sum": lambda v=v: F.sum(v), "last": lambda v=v, at=at: F.max_by(v, F.when(v.isNotNull(), at)), "before": lambda v=v, at=at: F.max_by(v, F.when(v.isNotNull(), at)), "previous": lambda v=v, at=at: F.max_by(F.struct(v.alias("v")), at)}[s.kind]()
    parts = placed.groupBy("_range", *keys).agg(*[c.alias(k) for k, c in whole.items()])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = {"_first": F.count("*").over(before) == 0}
    for i, s in enumerate(scans.values()):
        x = F.col(f"_w{i}")
        carried[f"_c{i}"] = F.sum(x).over(before) if s.kind in ("count", "sum") else F.last(x, ignorenulls=True).over(before)
    edges = parts.withColumns(carried).where(~F.col("_first"))
    edges = edges.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], *[f"_c{i}" for i in range(len(scans))])
    same = F.col("_range") == F.col("_r")
    for j, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{j}"))
    joined = placed.join(F.broadcast(edges), same, "left")  # two rows for each range at most
    out = []
    for i, (name, s) in enumerate(scans.items()):
        here, come = F.col(f"_l{i}"), F.col(f"_c{i}")
        out.append({"count": lambda: here + F.coalesce(come, F.lit(0)), "sum": lambda: F.coalesce(here + come, here, come), "last": lambda: F.coalesce(here, come), "before": lambda: F.coalesce(here, come), "previous": lambda: F.when(F.col("_at") == 1, come["v"]).otherwise(here)}[s.kind]().alias(name))
    return joined.select(*[c for c in rows.columns if c not in scans], *out)


def ranked(rows: DataFrame, order: Sequence[Column | str], name: str = "place") -> DataFrame:
    """Rows with their place from 1 in the order of all."""
    return along(rows, {name: Scan("count")}, order)


def stretch(rows: DataFrame, scans: Mapping[str, Scan], order: Sequence[Column | str], keys: Sequence[str] = ()) -> DataFrame:
    """The same columns by windows where sequences have keys, each small enough for a task, and along the whole where not."""
    if not keys:
        return along(rows, scans, order)
    w = Window.partitionBy(*keys).orderBy(*order)
    upto, ahead = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)
    made = {"count": lambda s: F.row_number().over(w).cast("long"), "sum": lambda s: F.sum(s.column).over(upto), "last": lambda s: F.last(s.column, ignorenulls=True).over(upto), "before": lambda s: F.last(s.column, ignorenulls=True).over(ahead), "previous": lambda s: F.lag(s.column).over(w)}
    return rows.withColumns({name: made[s.kind](s) for name, s in scans.items()})


def dealt(rows: DataFrame, *by: str, most: int = 2_000_000) -> DataFrame:
    """Rows dealt by columns to as many tasks as give each some `most` rows, where the session's number of partitions would give
    them more: what a task holds to sort doesn't grow with the table then. Counts the rows (of Parquet, by its footers)."""
    n = -(-rows.count() // most)
    return rows.repartition(n, *by) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows
