"""Connected components by alternating star operations; nothing is gathered outside the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Every node hands its smallest neighbour to the others: the larger ones (large), or itself and the smaller ones."""
    own = pairs.union(pairs.select("b", "a")) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = own.groupBy(F.col("a").alias("k")).agg(F.least(F.min("b"), F.col("k")).alias("low"))
    met = own.join(low, own.a == low.k)
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = met.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("k", "low"))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: columns a, b. Returns node, root: the smallest node of its component; nodes without a link don't appear."""
    pairs, last = links.select("a", "b").where("a <> b").distinct(), None
    while True:
        pairs = saved(_star(_star(pairs, True), False), "stars")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select("b", "b").distinct())
        last = now
