"""Segments: tables to cells, columns to classes, texts to a dictionary of unique values, and mapped values back to cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.prompts import is_contaminated
from ..functions.text import dates, fidelity, is_absent, is_code, is_skippable, retry_prompt, strip, value, with_dates_marked, with_dates_restored
from ..lineage import cut
from .scans import Scan, ranked, stretch

ENUM_MOST = 100
REVIEW_MARK = "⚠️ "


def cells(units: DataFrame) -> DataFrame:
    """units: unit_id, rows (lists of cells). A row for each cell, from 0."""
    rows = units.select("unit_id", F.posexplode("rows").alias("row", "own"))
    return rows.select("unit_id", "row", F.posexplode("own").alias("col", "value"))


def classify(table: DataFrame, by: Sequence[str] = ("unit_id", "col"), text: str = "value", most: int = ENUM_MOST, row: str = "row") -> DataFrame:
    """By column: skip if no cell needs a rendering, enum if few distinct values, else text. Row 0, the header, takes no part;
    values differ as they are written, blanks around them included."""
    v = F.when((F.col(row) > 0) & (value(text) != ""), F.col(text))
    found = table.groupBy(*by).agg(F.coalesce(F.bool_and(is_skippable(v)), F.lit(True)).alias("_skip"), F.countDistinct(v).alias("unique"))
    return found.select(*by, F.when(F.col("_skip"), "skip").when(F.col("unique") <= most, "enum").otherwise("text").alias("class"), "unique")


def harvest(table: DataFrame, classes: DataFrame, unit: Sequence[str] = ("unit_id",)) -> DataFrame:
    """Texts to render, numbered: of a unit header cells with a letter first, then data cells of columns that aren't skipped."""
    kept = table.join(classes.select(*unit, "col", "class"), [*unit, "col"], "left")
    head = F.col("row") == 0
    kept = kept.where((value("value") != "") & F.when(head, F.col("value").rlike("[A-Za-z\u4e00-\u9fff]")).otherwise(F.coalesce("class", F.lit("skip")) != "skip"))
    at = F.row_number().over(Window.partitionBy(*unit).orderBy("row", "col")) - 1
    return kept.select(*unit, "row", "col", value("value").alias("value"), at.cast("long").alias("at"))


def ranges(segments: DataFrame, units: DataFrame, unit: Sequence[str] = ("unit_id",), order: Sequence[str] = ("unit_id",), batch: Sequence[str] = ()) -> DataFrame:
    """By unit, those without segments and texts included: where its segments begin among all of its batch, and how many.

    units: a row for each, with what orders them. Sums run over the units of a batch (a file, an upload), not over segments;
    without a batch over all units, in ranges of many tasks.
    """
    counts = segments.groupBy(*batch, *unit).agg(F.count("*").alias("count"))
    counts = units.select(*dict.fromkeys([*batch, *unit, *order])).join(counts, [*batch, *unit], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return stretch(counts, {"_upto": Scan("sum", "count")}, order, batch).withColumn("start", F.col("_upto") - F.col("count")).drop("_upto")


def encode(segments: DataFrame, text: str, order: str, save: bool = False) -> tuple[DataFrame, DataFrame]:
    """Segments with the key of their text without dates, and the dictionary: a row for each key, first place and count.

    save: dates are found once, for where both tables are used; the segments are then a table in the shared folder.
    """
    marked = segments.withColumn("norm", with_dates_marked(strip(text))).withColumn("dates", dates(strip(text)))
    marked = cut(marked) if save else marked
    # the texts themselves are the key; their digest, which the cache goes by, is worked out once for each
    found = marked.groupBy("norm").agg(F.min(order).alias("first"), F.count("*").alias("refs"))
    return marked, found.select(F.sha2("norm", 256).alias("key"), "norm", "first", "refs")


def indexed(marked: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two tables of encode with uniq_idx: numbers from 0 by the first place at which a text is seen."""
    numbered = cut(ranked(dictionary, ["first"], "_place").withColumn("uniq_idx", F.col("_place") - 1).drop("_place"))
    return marked.join(numbered.select("norm", "uniq_idx"), "norm", "left"), numbered


def _asked(provider: Callable[[list[str]], list[str]], most: int, column: Column | str, known: Column | str | None = None) -> Column:
    """The provider's answers, `most` texts at a time; texts with a known one aren't asked for."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for own, had in batches:
            out = had.astype(object)
            open_ = out.isna() & own.notna()
            texts = own[open_].tolist()
            found = [y for i in range(0, len(texts), most) for y in provider(texts[i : i + most])]
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} answers to {len(texts)} texts")
            out[open_] = found
            yield out

    return ask(column, F.lit(None).cast("string") if known is None else known)


def map_unique(dictionary: DataFrame, cache: DataFrame | None, provider: Callable[[list[str]], list[str]], partitions: int | None = None, most: int = 50, terms: Sequence[str] = ()) -> DataFrame:
    """target and status for each unique value: from the cache where it is ok there (terms of a glossary never are), codes as
    they are, the rest by the provider, `most` at a time. The cost goes with unique values, not with segments."""
    known = dictionary if cache is None else dictionary.join(cache.where(F.col("status") == "ok").select("key", F.col("target").alias("_hit")), "key", "left")
    known = known if cache is not None else known.withColumn("_hit", F.lit(None).cast("string"))
    same = F.when(is_code("norm") | is_skippable("norm"), F.col("norm"))
    hit = F.when(~F.col("norm").isin(*terms), F.col("_hit")) if terms else F.col("_hit")
    ready = known.withColumn("target", F.coalesce(hit, same)).drop("_hit")
    ready = ready.repartition(partitions) if partitions else ready
    # one pass: what is known goes through beside what is asked for, so that the dictionary is built once
    return ready.withColumn("target", _asked(provider, most, "norm", "target")).withColumn("status", F.lit("ok"))


def verified(mapped: DataFrame, provider: Callable[[list[str]], list[str]], most: int = 1, hints: dict[str, str] | None = None) -> DataFrame:
    """Renderings that lack something are asked for once more, with a hint (by the reason's kind); one that then is right and
    doesn't repeat the hint is taken, else the first stays, for review. Adds reason, why the first one failed."""
    checked = cut(mapped.withColumn("reason", fidelity("norm", "target")))
    good, bad = checked.where("reason = 'ok'"), checked.where("reason <> 'ok'")
    again = bad.withColumn("_again", _asked(provider, most, retry_prompt("norm", "reason", hints)))
    better = (fidelity("norm", "_again") == "ok") & ~is_contaminated("_again", hints)
    again = again.withColumn("status", F.when(better, "ok").otherwise("review")).withColumn("target", F.when(better, F.col("_again")).otherwise(F.col("target")))
    return good.unionByName(again.drop("_again"))


def index_join(items: DataFrame, renderings: DataFrame, text: str = "text", at: str = "at") -> DataFrame:
    """Items with the rendering of their place; what has none, or isn't ok, keeps its own text (behind a mark if it failed)."""
    joined = items.join(renderings.select(at, "target", "status"), at, "left")
    return joined.withColumn("rendered", F.when(F.col("status").isNull(), F.col(text)).when(F.col("status") == "ok", F.col("target")).otherwise(F.concat(F.lit(REVIEW_MARK), F.col(text)))).drop("target", "status")


def write_back(encoded: DataFrame, mapped: DataFrame, text: str) -> DataFrame:
    """Each segment with its rendering, dates in place; where the status isn't ok the source stays behind a mark."""
    joined = encoded.join(mapped.select("norm", "target", "status"), "norm", "left")
    good = with_dates_restored("target", "dates")
    return joined.withColumn("rendered", F.when(F.col("status") == "ok", good).otherwise(F.concat(F.lit(REVIEW_MARK), F.col(text)))).drop("norm", "dates")


def repeated_edge_lines(pages: DataFrame, file: Sequence[str], lines: str = "lines", share: int = 3) -> DataFrame:
    """Lines among the first and last two of pages that stand on a third of a file's pages, three at least."""
    own = F.filter(F.transform(F.col(lines), lambda x: strip(x)), lambda x: x != "")
    edges = F.array_distinct(F.concat(F.slice(own, 1, 2), F.slice(own, F.greatest(F.lit(1), F.size(own) - 1), F.lit(2))))
    n = pages.groupBy(*file).agg(F.count("*").alias("_pages"))
    found = pages.select(*file, F.explode(edges).alias("line")).where(F.length("line") >= 2).groupBy(*file, "line").agg(F.count("*").alias("seen"))
    return found.join(n, list(file)).where(F.col("seen") >= F.greatest(F.lit(3), F.floor((F.col("_pages") + 2) / share))).drop("_pages")


def batches(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, most: int = 50, budget: int = 6000) -> DataFrame:
    """Greedy batches within a key: a new one when it is full or would have too many characters. An item above the budget is
    a batch of its own.

    Where a batch ends depends on all before it: the rows of a key go by one after another through one task, which keeps
    three numbers and a block of rows, never a key.
    """
    own = rows.select(*keys, *order, F.col(size).cast("long").alias(size))
    placed = own.repartition(*keys).sortWithinPartitions(*keys, *order)

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, batch, n, chars = None, 0, 0, 0
        for part in parts:
            out = []
            for key, x in zip(part[list(keys)].itertuples(index=False, name=None), part[size], strict=True):
                if key != last:
                    last, batch, n, chars = key, 0, 0, 0
                if n and (n >= most or chars + x > budget):
                    batch, n, chars = batch + 1, 0, 0
                n, chars = n + 1, chars + x
                out.append(batch)
            yield part.assign(batch=pd.array(out, "int64"))

    return placed.mapInPandas(deal, StructType([*own.schema.fields, StructField("batch", LongType())]))


def blank(x: Column | str) -> Column:
    return is_absent(x)


def verified_lists(rows: DataFrame, sources: str = "sources", targets: str = "targets") -> DataFrame:
    """Adds results, a list of (ok, reason) for lists of texts and renderings; lists of unlike lengths are an error."""
    same = F.size(sources) == F.size(targets)
    found = F.transform(F.arrays_zip(F.col(sources).alias("s"), F.col(targets).alias("t")), lambda x: fidelity(x["s"], x["t"]))
    judged = F.transform(found, lambda r: F.struct((r == "ok").alias("ok"), F.when(r == "ok", "").otherwise(r).alias("reason")))
    return rows.withColumn("results", F.when(same, judged).otherwise(F.raise_error(F.lit("texts and renderings differ in number"))))
