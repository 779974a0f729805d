"""Browsing: filters, pages with their totals, and files found by name."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.text import basename
from ..lineage import cut


def like(column: Column | str, text: str) -> Column:
    """The text lies in the column; its wildcards are signs like others."""
    return F.contains(column if isinstance(column, Column) else F.col(column), F.lit(text))


def ilike(column: Column | str, text: str) -> Column:
    """The same whatever the case."""
    return F.contains(F.lower(column if isinstance(column, Column) else F.col(column)), F.lower(F.lit(text)))


def paged(rows: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of sorted rows, and a table of one row with the total."""
    return rows.orderBy(*order).offset(offset).limit(limit), rows.agg(F.count("*").alias("total"))


def records_of(records: DataFrame, path: str | None = None, page_key: str = "页码") -> DataFrame:
    """Records of sources whose path has the text; data, a map, gets the page number where it has none of its own."""
    rows = records if path is None else records.where(like("source_path", path))
    given = F.create_map(F.lit(page_key), F.col("page_number").cast("string"))
    return rows.withColumn("data", F.when(F.map_contains_key("data", page_key), F.col("data")).otherwise(F.map_concat(given, "data")))


def tasks_of(tasks: DataFrame, status: str | None = None, kind: str | None = None, q: str = "") -> DataFrame:
    """tasks: status, run, parent_run, type (of the run's pipeline), tool_name, handle, pipeline_name. kind: a tool alone, a
    step of a flow, or part of a workflow."""
    own, parent, type_ = F.col("run").isNotNull(), F.col("parent_run").isNotNull(), F.coalesce("type", F.lit("flow"))
    kinds = {"tool": ~own, "flow": own & ~parent & (type_ == "flow"), "workflow": parent | (type_ == "workflow")}
    if kind is not None and kind not in kinds:
        raise ValueError(f"no kind {kind}")
    out = tasks if status is None else tasks.where(F.col("status") == status)
    out = out if kind is None else out.where(kinds[kind])
    return out.where(ilike("tool_name", q) | ilike("handle", q) | ilike("pipeline_name", q)) if q else out


def dictionary_of(entries: DataFrame, q: str = "", status: str | None = None, model: str | None = None) -> DataFrame:
    """entries: source, translated, status, model."""
    out = entries.where(ilike("source", q) | ilike("translated", q)) if q else entries
    out = out if status is None else out.where(F.col("status") == status)
    return out if model is None else out.where(F.col("model") == model)


def references(tasks: DataFrame, paths: DataFrame, path: str = "path", output: str = "output") -> DataFrame:
    """By path: how many successful tasks of a run have it in their output (JSON text), also within a longer text.

    Outputs are compared as canonical JSON, so that `\\/` and `\\u` escapes hide nothing, and paths as they stand in JSON;
    what isn't JSON is taken as it is. Tasks whose run is gone don't count, nulls neither; a blank path is in every output.
    Nulls and repeats among the paths go.

    Both sides are cut into grams of a few bytes, of which the least hash of every window is kept. A text that holds a path
    holds all of the path's kept grams, so the two meet by equality on the one of them that the fewest outputs have, and
    are compared then. Windows are as wide as the shortest path allows: one number.
    """
    live = tasks.where((F.col("status") == "succeeded") & F.col("run").isNotNull() & F.col(output).isNotNull())
    own = cut(live.select(F.coalesce(F.to_json(F.try_parse_json(output)), F.col(output)).alias("text")).withColumn("task", F.monotonically_increasing_id()))
    said = F.to_json(F.struct(F.col(path).alias("p")))  # {"p":"..."}
    needles = cut(paths.select(path).where(F.col(path).isNotNull()).distinct().withColumn("needle", F.substr(said, F.lit(7), F.length(said) - 8)))
    least = needles.where("needle <> ''").agg(F.min(F.octet_length("needle"))).first()[0]
    whole = needles.where("needle = ''").select(path, F.lit(own.count()).alias("refs"))
    if not least:
        return whole
    size = min(8, least)
    window = min(least - size + 1, WINDOW)
    held = cut(_grams(own.select("task", "text"), size, window))
    asked = _grams(needles.where("needle <> ''").select(path, "needle"), size, window)
    seen = held.groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no output has says that none has the path
    rarest = asked.join(seen, "gram", "left").groupBy(path).agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    met = rarest.join(held, "gram").select(path, "task").join(own, "task").join(needles, path)
    counts = met.where(F.contains("text", "needle")).groupBy(path).agg(F.count("*").alias("refs"))
    return needles.where("needle <> ''").join(counts, path, "left").select(path, F.coalesce("refs", F.lit(0)).alias("refs")).union(whole)


#: Grams of a window, at most.
WINDOW = 24


def _grams(rows: DataFrame, size: int, window: int) -> DataFrame:
    """The first column with each gram of the second, a text, that has the least hash of a window."""
    key = rows.schema[0]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [least_grams(x.as_buffer().to_pybytes(), size, window) for x in b.column(1)]
            of = pa.array(np.repeat(np.arange(len(grams)), [len(g) for g in grams]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), pa.array(np.concatenate(grams) if grams else [], pa.int64())], [key.name, "gram"])

    return rows.mapInArrow(judge, StructType([key, StructField("gram", LongType())]))


def least_grams(text: bytes, size: int, window: int) -> np.ndarray:
    """Hashes of grams (8 bytes at most) that are the least of some window of so many, each once."""
    n = len(text) - size + 1
    if n < window:
        return np.zeros(0, np.int64)
    own, grams = np.frombuffer(text, np.uint8).astype(np.uint64), np.zeros(n, np.uint64)
    for k in range(size):
        grams = grams << np.uint64(8) | own[k : k + n]
    grams = (grams ^ grams >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    reach = 1
    while reach < window:
        step = min(reach, window - reach)
        grams = np.minimum(grams[: len(grams) - step], grams[step:])
        reach += step
    return np.unique(grams).view(np.int64)


def runs_of_uploads(runs: DataFrame, folders: DataFrame, folder: str = "folder", file: str = "file") -> DataFrame:
    """Runs whose file lies in one of the folders, or below it: folder and the run's columns. The folders on a file's way meet
    them by equality; neither the way's first part nor the file's own name is one."""
    parts = F.split(file, "/")
    on_way = F.array_distinct(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))))
    return runs.withColumn(folder, F.explode(on_way)).join(folders.select(folder).distinct(), folder)


def source_files(names: DataFrame, files: DataFrame, name: str = "name", path: str = "path") -> DataFrame:
    """By name: the first path (in their order) of a file of that name, or of one that ends in `_name`; blank if there is none.

    Every ending of a file's name behind a `_` is a name it answers to, so that the join is on equality, whatever the prefix.
    """
    own = files.select(path, basename(path).alias("_file")).where(~F.col("_file").startswith("."))
    cut = F.split("_file", "_")
    ends = F.transform(F.sequence(F.lit(1), F.size(cut)), lambda i: F.array_join(F.slice(cut, i, F.size(cut)), "_"))
    found = own.select(path, F.explode(F.array_distinct(ends)).alias(name)).groupBy(name).agg(F.min(path).alias("source_file"))
    return names.select(name).distinct().join(found, name, "left").select(name, F.coalesce("source_file", F.lit("")).alias("source_file"))
