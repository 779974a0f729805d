"""Event streams: tails, windows and heartbeats with Structured Streaming; batch twins have the same results."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import names, write_once


def tail(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """New files of an append-only log as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def after(events: DataFrame, last: int, most: int, key: str = "event_id") -> DataFrame:
    """A page of the log behind an id."""
    return events.where(F.col(key) > last).orderBy(key).limit(most)


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    own = events.withWatermark("ts", late) if late else events
    return own.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, width: str, slide: str, late: str | None = None) -> DataFrame:
    own = events.withWatermark("ts", late) if late else events
    return own.groupBy(F.window("ts", width, slide)).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Stretches of a user's events without a longer gap; a heartbeat is lost where one ends."""
    own = events.withWatermark("ts", late) if late else events
    return own.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def to_sinks(stream: DataFrame, checkpoint: str, ledger: str, sinks: Mapping[str, Callable[[DataFrame, int], None]]):
    """Every micro-batch to several sinks; ends when what is there is done.

    ledger: a folder of small files, one for each sink and micro-batch that it has whole. A stream that broke off between
    two sinks repeats the micro-batch, and those that have it are passed by. One that broke off within a sink repeats
    that sink's part: its writer has to take the same number as the same rows, as parquet_sink does.
    """

    def write(own: DataFrame, number: int) -> None:
        spark = own.sparkSession
        open_ = [s for s in sinks if f"{number:012d}" not in names(spark, f"{ledger}/{s}")]
        if not open_:
            return
        own.persist()
        try:
            for s in open_:
                sinks[s](own, number)
                write_once(spark, f"{ledger}/{s}/{number:012d}", "")
        finally:
            own.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parquet_sink(path: str, of: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """A sink with a folder for each micro-batch: writing one again replaces it."""
    return lambda df, number: of(df).write.mode("overwrite").parquet(f"{path}/batch={number}")


def sink_rows(spark: SparkSession, path: str, ledger: str, sink: str, schema) -> DataFrame:
    """What a sink has whole: the micro-batches that its ledger names."""
    whole = [int(n) for n in names(spark, f"{ledger}/{sink}") if n.isdigit()]
    return spark.read.schema(schema).parquet(*[f"{path}/batch={n}" for n in whole]) if whole else spark.createDataFrame([], schema)


def follow(stream: DataFrame, checkpoint: str, show: Callable[[DataFrame], None], ended: Column, *, every: float = 0.5, idle: int = 60) -> str:
    """Shows new events as they come until one of them is an end, or until nothing came for `idle` looks: `ended` or `idle`.

    Events of the micro-batch that holds the end are shown too. show gets a micro-batch's events: a page of a log, which
    the stream bounds by files.
    """
    seen = {"end": False, "rows": 0}

    def look(own: DataFrame, _: int) -> None:
        own.persist()
        try:
            if n := own.count():
                seen["rows"] += n
                show(own)
                seen["end"] |= not own.where(ended).isEmpty()
        finally:
            own.unpersist()

    query = stream.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint).trigger(processingTime=f"{every} seconds").start()
    quiet, last = 0, -1
    try:
        while not seen["end"] and quiet < idle and query.isActive:
            time.sleep(every)
            quiet, last = (quiet + 1, last) if seen["rows"] == last else (0, seen["rows"])
        if query.exception():
            raise query.exception()
    finally:
        query.stop()
    return "ended" if seen["end"] else "idle"
