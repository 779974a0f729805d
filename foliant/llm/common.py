"""What the operators share: tables, scratch space all machines see, and the spread of small inputs."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine.

    On a cluster without that setting there is no folder that all machines see: then this raises. Folders are removed
    when the driver ends, as results that are still lazy may read them until then.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="foliant-")
        shared_dir.own = base
    path = f"{base.rstrip('/')}/foliant-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


_made: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended before: then the folder stays for the cluster's own cleaning
            continue


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """Cuts the lineage with a table in the shared folder, which outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deals rows over all cores where the input has fewer splits than there are cores (so it is small)."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def fragments(spark: SparkSession) -> int:
    """Fragments of a hash order: as many as the cluster's operator gives shuffles."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def text_of(df: DataFrame, id_col: str, text_col: str, null_text: str | None = "") -> DataFrame:
    """The two columns an operator reads; other columns, whatever their names, stay out of its way."""
    ship(df.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), (text if null_text is None else F.coalesce(text, F.lit(null_text))).alias("text"))
