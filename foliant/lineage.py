"""Folders that all machines see: cutting the lineage of iterative plans, and small files written whole."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str:
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base and not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return base or tempfile.mkdtemp(prefix="foliant-")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of spark.checkpoint.dir; a temporary one only where all runs on one machine."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_base(df.sparkSession))
    return df.checkpoint()


def shared(spark: SparkSession) -> str:
    """A new folder below that of spark.checkpoint.dir."""
    base = _base(spark)
    return f"{base.rstrip('/') if '://' in base else 'file://' + base}/foliant-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    fs, where = _fs(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all, and never overwritten: the second writer of a name fails."""
    fs, final = _fs(spark, path)
    _, temp = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(temp, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(final) or not fs.rename(temp, final):
        fs.delete(temp, False)
        raise FileExistsError(path)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)
