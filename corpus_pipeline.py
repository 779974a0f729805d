"""A corpus pipeline over `documents`: five stages, each one operator, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import common
from foliant.llm.stages import STAGES

#: No stage is expressible in SQL: a fitted lexicon, exact Jaccard over all texts, automata, tests and tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the documents that all stages keep. Nulls, empty texts and repeated rows as the stages say; no documents give no pieces."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), name)
    return docs
