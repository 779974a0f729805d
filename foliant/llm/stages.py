"""Stages of a corpus pipeline: documents in, documents out, each by one operator.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs. Other columns than doc_id and text are carried along, whatever
their names; an empty table gives an empty one. Only what a stage says it rejects goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from . import common, decontaminate, jaccard, packing, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator, fitted on the labels of these documents, doesn't reject.

    Null and empty texts are scored as having no hit, and stay; rows with equal ids or texts are judged each by its text.
    """
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(model, F.col("text")) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest id; of rows equal in id and text one.

    Rows without an id stay, as do null, empty and blank texts, which link with nothing. Of rows with the smallest id but
    different texts all stay; of equal rows that of the smallest source, where there is such a column.
    """
    found = jaccard.near_duplicates(docs.where("doc_id is not null"))
    kept = docs.join(found.where("id = component_id").select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    first = F.col("source").asc_nulls_last() if "source" in docs.columns else F.lit(0)
    at = common.unused(docs, "row")
    kept = kept.withColumn(at, F.row_number().over(Window.partitionBy("doc_id", F.sha2("text", 256)).orderBy(first))).where(F.col(at) == 1)
    return kept.select(*[f"`{c}`" for c in docs.columns]).union(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in passages of the benchmark; null and empty texts stay."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret and n_chars, where there is such a column, brought up to date.

    Null texts stay null and keep their n_chars.
    """
    ship(spark)
    out = docs.withColumn("text", secrets.redacted_column(F.col("text")))
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens; null and empty texts are their end token alone, equal rows apart."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("packing", pack_sequences)]
