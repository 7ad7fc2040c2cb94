"""The corpus pipeline: from the documents table to packed training sequences.

Each stage reads all that its predecessor kept (written as Parquet in between): the quality classifier
drops what it rejects, one document of each group of near-duplicates stays, repeated passages go from
all but the first document, benchmark passages go, and what is left is packed. Documents that lose
all their words to a cut go; those that had none before stay. Null texts count as empty. Each row is a
document of its own, also one whose doc_id is null or stands in another row. Columns beyond those of
documents are kept up to the last stage. An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm import fmindex, minhash, packing, passages, quality
from vertexloom.llm.common import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def _without_emptied(before: DataFrame, after: DataFrame) -> DataFrame:
    """Drops the rows of after that have no words; before's own wordless rows stay."""
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return after.where(~wordless).unionByName(before.where(wordless))


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without_emptied(docs, passages.without_repeats(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without_emptied(docs, fmindex.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("passages", passage_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
#: A trained classifier and hashed candidates are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
