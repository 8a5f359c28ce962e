"""A training-data pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next
one's ``docs``.  All stages but the last return the columns of ``documents``, of any number and names
beside doc_id, text and lang.  An empty table passes through all of them.
"""

from __future__ import annotations

import public_tokenizers
from palimpsest.llm import decontamination, line_dedup, near_dedup, packing, quality_rules
from palimpsest.llm.common import shared_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the distances reject go.

    Null and empty texts have no words and go; repeated rows are judged alike; all columns stay.
    """
    return quality_rules.assess(docs).where("kept").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group stays; a document that loses all its lines goes.

    Null texts and texts that lose nothing stay as they are; n_chars, where there is one, follows the text.
    """
    found = line_dedup.dedup_lines(docs)
    left = found.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[\p{L}\p{N}]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast("long"))
    return left.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least id: five-word shingles, similarity 0.8.

    Rows without words or without an id are in no group and stay.
    """
    return near_dedup.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null texts hold none."""
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids with their sequence and place; null texts pack as their end id."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: The packing stage tokenises, which SQL can't: the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
