"""From documents to training batches: quality, near duplicates, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmill.llm import leaks, packing, quality, recompress, simhash
from tripmill.llm.common import held_out
from tripmill.session import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality discriminant does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, labels, learn=~held_out(), threshold=0.3).select(COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of about 0.8 and more."""
    return simhash.keep_first(docs).select(COLUMNS)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that an earlier one has; those left with no word go."""
    found = recompress.remove_repeats(docs.select(COLUMNS), width=50)
    left = found.where("n_removed < n_words or n_words = 0").withColumn("text", F.col("kept_text"))
    return left.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return leaks.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the documents in length buckets and batches of a token budget."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_near_copies),
    ("repeated_passages", without_repeated_passages),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

ORACLE_SQL = None  # the stages are not SQL; tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
