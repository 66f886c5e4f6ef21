"""The queries of this package over the given tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmill.llm import (
    language, leaks, packing, quality, ranking, recompress, simhash, sketches, sql, suffix_dedup, tensored, token_counts, variants, warc)
from tripmill.llm.common import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, learn=~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op2_document_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketches.with_edits(table(spark, sf_dir, "documents"))
    mine, edited = F.col("sketch"), F.col("edited_sketch")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", sketches.as_text(mine).alias("fingerprint"),
        sketches.as_text(edited).alias("edited_fingerprint"), sketches.resemblance(mine, edited).alias("near_edited"),
        sketches.resemblance(mine, F.col("next_sketch")).alias("near_next"),
        sketches.containment(mine, edited).alias("contained_in_edited"), sketches.distinct_count(mine).alias("distinct_shingles"))


@query("op3_warc", sql.WARC)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(table(spark, sf_dir, "pages"))
    index = warc.read_index(spark, path)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality.scores(docs, labels, learn=~held_out(), threshold=0.3)
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op5_suffix_array_dedup", sql.REPEATED_BYTES)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).drop("kept")


@query("op6_benchmark_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("th")


@query("op7_substring_dedup", sql.REPEATED_WORDS)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return recompress.remove_repeats(docs, width=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_token_counts(table(spark, sf_dir, "documents"))


@query("op9_simhash_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), F.col("first_id").alias("component_id"))


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op11_minhash_near_dedup", sql.NEAR_SETS)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensored.near_groups(table(spark, sf_dir, "documents"))


@query("op12_spelling_variants", sql.SPELLING)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_forms(table(spark, sf_dir, "documents"))


@query("op13_ranked_search", sql.RANKED)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
