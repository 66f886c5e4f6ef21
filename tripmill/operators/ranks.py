"""Ranks of models over datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_long(wide: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return wide.unpivot(ids, metrics, "metric", "value")


def to_wide(long: DataFrame, ids: list[str], datasets: list | None = None, value: str = "value") -> DataFrame:
    """One column per dataset, those of the table unless given; Spark stops at ``spark.sql.pivotMaxValues`` of them."""
    return long.groupBy(*ids).pivot("dataset", datasets).agg(F.first(value))


def competition_ranks(scores: DataFrame) -> DataFrame:
    """Rank of each model per dataset and metric, best first; equal values take the smaller rank."""
    w = Window.partitionBy("dataset", "metric").orderBy(F.desc("value"))
    return scores.withColumn("rank", F.rank().over(w))


def mean_ranks(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("metric", "model").agg(F.avg("rank").alias("avg_rank"), F.count(F.lit(1)).alias("datasets"))


def friedman(means: DataFrame) -> DataFrame:
    """Friedman's chi-squared per metric from the models' mean ranks."""
    k, n = F.count(F.lit(1)), F.max("datasets")
    spread = F.sum(F.pow("avg_rank", F.lit(2.0))) - k * F.pow(k + 1, F.lit(2.0)) / 4
    return means.groupBy("metric").agg(k.alias("models"), n.alias("datasets"), (12 * n / (k * (k + 1)) * spread).alias("chi2"))
