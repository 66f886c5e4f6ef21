"""Seeded splits and samples, exact in size and independent of partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmill.functions.scalar import uniform01
from tripmill.operators.scan import hash_rank, with_key


def shuffled(rows: DataFrame, ids: list[str], seed: int = 10086) -> DataFrame:
    """Add ``place``, the row's 1-based position in a seeded random order."""
    return hash_rank(rows, ids, seed, rank="place")


def stratified_split(rows: DataFrame, ids: list[str], label: str = "label", share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split``: ``test`` for the rounded share of each class, else ``train``."""
    ranked = hash_rank(rows, ids, seed, [label], rank="_r", total="_n")
    test = F.col("_r") <= F.round(F.col("_n") * share)
    return ranked.withColumn("split", F.when(test, "test").otherwise("train")).drop("_r", "_n")


def repeated_split(
    rows: DataFrame, ids: list[str], n_splits: int, share: float, seed: int = 1337, label: str | None = None
) -> DataFrame:
    """``n_splits`` independent folds, each with a validation share; per class if ``label`` is given."""
    folds = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    strata = ["fold", *([label] if label else [])]
    ranked = hash_rank(folds, ids, seed, strata, rank="_r", total="_n", salt=F.col("fold"))
    size = F.round(F.col("_n") * share) if label else F.ceil(F.col("_n") * share)
    return ranked.withColumn("split", F.when(F.col("_r") <= size, "validation").otherwise("train")).drop("_r", "_n")


def split_dataset(
    rows: DataFrame, ids: list[str], validation: float, n_splits: int = 1, test: DataFrame | float = 0.0,
    label: str | None = None, seed: int = 1337,
) -> DataFrame:
    """Folds with ``split`` train, validation or test: a listed or drawn test set first, then the folds over the rest."""
    if isinstance(test, DataFrame):
        listed = with_key(test, ids).select("_key").distinct().withColumn("_test", F.lit(True))
        marked = with_key(rows, ids).join(listed, "_key", "left").withColumn("_test", F.coalesce("_test", F.lit(False))).drop("_key")
    elif test:
        drawn = hash_rank(rows, ids, seed + 1, [label] if label else [], rank="_r", total="_n")
        size = F.round(F.col("_n") * test) if label else F.ceil(F.col("_n") * test)
        marked = drawn.withColumn("_test", F.col("_r") <= size).drop("_r", "_n")
    else:
        marked = rows.withColumn("_test", F.lit(False))
    # Test rows rank in a stratum of their own, so one ranking serves all folds.
    folds = marked.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    strata = ["fold", "_test", *([label] if label else [])]
    ranked = hash_rank(folds, ids, seed, strata, rank="_r", total="_n", salt=F.col("fold"))
    size = F.round(F.col("_n") * validation) if label else F.ceil(F.col("_n") * validation)
    name = F.when(F.col("_test"), "test").when(F.col("_r") <= size, "validation").otherwise("train")
    return ranked.withColumn("split", name).drop("_r", "_n", "_test")


def sample_with_replacement(rows: DataFrame, ids: list[str], share: float = 0.15, seed: int = 10086) -> DataFrame:
    """``floor(n * share)`` rows drawn with replacement; ``draw_id`` tells repeats apart."""
    n = rows.count()
    draws = rows.sparkSession.range(int(n * share)).select(
        F.col("id").alias("draw_id"), (F.floor(uniform01(seed, F.col("id")) * n) + 1).alias("_place")
    )
    return hash_rank(rows, ids, seed, rank="_place").join(draws, "_place").drop("_place")
