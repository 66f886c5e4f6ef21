"""Masks that need a whole segment at once: density peaks and change points.

A segment has at most 200 points and travels as one row of arrays; NumPy works
inside the task that Spark gives it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tripmill.functions import numeric
from tripmill.operators import masks

INTS = T.ArrayType(T.IntegerType())


def packed_points(segments: DataFrame, keys: list[str], columns: list[str], order: str = "pos") -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(order, *[F.col(c).cast("double").alias(c) for c in columns])))
    return segments.groupBy(*keys).agg(rows.alias("s")).select(*keys, *[F.col(f"s.{c}").alias(c) for c in [order, *columns]])


def spread(packed: DataFrame, keys: list[str], parts: int = 1) -> DataFrame:
    """Packed segments over all shuffle partitions, ``parts`` at least: they are few bytes but much work, so small partitions must not be merged."""
    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(max(n, parts), *keys)


def unpacked_mask(packed: DataFrame, keys: list[str], mask: Column, order: str = "pos") -> DataFrame:
    zipped = F.arrays_zip(F.col(order), mask.alias("mask"))
    return packed.select(*keys, F.inline(zipped).alias(order, "mask"))


def density_mask(segments: DataFrame, keys: list[str], length: int = 2, bandwidth: float = 1.0, kernel: str = "epa", parts: int = 1) -> DataFrame:
    """Mask around the densest places of each segment, shared by latitude and longitude; by ``parts`` tasks at least."""

    @pandas_udf(INTS)
    def peaks(lat: pd.Series, lon: pd.Series) -> pd.Series:
        return pd.Series([numeric.density_mask(np.asarray(a), np.asarray(b), length, bandwidth, kernel) for a, b in zip(lat, lon)])

    packed = spread(packed_points(segments, keys, ["lat", "lon"]), keys, parts)
    return unpacked_mask(packed, keys, peaks("lat", "lon"))


def change_mask(rows: DataFrame, keys: list[str], value: str, length: int = 2, penalty: float = 1.0, order: str = "pos") -> DataFrame:
    """Mask around change points found under a penalty; everything where there are at most five."""

    @pandas_udf(INTS)
    def changes(series: pd.Series) -> pd.Series:
        def one(v):
            found = numeric.change_points_penalised(np.asarray(v), penalty)
            return numeric.mask_around(found, len(v), length) if len(found) > 5 else np.zeros(len(v), dtype=np.int32)

        return pd.Series([one(v) for v in series])

    return unpacked_mask(spread(packed_points(rows, keys, [value], order), keys), keys, changes(value), order)


def change_mask_fixed(rows: DataFrame, keys: list[str], value: str, ratio: float = 0.15, length: int = 3, order: str = "pos") -> DataFrame:
    """Mask around a number of change points that covers about ``ratio`` of the series."""

    @pandas_udf(INTS)
    def changes(series: pd.Series) -> pd.Series:
        def one(v):
            wanted = round(round(len(v) * ratio) / length)
            return numeric.mask_around(numeric.change_points_fixed(np.asarray(v), wanted), len(v), length)

        return pd.Series([one(v) for v in series])

    return unpacked_mask(spread(packed_points(rows, keys, [value], order), keys), keys, changes(value), order)


@pandas_udf(T.ArrayType(T.DoubleType()))
def own_density(lat: pd.Series, lon: pd.Series) -> pd.Series:
    """Gaussian density of each point of a segment under all its points, Scott's rule on the full covariance."""

    def one(a, b):
        v = np.vstack([a, b]).astype(float)
        n = v.shape[1]
        spread = (np.atleast_2d(np.cov(v)) if n > 1 else np.zeros((2, 2))) + 1e-10 * np.eye(2)
        spread = spread * n ** (-2.0 / 6.0)
        apart = v[:, :, None] - v[:, None, :]
        energy = np.einsum("ijk,il,ljk->jk", apart, np.linalg.inv(spread), apart)
        return np.exp(-0.5 * energy).sum(axis=1) / (n * 2 * np.pi * np.sqrt(np.linalg.det(spread)))

    return pd.Series([one(a, b) for a, b in zip(lat, lon)])


def point_density(segments: DataFrame, keys: list[str]) -> DataFrame:
    packed = packed_points(segments, keys, ["lat", "lon"])
    return packed.select(*keys, F.inline(F.arrays_zip("pos", own_density("lat", "lon").alias("density"))).alias("pos", "density"))


def gaussian_mask(segments: DataFrame, keys: list[str], length: int = 2) -> DataFrame:
    """Mask around the maxima of the points' own density; everything where it has none.

    Logarithms rounded to six places are compared, so that ties do not hang on the order of a sum.
    """
    heights = point_density(segments, keys).withColumn("density", F.round(F.log("density"), 6))
    marked = masks.mark_extremes(heights, keys, "pos", "density").withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    around = masks.window_mask(marked, keys, "pos", "extreme", length)
    return marked.withColumn("mask", F.when(F.col("changes") > 0, around).otherwise(0)).select(*keys, "pos", "mask")
