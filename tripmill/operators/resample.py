"""Resampling, subsampling and filling of series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from tripmill.operators.scan import BLOCK, carry_over, with_key


def resample_linear(rows: DataFrame, keys: list[str], order: str, columns: list[str], size: str) -> DataFrame:
    """Each series of ``columns`` stretched to ``size`` points, linear on the row index.

    ``size`` names a column that is constant per series; a series is one
    segment, so it is packed in one row and the points are built by array
    functions.
    """
    packed = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(order, *columns))).alias("s"), F.first(size).alias("n")
    )
    last = (F.size("s") - 1).cast("double")

    def point(j: Column) -> Column:
        place = F.when(j == F.col("n") - 1, last).otherwise(j * (last / (F.col("n") - 1)))
        low = F.greatest(F.lit(0), F.least(F.floor(place), F.size("s").cast("bigint") - 2)).cast("int")
        a, b = F.get("s", low), F.get("s", F.least(low + 1, F.size("s") - 1))
        return F.struct(j.alias(order), *[(a[c] + (place - low) * (b[c] - a[c])).alias(c) for c in columns])

    return packed.select(*keys, F.inline(F.transform(F.sequence(F.lit(0), F.col("n") - 1), point)))


def knot_slopes(h: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """First derivatives at the knots: one elimination down and one substitution up, for all series at once.

    ``h`` are the distances of the knots, ``slope`` the slopes between them, a row
    per series. Every row of the system has two or three entries, so the work is
    linear in the number of knots.
    """
    n, first, last = len(h) + 1, h[0] + h[1], h[-1] + h[-2]
    below = np.append(h[1:], last)
    middle = np.concatenate(([h[1]], 2 * (h[:-1] + h[1:]), [h[-2]]))
    above = np.concatenate(([first], h[:-1]))
    d = np.empty((*slope.shape[:-1], n))
    d[..., 1:-1] = 3 * (h[1:] * slope[..., :-1] + h[:-1] * slope[..., 1:])
    d[..., 0] = ((h[0] + 2 * first) * h[1] * slope[..., 0] + h[0] ** 2 * slope[..., 1]) / first
    d[..., -1] = (h[-1] ** 2 * slope[..., -2] + (2 * last + h[-1]) * h[-2] * slope[..., -1]) / last
    for i in range(1, n):
        share = below[i - 1] / middle[i - 1]
        middle[i] -= share * above[i - 1]
        d[..., i] -= share * d[..., i - 1]
    d[..., -1] /= middle[-1]
    for i in range(n - 2, -1, -1):
        d[..., i] = (d[..., i] - above[i] * d[..., i + 1]) / middle[i]
    return d


def not_a_knot(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through (x, y) with continuous third derivatives at the second and last but one knots.

    ``y`` is one series or a row per series.
    """
    n = len(x)
    if n < 4:
        return np.polynomial.polynomial.polyval(at, np.polynomial.polynomial.polyfit(x, y.T, n - 1))
    h = np.diff(x)
    slope = np.diff(y, axis=-1) / h
    d = knot_slopes(h, slope)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    u = at - x[i]
    bend = (d[..., i] + d[..., i + 1] - 2 * slope[..., i]) / h[i]
    return y[..., i] + u * (d[..., i] + u * ((slope[..., i] - d[..., i]) / h[i] - bend + u * bend / h[i]))


@pandas_udf(T.ArrayType(T.DoubleType()))
def stretch_cubic(series: pd.Series, size: pd.Series) -> pd.Series:
    """Each array stretched to ``size`` points by a not-a-knot cubic on the index; arrays of one length and size go together."""
    out = list(series)
    alike = pd.DataFrame({"n": [len(v) for v in series], "size": size.to_numpy()}).groupby(["n", "size"]).indices
    for (n, want), rows in alike.items():
        if n != want and n > 1:
            values = np.array([out[i] for i in rows], dtype=float)
            stretched = not_a_knot(np.arange(n, dtype=float), values, np.linspace(0, n - 1, int(want)))
            for i, v in zip(rows, stretched):
                out[i] = v
    return pd.Series(out)


def resample_cubic(rows: DataFrame, keys: list[str], order: str, columns: list[str], size: str) -> DataFrame:
    """As ``resample_linear`` with a not-a-knot cubic; one array per series and column goes through NumPy."""
    packed = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(order, *columns))).alias("s"), F.first(size).alias("n")
    )
    stretched = packed.select(*keys, *[stretch_cubic(F.col(f"s.{c}"), F.col("n")).alias(c) for c in columns])
    zipped = F.arrays_zip(*columns)
    return stretched.select(*keys, F.posexplode(zipped).alias(order, "p")).select(*keys, order, "p.*")


def subsample(rows: DataFrame, keys: list[str], order: str, limit: int = 256, factor: int = 2) -> DataFrame:
    """Every ``factor``-th row of series longer than ``limit``; ``order`` numbers a series from 0.

    The length is the largest number plus one, combined before the shuffle.
    """
    keyed = with_key(rows, keys)
    long = keyed.groupBy("_key").agg((F.max(order) + 1).alias("_n")).where(F.col("_n") > limit).select("_key", F.lit(True).alias("_long"))
    thin = keyed.join(long, "_key", "left").where(F.col("_long").isNull() | (F.col(order) % factor == 0))
    place = F.when(F.col("_long"), F.floor(F.col(order) / factor)).otherwise(F.col(order))
    return thin.withColumn(order, place.cast(dict(rows.dtypes)[order])).select(*rows.columns)


def fill_linear(rows: DataFrame, keys: list[str], order: str, column: str, block: int = BLOCK) -> DataFrame:
    """Missing values filled linearly by row number; ends take the nearest value.

    Series are cut into blocks of ``block`` values of ``order``; one row per block
    carries the number of rows before it and the nearest known values on both sides.
    Rows with null keys are a series, rows without ``order`` come first.
    """
    keyed = with_key(rows.withColumn("_blk", F.coalesce(F.floor(F.col(order) / block), F.lit(-1))), keys)
    w = Window.partitionBy("_key", "_blk").orderBy(order)
    local = keyed.withColumn("_row", F.row_number().over(w))
    numbered = carry_over(local, keys, "_blk", sums={"_before": F.count(F.lit(1))}).withColumn("_i", F.col("_before") + F.col("_row"))
    known = F.when(F.col(column).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(column).alias("v")))
    near = numbered.withColumn(
        "_here_a", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_here_b", F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    ends = near.groupBy("_key", "_blk").agg(F.min("_here_b").alias("low"), F.max("_here_a").alias("high"))
    blocks = Window.partitionBy("_key").orderBy("_blk")
    beyond = ends.select(
        "_key", "_blk",
        F.last("high", ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("_far_a"),
        F.first("low", ignorenulls=True).over(blocks.rowsBetween(1, Window.unboundedFollowing)).alias("_far_b"))
    around = near.join(beyond, ["_key", "_blk"]).withColumn("_a", F.coalesce("_here_a", "_far_a")).withColumn("_b", F.coalesce("_here_b", "_far_b"))
    share = (F.col("_i") - F.col("_a.i")) / F.nullif(F.col("_b.i") - F.col("_a.i"), F.lit(0))
    between = F.col("_a.v") + F.coalesce(share, F.lit(0.0)) * (F.col("_b.v") - F.col("_a.v"))
    return around.withColumn(column, F.coalesce(between, F.col("_a.v"), F.col("_b.v"))).select(*rows.columns)
