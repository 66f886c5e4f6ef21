"""Density estimates, shortest intervals and local maxima on tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tripmill.operators.scan import exact_percentiles, ordered_rank, with_key
from tripmill.operators.shape_masks import packed_points

# The constants of the bandwidth rules.
IQR_SCALE = 1.349
SILVERMAN, SCOTT = 0.9, 1.059
BLOCK_VALUES = 4096
RANKS = 256  # in a block of ranks
GRIDS = 32  # that leave Python together


def kernel(u: Column, kind: str) -> Column:
    """One-dimensional kernel of a scaled distance."""
    a = F.abs(u)
    shapes = {
        "gaussian": F.exp(-0.5 * u * u) / math.sqrt(2 * math.pi),
        "epanechnikov": F.when(a < 1, 0.75 * (1 - u * u)).otherwise(0.0),
        "tophat": F.when(a < 1, 0.5).otherwise(0.0),
        "exponential": F.exp(-a) / 2,
        "linear": F.when(a < 1, 1 - a).otherwise(0.0),
        "cosine": F.when(a < 1, math.pi / 4 * F.cos(math.pi / 2 * u)).otherwise(0.0),
    }
    return shapes[kind]


def kde_at(rows: DataFrame, value: str, grid: list[float], bandwidth: float = 0.2, kind: str = "gaussian", by: list[str] = []) -> DataFrame:
    """Density of a column at given places, per group.

    Equal values are counted first; each distinct value is then listed per place
    and summed before the shuffle, so only places times groups travel.
    """
    counts = rows.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    placed = counts.select(*by, "_v", "_c", F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("x"))
    weight = F.sum(F.col("_c") * kernel((F.col("x") - F.col("_v")) / bandwidth, kind))
    return placed.groupBy(*by, "x").agg((weight / (F.sum("_c") * bandwidth)).alias("density"))


def bandwidth_rules(rows: DataFrame, value: str) -> DataFrame:
    """Silverman's and Scott's bandwidth of a column."""
    q = exact_percentiles(rows, [value], [0.25, 0.75])
    iqr = (q[value, 0.75] - q[value, 0.25]) / IQR_SCALE
    std = F.stddev_samp(value)
    spread = F.least(std, F.lit(iqr)) if iqr > 0 else std
    size = F.pow(F.count(value).cast("double"), F.lit(-0.2))
    return rows.agg((SILVERMAN * spread * size).alias("silverman"), (SCOTT * spread * size).alias("scott"))


@pandas_udf(T.ArrayType(T.StructType([
    T.StructField("i", T.IntegerType()), T.StructField("fold", T.IntegerType()), T.StructField("h", T.DoubleType()), T.StructField("s", T.DoubleType()),
])))
def block_sums(at: pd.Series, values: pd.Series, folds: pd.Series, counts: pd.Series, bandwidths: pd.Series) -> pd.Series:
    """Kernel sums of one block of values at each place of another, per fold and bandwidth."""

    def one(x, v, f, c, hs):
        x, v, f, c = np.asarray(x), np.asarray(v), np.asarray(f), np.asarray(c, dtype=float)
        square = (x[:, None] - v[None, :]) ** 2
        out = []
        for h in hs:
            weight = np.exp(-0.5 * square / h**2) * c
            for fold in np.unique(f):
                out += [(i, int(fold), float(h), float(s)) for i, s in enumerate(weight[:, f == fold].sum(axis=1))]
        return out

    return pd.Series([one(*row) for row in zip(at, values, folds, counts, bandwidths)])


def bandwidth_scores(rows: DataFrame, value: str, fold: str, bandwidths: list[float], step: float | None = None) -> DataFrame:
    """Held-out log likelihood of each bandwidth, averaged over folds; ``best`` marks the largest.

    Values are rounded to multiples of ``step`` (a sixteenth of the smallest
    bandwidth; values on that grid stay exact) and counted per fold. From there on
    the work depends on the number of grid places only, not on the rows: places
    are packed in blocks, blocks meet block by block and give sums.
    """
    step = min(bandwidths) / 16 if step is None else step
    place = F.round(F.col(value).cast("double") / step) * step
    counted = rows.groupBy(place.alias("v"), F.col(fold).cast("int").alias("fold")).agg(F.count(F.lit(1)).alias("c"))
    n_blocks = max(1, math.ceil(counted.count() / BLOCK_VALUES))
    keyed = counted.withColumn("b", F.pmod(F.xxhash64("v", "fold"), F.lit(n_blocks)).cast("int"))
    blocks = keyed.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("v", "fold", "c"))).alias("t"))
    train = blocks.select(F.col("b").alias("tb"), F.col("t.v").alias("tv"), F.col("t.fold").alias("tf"), F.col("t.c").alias("tc"))
    held = blocks.select("b", F.col("t").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("tb"))
    hs = F.array(*[F.lit(float(h)) for h in bandwidths])
    parts = held.join(train, "tb").select("b", "e", F.inline(block_sums(F.col("e.v"), "tv", "tf", "tc", hs)))
    own = F.get("e", F.col("i"))
    sums = parts.select("b", "i", "h", "s", own["fold"].alias("fold"), own["c"].alias("c"), (own["fold"] != F.col("fold")).alias("other"))
    sums = sums.groupBy("b", "i", "h", "fold", "c").agg(F.sum(F.when(F.col("other"), F.col("s")).otherwise(0.0)).alias("s"))
    sizes = counted.groupBy("fold").agg(F.sum("c").alias("n")).withColumn(
        "rest", F.sum("n").over(Window.partitionBy(F.lit(0))) - F.col("n"))
    scored = sums.join(sizes, "fold").withColumn(
        "ll", F.col("c") * F.log(F.col("s") / (F.col("rest") * F.col("h") * math.sqrt(2 * math.pi))))
    per_fold = scored.groupBy("h", "fold").agg(F.sum("ll").alias("ll"))
    means = per_fold.groupBy(F.col("h").alias("bandwidth")).agg(F.avg("ll").alias("score"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "bandwidth")  # one row per bandwidth
    return means.withColumn("best", F.row_number().over(order) == 1)


def kde_grid(segments: DataFrame, keys: list[str], bandwidth: float, bins: int = 100, columns: tuple[str, str] = ("lon", "lat")) -> DataFrame:
    """Gaussian density of each segment on its own ``bins`` x ``bins`` grid.

    Only densities leave Python, as one array a segment, ``GRIDS`` segments at a
    time, so a task holds few grids however many segments it has.
    """
    ends = [f(c).alias(f"_{name}{c}") for c in columns for name, f in (("lo", F.array_min), ("hi", F.array_max))]
    packed = packed_points(segments, keys, list(columns)).select(*keys, *ends, *columns)
    kept = [c for c in packed.columns if c not in columns]
    schema = T.StructType([*[packed.schema[c] for c in kept], T.StructField("_cells", T.ArrayType(T.DoubleType()))])

    def one(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        gx, gy = np.linspace(x.min(), x.max(), bins), np.linspace(y.min(), y.max(), bins)
        wx = np.exp(-0.5 * ((gx[:, None] - x) / bandwidth) ** 2)
        wy = np.exp(-0.5 * ((gy[:, None] - y) / bandwidth) ** 2)
        return (wx @ wy.T / (len(x) * 2 * np.pi * bandwidth**2)).ravel()

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, GRIDS):
                part = batch.slice(start, GRIDS)
                xs, ys = (part.column(part.schema.get_field_index(c)) for c in columns)
                cells = [one(x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)) for x, y in zip(xs, ys)]
                grids = pa.ListArray.from_arrays(np.arange(len(cells) + 1, dtype=np.int32) * bins**2, np.concatenate(cells))
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in kept], grids], [*kept, "_cells"])

    cells = packed.mapInArrow(evaluate, schema).select(*kept, F.posexplode("_cells").alias("_i", "density"))
    place = (F.floor(F.col("_i") / bins), F.col("_i") % bins)

    def at(column: str, i: Column) -> Column:
        low, high = F.col(f"_lo{column}"), F.col(f"_hi{column}")
        return F.when(i == bins - 1, high).otherwise(low + i * ((high - low) / (bins - 1)))

    return cells.select(*keys, *[at(c, i).alias(name) for c, i, name in zip(columns, place, ("x", "y"))], "density")


def radius_density_peak(segments: DataFrame, keys: list[str], bins: int = 50, locality: float = 2.0, columns: tuple[str, str] = ("lon", "lat")) -> DataFrame:
    """The grid place of each segment with the largest sum of a fixed-radius kernel."""

    @pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "density")]))
    def peak(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        def one(x, y):
            x, y = np.asarray(x), np.asarray(y)
            radius = min(np.ptp(x), np.ptp(y)) / locality
            gx, gy = np.linspace(x.min(), x.max(), bins), np.linspace(y.min(), y.max(), bins)
            if radius == 0:
                return gx[0], gy[0], float("nan")
            far = np.sqrt((gx[:, None, None] - x) ** 2 + (gy[None, :, None] - y) ** 2)
            z = (np.exp(-3.0 * far / radius) ** 2 / (2 * np.pi) / 0.4).sum(axis=2)
            i, j = np.unravel_index(np.argmax(np.round(z, 9)), z.shape)  # the first of equals, whatever the order of the sums
            return gx[i], gy[j], z[i, j]

        return pd.DataFrame([one(x, y) for x, y in zip(xs, ys)], columns=["x", "y", "density"])

    packed = packed_points(segments, keys, list(columns))
    return packed.select(*keys, peak(*columns).alias("p")).select(*keys, "p.*")


def densest_points(density: DataFrame, keys: list[str], count: int = 20) -> DataFrame:
    """The ``count`` places of each segment with the largest density."""
    w = Window.partitionBy(*keys).orderBy(F.desc("density"), "pos")
    return density.withColumn("place", F.row_number().over(w)).where(F.col("place") <= count)


def local_maxima(cells: DataFrame, axes: list[str], value: str, order: int = 1, strict: bool = True, border: bool = False) -> DataFrame:
    """Cells larger than every other cell within ``order`` places on each axis.

    Each cell reports its value to its neighbours, and the reports are combined
    before the one shuffle. Cells without a full set of neighbours never count
    unless ``border``; without ``strict`` equal neighbours do not disqualify.
    """
    shifts = [[]]
    for _ in axes:
        shifts = [[*s, d] for s in shifts for d in range(-order, order + 1)]
    offsets = F.array(*[
        F.struct(*[F.lit(d).alias(f"_{a}") for a, d in zip(axes, s)], F.lit(not any(s)).alias("_self")) for s in shifts
    ])
    reports = cells.select(*axes, value, F.inline(offsets)).select(
        *[(F.col(a) + F.col(f"_{a}")).alias(a) for a in axes],
        F.when(F.col("_self"), F.col(value)).alias(value), F.when(~F.col("_self"), F.col(value)).alias("_other"),
    )
    seen = reports.groupBy(*axes).agg(F.max(value).alias(value), F.max("_other").alias("_top"), F.count("_other").alias("_n"))
    beats = F.col(value) > F.col("_top") if strict else F.col(value) >= F.col("_top")
    full = F.lit(True) if border else F.col("_n") == len(shifts) - 1
    return seen.where(F.col(value).isNotNull() & beats & full).select(*axes, value)


def shortest_interval(rows: DataFrame, value: str, by: list[str] = [], alpha: float = 0.05) -> DataFrame:
    """The shortest interval with a ``1 - alpha`` share of the sample, per group; the lowest of equals.

    Distinct values are counted and ranked over a global sort, so equal values,
    however many, are one row with a range of ranks. The interval from the first
    rank of a value ends at the value whose range holds the rank
    ``floor((1 - alpha) n)`` further on; ranges and ranks meet by blocks of ranks.
    Null values are not in the sample; null groups are groups.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = with_key(ordered_rank(counted, by, ["v"], running={"upto": F.col("n")}), by)
    sizes = ranked.groupBy("_key").agg(F.max("upto").alias("total"))
    start = F.col("upto") - F.col("n") + 1
    low = ranked.join(sizes, "_key").select(
        "_key", F.col("v").alias("lo"), start.alias("rnk"), (start + F.floor((1.0 - alpha) * F.col("total"))).alias("at"))
    blocks = F.explode(F.sequence(F.floor(start / RANKS), F.floor(F.col("upto") / RANKS)))
    high = ranked.select("_key", F.col("v").alias("hi"), start.alias("from"), "upto", blocks.alias("b"))
    spans = low.withColumn("b", F.floor(F.col("at") / RANKS)).join(high, ["_key", "b"]).where("at BETWEEN `from` AND upto")
    best = F.min_by(F.struct(F.col("lo").alias("hdi_min"), F.col("hi").alias("hdi_max")), F.struct(F.col("hi") - F.col("lo"), F.col("rnk")))
    return spans.groupBy("_key").agg(best.alias("b")).select(*[F.col("_key").getField(c).alias(c) for c in by], "b.*")
