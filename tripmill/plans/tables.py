"""Queries on the full preparation and on column statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tripmill.functions.scalar import rounded
from tripmill.operators import motion, scan
from tripmill.plans import fixtures as fx
from tripmill.plans.catalog import query
from tripmill.plans.feature_tables import feature_tables, read_stored, store_sweep, trajectory_masks
from tripmill.plans.motion_profile import segments_of
from tripmill.plans.sql import case, chain, r
from tripmill.plans.trip_noise import clean_segments
from tripmill.plans.trips import good_steps
from tripmill.schema import ACC_LIMIT_5, ACC_LIMIT_8, FEATURES, SPEED_LIMIT_5, SPEED_LIMIT_8
from tripmill.session import shared_folder, stage

SEG = ["trj_id", "seg_id"]
NAMES = ["clean_features", "noisy_features", "feature_masks", "clean_points", "noisy_points", "trj_masks"]
USABLE = ", u AS (SELECT s.* FROM segs s SEMI JOIN good USING (trj_id, seg_id))"


def _sizes(tables, keys):
    out = None
    for name in NAMES:
        part = tables[name].groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pos").alias("places")).withColumn("name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("name", *keys, "n", "places")


@query("feature_tables", chain("good", USABLE + " SELECT name, trj_id, seg_id, count(*) AS n, count(*) AS places FROM u, (VALUES "
       + ", ".join(f"('{n}')" for n in NAMES) + ") t(name) GROUP BY name, trj_id, seg_id"))
def _tables(spark, sf):
    """Rows of every table per segment: each has one row per point of the segment."""
    return _sizes(feature_tables(stage(segments_of(fx.points(spark, sf)), "segments")), SEG)


VALUES = {"clean_features": FEATURES, "noisy_features": FEATURES, "feature_masks": FEATURES, "clean_points": ["lat", "lon"], "noisy_points": ["lat", "lon"], "trj_masks": ["mask"]}


@query("noisy_feature_tables")
def _noisy_tables(spark, sf):
    """The tables of all 16 noise sets, written, and read back by set: rows, segments and the sum of all values."""
    folder = f"{shared_folder(spark)}/sets-{uuid.uuid4().hex}"
    store_sweep(clean_segments(spark, sf), folder, "test")
    out = None
    for name, columns in VALUES.items():
        rows = read_stored(spark, folder, name, "test")
        total = F.sum(sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0)))
        part = rows.groupBy("noise_config").agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct(*SEG).alias("segments"), rounded(total, 4).alias("total")).withColumn("name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("name", "noise_config", "n", "segments", "total")


@query("random_feature_mask_sizes", chain("good", USABLE + """, z AS (SELECT trj_id, seg_id, CAST(count(*) AS INT) AS n FROM u GROUP BY ALL)
SELECT trj_id, seg_id, CAST(round_even(n * 0.15::DOUBLE, 0) AS BIGINT) AS masked FROM z"""))
def _mask_sizes(spark, sf):
    """A random trajectory mask covers the rounded share of each segment, unless spans alone cover more."""
    seg = segments_of(fx.points(spark, sf))
    usable = seg.join(good_steps(spark, sf).where("pos = 0").select(*SEG), SEG, "left_semi")
    mask = trajectory_masks(usable, SEG, "random", length=1)
    return mask.groupBy(*SEG).agg(F.sum(1 - F.col("mask")).alias("masked"))


@query("global_percentiles", f"SELECT {r('quantile_cont(l_extendedprice, 0.01)', 6)} AS p1, {r('quantile_cont(l_extendedprice, 0.5)', 6)} AS p50, {r('quantile_cont(l_extendedprice, 0.99)', 6)} AS p99 FROM lineitem")
def _percentiles(spark, sf):
    found = scan.exact_percentiles(fx.table(spark, sf, "lineitem"), ["l_extendedprice"], [0.01, 0.5, 0.99])
    names = {"p1": 0.01, "p50": 0.5, "p99": 0.99}
    return spark.range(1).select(*[rounded(F.lit(found["l_extendedprice", s]), 6).alias(n) for n, s in names.items()])


@query("feature_statistics", chain("good", " SELECT " + ", ".join(
    f"{r(f'{fn}({c})')} AS {c}_{fn}" for c in ("velocity", "heading_change") for fn in ("avg", "stddev_samp", "min", "max")) + " FROM good"))
def _statistics(spark, sf):
    fns = {"avg": F.avg, "stddev_samp": F.stddev_samp, "min": F.min, "max": F.max}
    rows = good_steps(spark, sf)
    return rows.agg(*[rounded(fn(c)).alias(f"{c}_{n}") for c in ("velocity", "heading_change") for n, fn in fns.items()])


def _shifted(limits):
    return {code - 2: v for code, v in limits.items() if 0 <= code - 2 <= 4}


EIGHT = chain("good", " SELECT CAST(label + 2 AS INT) AS label, count(*) FILTER (NOT accepted) AS removed, count(*) + count(*) FILTER (pos = 0) AS total FROM good GROUP BY label")
for five, eight in ((SPEED_LIMIT_5, SPEED_LIMIT_8), (ACC_LIMIT_5, ACC_LIMIT_8)):
    EIGHT = EIGHT.replace(case("label", five), case("label", _shifted(eight)))


@query("eight_class_removed", EIGHT)
def _eight(spark, sf):
    """Removed steps under the limits of the eight-class codes."""
    points = fx.points(spark, sf).withColumn("label", (F.col("label") + 2).cast("int"))
    return motion.removed_by_class(motion.step_features(segments_of(points), n_class=8))
