"""Filters on points: coordinate range, time order, percentile trim, group size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripmill.functions.geo import in_range
from tripmill.operators.scan import BLOCK, exact_percentiles, row_count, with_key, with_neighbours
from tripmill.schema import MIN_POINTS


def coordinate_filter(points: DataFrame) -> DataFrame:
    return points.where(in_range(F.col("lat"), F.col("lon")))


def longest_group(points: DataFrame) -> int:
    """Rows in the longest trip: one count per trip, combined before the shuffle."""
    return points.groupBy("trj_id").count().agg(F.max("count")).first()[0] or 0


def at_least(
    df: DataFrame, keys: list[str], minimum: int = MIN_POINTS, longest: int | None = None, block: int = BLOCK,
    shuffled: bool = False,
) -> DataFrame:
    """Keep the groups of at least ``minimum`` rows; rows with null keys are a group too.

    Groups known to hold at most ``block`` rows are counted in a window, which
    shares their partitioning. Otherwise counts are combined before the
    shuffle, and a hot group is one row on the small side of a semi-join that
    AQE may split on the other side. ``shuffled`` says that ``df`` comes out of
    a shuffle, which the count should then share.
    """
    count = F.count(F.lit(1))
    if longest is not None and longest <= block:
        return df.withColumn("_n", count.over(Window.partitionBy(*keys))).where(F.col("_n") >= minimum).drop("_n")
    keyed = with_key(df, keys)
    kept = keyed.groupBy("_key").agg((row_count(df.columns) if shuffled else count).alias("_n")).where(F.col("_n") >= minimum)
    return keyed.join(kept.select("_key"), "_key", "left_semi").drop("_key")


def valid_points(
    points: DataFrame, minimum: int = MIN_POINTS, longest: int | None = None, block: int = BLOCK
) -> DataFrame:
    """Drop points that go back in time or lie outside the coordinate range.

    Whether a point is dropped depends on whether the one before it was, which
    then gives way to the point before that. That is a two-state machine, so
    each point is one of: set to a fixed state, keep the state, or flip it. The
    state is the last fixed one, flipped once per flip since. Trips under
    ``minimum`` points, before or after, are dropped. ``k`` must number a
    trip's points 0, 1, 2, ...; a point without a number has no place and is
    dropped. Points without a trip id are a trip of their own.

    If the longest trip fits in a block, one window per trip does it all.
    Otherwise trips are cut into blocks, and one summary row per block carries
    the state and the flips across blocks.
    """
    longest = longest_group(points) if longest is None else longest
    fits = longest <= block
    group = ["trj_id"] if fits else ["_key", "blk"]
    numbered = points.where("k is not null")
    near = (
        numbered.withColumn("own", F.lit(True)) if fits
        else with_key(with_neighbours(numbered, "k", block, before=2, after=1), ["trj_id"])
    )
    w = Window.partitionBy(*group).orderBy("k")
    ok = in_range(F.col("lat"), F.col("lon"))
    seen = near.select(
        "*",
        *[F.lag("t", n).over(w).alias(f"_t{n}") for n in (1, 2)],
        *[F.lag(ok, n).over(w).alias(f"_ok{n}") for n in (1, 2)],
        F.lead("t").over(w).alias("_next"),
    ).where("own")

    def dropped_given(t_base, ok_base):
        return F.when(F.col("t") - t_base <= 0, True).when(~ok_base, False).otherwise(~ok)

    after_good = F.when(F.col("k") == 0, False).otherwise(dropped_given(F.col("_t1"), F.col("_ok1")))
    after_bad = F.when(F.col("k") <= 1, after_good).otherwise(dropped_given(F.col("_t2"), F.col("_ok2")))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    local = (
        seen.withColumn("_a", after_good).withColumn("_b", after_bad)
        .withColumn("_flip", (F.col("_a") & ~F.col("_b")).cast("long"))
        .withColumn("_flips", F.sum("_flip").over(upto))
        .withColumn("_fixed", F.when(F.col("_a") == F.col("_b"), F.col("_a").cast("long") - F.col("_flips")))
        .withColumn("_mark", F.last("_fixed", ignorenulls=True).over(upto))
    )
    bad_base = F.col("_next").isNotNull() & (F.col("_next") > F.col("t")) & ~ok
    if fits:
        local = local.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("trj_id")))
        dropped = F.pmod(F.col("_flips") + F.col("_mark"), F.lit(2)) == 1
    else:
        per_block = local.groupBy("_key", "blk").agg(
            F.sum("_flip").alias("_f"), F.max_by("_mark", "k").alias("_m"),
            row_count(points.columns).alias("_rows"),
        )
        blocks = Window.partitionBy("_key").orderBy("blk")
        earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
        start = per_block.withColumn("_f_before", F.coalesce(F.sum("_f").over(earlier), F.lit(0))).select(
            "_key", "blk", "_f_before",
            F.last(F.col("_m") - F.col("_f_before"), ignorenulls=True).over(earlier).alias("_mark_before"),
            F.sum("_rows").over(Window.partitionBy("_key")).alias("_n"),
        )
        local = local.join(start, ["_key", "blk"])
        mark = F.coalesce(F.col("_mark") - F.col("_f_before"), F.col("_mark_before"))
        dropped = F.pmod(F.col("_f_before") + F.col("_flips") + mark, F.lit(2)) == 1
    kept = local.where((F.col("_n") >= minimum) & ~dropped & ~bad_base).select(*points.columns)
    return at_least(kept, ["trj_id"], minimum, longest, block, shuffled=True)


def percentile_trim(points: DataFrame, minimum: int = MIN_POINTS, low: float = 0.01, high: float = 0.99, longest: int | None = None) -> DataFrame:
    """Drop points whose latitude and longitude both lie at or outside the outer percentiles of all points."""
    edge = exact_percentiles(points, ["lat", "lon"], [low, high])
    if not edge:
        return points

    def outside(name):
        return (F.col(name) <= edge[name, low]) | (F.col(name) >= edge[name, high])

    return at_least(points.where(~(outside("lat") & outside("lon"))), ["trj_id"], minimum, longest)
