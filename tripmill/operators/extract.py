"""Labelled trips from raw points: interval joins, as-of labels and label runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmill.operators.scan import BLOCK, carry_over, ordered_blocks, ordered_rank, with_key

DAY = 86400.0


def group_fits(df: DataFrame, keys: list[str], block: int = BLOCK) -> bool:
    """Whether every group has at most ``block`` rows: one count with map-side combining."""
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (largest or 0) <= block


def interval_trips(
    points: DataFrame, intervals: DataFrame, key: str, width: float = DAY, keep: list[str] | None = None
) -> DataFrame:
    """Points of each interval ``st <= t <= et`` of the same key, both ends included.

    Overlapping intervals repeat points. The join is an equi-join on the key and
    a time bucket of ``width`` seconds: an interval is listed once per bucket it
    touches and a point once, so a busy key spreads over its buckets.
    """
    listed = intervals.withColumn(
        "_bucket", F.explode(F.sequence(F.floor(F.col("st") / width), F.floor(F.col("et") / width)))
    )
    bucketed = points.withColumn("_bucket", F.floor(F.col("t") / width))
    joined = bucketed.join(listed, [key, "_bucket"]).where((F.col("t") >= F.col("st")) & (F.col("t") <= F.col("et")))
    return joined.select(*(keep or [c for c in joined.columns if c != "_bucket"]))


def number_points(points: DataFrame, keys: list[str], order: list[str], block: int = BLOCK) -> DataFrame:
    """Add ``k``: 0, 1, 2, ... in time order within each trip.

    Where a trip is larger than a block, numbers come from a sort over the cluster.
    """
    if group_fits(points, keys, block):
        return points.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint") - 1)
    return ordered_rank(points, keys, order, rank="k").withColumn("k", (F.col("k") - 1).cast("bigint"))


def asof_label(
    points: DataFrame, labels: DataFrame, key: str, block: int = BLOCK, missing: int | None = None
) -> DataFrame:
    """The label of the latest interval start at or before each point, if the point lies before its end.

    Points and labels are merged in time order and the last label is carried
    forward, across the blocks of a sorted table where a key has more rows than
    a block.
    """
    columns = points.columns
    label_rows = labels.select(
        key, F.col("start_time").alias("t"), F.struct("start_time", "end_time", "label").alias("_l"), F.lit(0).alias("_is_point"),
        *[F.lit(None).cast(dict(points.dtypes)[c]).alias(c) for c in columns if c not in (key, "t")],
    )
    point_rows = points.withColumn("_l", F.lit(None).cast(dict(label_rows.dtypes)["_l"])).withColumn("_is_point", F.lit(1))
    merged = point_rows.unionByName(label_rows)
    order = ["t", "_is_point", "_l"]
    if group_fits(merged, [key], block):
        w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        seen = merged.withColumn("_seen", F.last("_l", ignorenulls=True).over(w))
    else:
        w = Window.partitionBy("_key", "blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        local = with_key(ordered_blocks(merged, [key], order), [key]).withColumn("_here", F.last("_l", ignorenulls=True).over(w))
        carried = carry_over(local, [key], lasts={"_earlier": F.max("_l")})
        seen = carried.withColumn("_seen", F.coalesce("_here", "_earlier"))
    found = F.when(F.col("t") < F.col("_seen.end_time"), F.col("_seen.label"))
    if missing is not None:
        found = F.coalesce(found, F.lit(missing))
    return seen.where("_is_point = 1").select(*columns, found.alias("label"))


def label_runs(
    samples: DataFrame, key: str, order: list[str], block: int = BLOCK
) -> DataFrame:
    """Runs of equal labels in time order: number, label, first and last time, length.

    The first run of a key has number 1. A null label equals no other, so it is
    a run of its own; rows with a null key are a key of their own.
    """
    if group_fits(samples, [key], block):
        w = Window.partitionBy(key).orderBy(*order)
        new = F.when(F.col("label") == F.lag("label").over(w), 0).otherwise(1)
        marked = samples.withColumn("_new", new).withColumn(
            "run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
        )
    else:
        # Structs tell a null label before from no row before.
        w = Window.partitionBy("_key", "blk").orderBy(*order)
        local = with_key(ordered_blocks(samples, [key], order), [key]).withColumn("_lag", F.lag(F.struct("label")).over(w))
        last = F.max_by(F.struct("label"), F.struct(*order))
        before = F.coalesce("_lag", "_earlier").getField("label")
        seen = carry_over(local, [key], lasts={"_earlier": last}).withColumn(
            "_new", F.when(F.col("label") == before, 0).otherwise(1)
        ).drop("_lag", "_earlier").withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        marked = carry_over(seen, [key], sums={"_runs": F.sum("_new")}).withColumn("run", F.col("_runs") + F.col("_run"))
    return marked.groupBy(key, "run").agg(
        F.first("label").alias("label"), F.min("t").alias("st"), F.max("t").alias("et"), F.count(F.lit(1)).alias("n")
    )


def use_modes(df: DataFrame, codes: list[int], label: str = "label") -> DataFrame:
    """Keep the rows of the listed classes."""
    return df.where(F.col(label).isin(codes))
