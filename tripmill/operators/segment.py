"""Cut trips at long stays and into fixed-size chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripmill.operators.clean import longest_group
from tripmill.operators.scan import BLOCK, row_count, with_key
from tripmill.schema import MAX_SEGMENT, MIN_POINTS, STAY_SECONDS


def mark_stays(
    points: DataFrame, gap: float = STAY_SECONDS, longest: int | None = None, block: int = BLOCK,
    keys: tuple[str, ...] = ("trj_id",),
) -> DataFrame:
    """Add ``stay_id`` (parts cut where the time step exceeds ``gap``) and ``pos``, the place within the part.

    Adds ``start`` as well, the place of the part's first point in its trip.
    ``k`` orders a trip's points and may have holes; a point without ``k`` has no
    place and is dropped, points without a trip id are a trip of their own. If the longest trip fits in
    a block, one window per trip does it; otherwise one summary row per block
    carries the counts of rows and cuts and the latest cut across blocks.
    """
    keys = list(keys)
    longest = longest_group(points) if longest is None else longest
    fits = longest <= block
    group = keys if fits else ["_key", "blk"]
    w = Window.partitionBy(*group).orderBy("k")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = points.where("k is not null")
    source = numbered if fits else with_key(numbered.withColumn("blk", F.floor(F.col("k") / block)), keys)
    local = (
        source
        .withColumn("_row", F.row_number().over(w) - 1)
        .withColumn("_cut", F.col("t") - F.lag("t").over(w) > gap)
        .withColumn("_cuts", F.count(F.when(F.col("_cut"), 1)).over(upto))
        .withColumn("_cut_row", F.max(F.when(F.col("_cut"), F.col("_row"))).over(upto))
    )
    if fits:
        begin = F.coalesce(F.col("_cut_row"), F.lit(0)).cast("bigint")
        return local.select(*points.columns, F.col("_cuts").alias("stay_id"), begin.alias("start"), (F.col("_row") - begin).alias("pos"))
    per_block = local.groupBy("_key", "blk").agg(
        row_count(points.columns).alias("_n"),
        F.min_by("t", "k").alias("_first_t"), F.max_by("t", "k").alias("_last_t"),
        F.max("_cuts").alias("_inner"), F.max("_cut_row").alias("_inner_row"),
    )
    blocks = Window.partitionBy("_key").orderBy("blk")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    through = blocks.rowsBetween(Window.unboundedPreceding, 0)
    start = (
        per_block.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("_edge", F.coalesce(F.col("_first_t") - F.lag("_last_t").over(blocks) > gap, F.lit(False)))
        .withColumn("_cuts_before", F.coalesce(F.sum("_inner").over(earlier), F.lit(0)) + F.sum(F.col("_edge").cast("long")).over(through))
        .withColumn("_latest", F.greatest(F.when(F.col("_edge"), F.col("_base")), F.col("_base") + F.col("_inner_row")))
        .withColumn("_start", F.when(F.col("_edge"), F.col("_base")).otherwise(F.coalesce(F.max("_latest").over(earlier), F.lit(0))))
        .select("_key", "blk", "_base", "_cuts_before", "_start")
    )
    begin = F.coalesce(F.col("_base") + F.col("_cut_row"), F.col("_start"))
    return local.join(start, ["_key", "blk"]).select(
        *points.columns,
        (F.col("_cuts_before") + F.col("_cuts")).alias("stay_id"),
        begin.alias("start"),
        (F.col("_base") + F.col("_row") - begin).alias("pos"),
    )


def cut_segments(
    points: DataFrame, gap: float = STAY_SECONDS, size: int = MAX_SEGMENT, minimum: int = MIN_POINTS,
    longest: int | None = None, block: int = BLOCK, keys: tuple[str, ...] = ("trj_id",),
) -> DataFrame:
    """Segments of at most ``size`` points: parts between stays, chunked.

    ``seg_id`` is the place of the segment's first point in its trip and ``pos``
    is renumbered from 0. A part's first chunk always stays; a later remainder
    of at most ``minimum`` points is dropped.
    """
    chunk = F.floor(F.col("pos") / size)
    parts = mark_stays(points, gap, longest, block, keys).select(
        *points.columns,
        (F.col("start") + chunk * size).alias("seg_id"),
        (F.col("pos") - chunk * size).cast("int").alias("pos"),
        (chunk == 0).alias("_first"),
    )
    count = F.count(F.lit(1)).over(Window.partitionBy(*keys, "seg_id"))
    return parts.withColumn("n_points", count.cast("int")).where(F.col("_first") | (F.col("n_points") > minimum)).drop("_first")
