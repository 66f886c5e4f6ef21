"""From points to plausible motion per class: the chain most other results start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmill.operators import clean, motion, segment
from tripmill.operators.scan import BLOCK
from tripmill.session import stage

PART = 1 << 15  # points that go to a task


def parts_of(points: DataFrame) -> int:
    """Tasks for ``points``: as many as their number asks for, so that the memory of a task does not grow with the table."""
    return -(-points.count() // PART) or 1


def segments_of(points: DataFrame) -> DataFrame:
    """Valid points cut into segments; trips that fit a block need a single shuffle for both, to ``parts_of`` tasks."""
    longest = clean.longest_group(points)
    if longest <= BLOCK:
        points = points.repartition(parts_of(points), "trj_id")
    return segment.cut_segments(clean.valid_points(points, longest=longest), longest=longest)


def trimmed_segments(points: DataFrame) -> DataFrame:
    """As ``segments_of`` with the percentile trim between.

    The trim needs all valid points twice, for the percentiles and for the
    filter, so they are staged once as a table.
    """
    longest = clean.longest_group(points)
    valid = stage(clean.valid_points(points, longest=longest), "valid")
    return segment.cut_segments(clean.percentile_trim(valid, longest=longest), longest=longest)


def motion_profile(points: DataFrame, n_class: int = 5) -> DataFrame:
    """Segments, steps, removed steps and mean motion per class."""
    steps = motion.with_enough_steps(motion.step_features(trimmed_segments(points), n_class))
    accepted = F.col("accepted")
    return steps.groupBy("label").agg(
        F.count(F.when(F.col("pos") == 0, 1)).alias("segments"),
        F.count(F.lit(1)).alias("steps"),
        F.count(F.when(~accepted, 1)).alias("removed"),
        F.round(F.avg(F.when(accepted, F.col("velocity"))), 4).alias("avg_velocity"),
        F.round(F.avg(F.when(accepted, F.abs("acceleration"))), 4).alias("avg_acceleration"),
        F.round(F.max("distance"), 3).alias("max_distance"),
    )
