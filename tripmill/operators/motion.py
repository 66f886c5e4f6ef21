"""Per-step motion features with class-dependent plausibility."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tripmill.functions.geo import bearing_deg, geodesic_m
from tripmill.functions.scalar import hour_of
from tripmill.schema import (
    ACC_LIMIT_5, ACC_LIMIT_8, FEATURES_WITH_TIME, MIN_POINTS, SPEED_LIMIT_5, SPEED_LIMIT_8,
    STOP_METERS, TURN_DEGREES, lookup,
)

SEGMENT = ["trj_id", "seg_id"]


def _ragged(values: pa.ListArray, width: int) -> np.ndarray:
    """A list column as a matrix padded with NaN."""
    flat = values.flatten().to_numpy(zero_copy_only=False)
    sizes = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = np.full((len(sizes), width), np.nan)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


@arrow_udf(T.ArrayType(T.IntegerType()))
def accepted_before(v: pa.Array, dt: pa.Array, max_speed: pa.Array, max_acc: pa.Array, backwards: pa.Array) -> pa.Array:
    """For each step, the index of the latest accepted step before it, or -1; one more entry follows the last step.

    Acceptance depends on the speed of the last accepted step, so a segment is
    walked in order; all segments of the batch take each step together. A step
    with a time difference of zero is never accepted, one back in time only if ``backwards``.
    """
    sizes = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max()) if len(sizes) else 0
    speed, step = _ragged(v, width), _ragged(dt, width)
    cap, acc, back = (x.to_numpy(zero_copy_only=False) for x in (max_speed, max_acc, backwards))
    last = np.full(len(sizes), -1, dtype=np.int32)
    previous = np.zeros(len(sizes))
    out = np.empty((len(sizes), width + 1), dtype=np.int32)
    with np.errstate(invalid="ignore", divide="ignore"):
        for j in range(width):
            out[:, j] = last
            now, d = speed[:, j], step[:, j]
            ok = ((d > 0) | (back & (d < 0))) & (np.abs(now) <= cap) & (np.abs((now - previous) / d) <= acc)
            last[ok] = j
            previous[ok] = now[ok]
    out[:, width] = last
    keep = np.arange(width + 1) <= sizes[:, None]
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out[keep]))


def class_limits(label: Column, n_class: int = 5) -> tuple[Column, Column]:
    """Speed and acceleration limit of a class, as literal lookups in the projection."""
    speed, acc = (SPEED_LIMIT_5, ACC_LIMIT_5) if n_class == 5 else (SPEED_LIMIT_8, ACC_LIMIT_8)
    return lookup(speed, label), lookup(acc, label)


def raw_steps(segments: DataFrame, keys: list[str] = SEGMENT) -> DataFrame:
    """One row per step from point ``pos`` to the next, before any plausibility rule."""
    w = Window.partitionBy(*keys).orderBy("pos")
    pairs = segments.select(
        *keys, "pos", "label", "t", "lat", "lon",
        *[F.lead(c).over(w).alias(f"_{c}") for c in ("t", "lat", "lon")],
    ).where(F.col("_t").isNotNull())
    a, b = (F.col("lat"), F.col("lon")), (F.col("_lat"), F.col("_lon"))
    return pairs.select(
        *keys, "pos", "label",
        (F.col("_t") - F.col("t")).alias("delta_t"),
        hour_of(F.col("t")).alias("hour"),
        geodesic_m(*a, *b).alias("distance"),
        bearing_deg(*a, *b).alias("heading"),
        ((F.col("t") + F.col("_t")) / 2).alias("ts_mid"),
    ).withColumn("velocity", F.when(F.col("delta_t") != 0, F.col("distance") / F.col("delta_t")))


def step_features(
    segments: DataFrame, n_class: int = 5, keys: list[str] = SEGMENT,
    true_jerk: bool = False, wrap_heading: bool = False, backwards: bool = False,
) -> DataFrame:
    """All steps with their features and whether each one is plausible (``accepted``).

    Speed and heading changes are taken against the last accepted step, both 0
    at the start. The previous acceleration stays 0 unless ``true_jerk``, and
    the heading change does not wrap at 360 degrees unless ``wrap_heading``. A
    step back in time is accepted only if ``backwards`` and within the limits. A
    segment's steps (at most 199) are packed in one row to find the accepted
    ones; the rest is Column arithmetic.
    """
    max_speed, max_acc = class_limits(F.col("label"), n_class)
    fields = ["pos", "label", "delta_t", "hour", "distance", "velocity", "heading", "ts_mid"]
    packed = raw_steps(segments, keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("steps"), F.first("label").alias("label")
    )
    walked = packed.select(
        *keys, "steps",
        accepted_before(F.col("steps.velocity"), F.col("steps.delta_t"), max_speed, max_acc, F.lit(backwards)).alias("before"),
    )
    def at(i: Column, field: str) -> Column:
        """A field of step ``i``, 0 before the first step."""
        return F.coalesce(F.get(F.col("steps"), i)[field], F.lit(0.0))

    def with_previous(step: Column, i: Column) -> Column:
        before = F.get("before", i)
        extra = [
            (F.get("before", i + 1) == i).alias("accepted"),
            at(before, "velocity").alias("_v"), at(before, "heading").alias("_h"),
        ]
        if true_jerk:
            earlier = at(F.get("before", before), "velocity")
            extra.append(F.coalesce(
                (at(before, "velocity") - earlier) / F.nullif(at(before, "delta_t"), F.lit(0.0)), F.lit(0.0)).alias("_a"))
        return F.struct(*[step[f].alias(f) for f in fields], *extra)

    rows = walked.select(
        *keys, (F.size(F.array_distinct("before")) - 1).alias("n_accepted"), F.inline(F.transform("steps", with_previous))
    )
    change = F.abs(F.col("heading") - F.col("_h"))
    if wrap_heading:
        change = F.least(change, 360.0 - change)
    out = rows.withColumn("acceleration", (F.col("velocity") - F.col("_v")) / F.nullif(F.col("delta_t"), F.lit(0.0)))
    out = out.withColumn("heading_change", change)
    previous_acc = F.col("_a") if true_jerk else F.lit(0.0)
    return out.select(
        *keys, "pos", "label", "accepted", "delta_t", "hour", "distance", "velocity", "acceleration",
        ((F.col("acceleration") - previous_acc) / F.nullif(F.col("delta_t"), F.lit(0.0))).alias("jerk"),
        "heading", "heading_change", (F.col("heading_change") / F.nullif(F.col("delta_t"), F.lit(0.0))).alias("heading_change_rate"), "ts_mid",
        "n_accepted",
    )


def with_enough_steps(steps: DataFrame, minimum: int = MIN_POINTS) -> DataFrame:
    """Keep segments with at least ``minimum`` accepted steps."""
    return steps.where(F.col("n_accepted") >= minimum)


def feature_variants(steps: DataFrame, keys: list[str] = SEGMENT) -> DataFrame:
    """Clean (accepted steps) and noisy (all steps) feature rows, told apart by ``variant``."""
    variants = F.when(F.col("accepted"), F.array(F.lit("clean"), F.lit("noisy"))).otherwise(F.array(F.lit("noisy")))
    return steps.select(*keys, "pos", "label", F.explode(variants).alias("variant"), *FEATURES_WITH_TIME)


def stop_turn_flags(steps: DataFrame) -> DataFrame:
    return steps.withColumn("stop", (F.col("distance") < STOP_METERS).cast("int")).withColumn(
        "turn", (F.abs("heading_change") >= TURN_DEGREES).cast("int")
    )


def drop_rejected_points(segments: DataFrame, steps: DataFrame, keys: list[str] = SEGMENT) -> DataFrame:
    """Points of a segment without those whose outgoing step was rejected; the last point has none."""
    rejected = steps.where(~F.col("accepted")).select(*keys, "pos")
    return segments.join(rejected, [*keys, "pos"], "left_anti")


def removed_by_class(steps: DataFrame) -> DataFrame:
    """Removed steps and total points per class over segments with enough steps."""
    kept = with_enough_steps(steps)
    return kept.groupBy("label").agg(
        F.count(F.when(~F.col("accepted"), 1)).alias("removed"),
        (F.count(F.lit(1)) + F.count(F.when(F.col("pos") == 0, 1))).alias("total"),
    )


def clean_segments(segments: DataFrame, n_class: int = 5, minimum: int = MIN_POINTS, keys: list[str] = SEGMENT) -> DataFrame:
    """Segments without implausible points, times kept, for noise injection.

    A rejected step drops its first point; a step that does not go forward in
    time drops its second. Segments under ``minimum`` points, before or after,
    are dropped.
    """
    steps = step_features(segments, n_class, keys)
    bad = steps.where(~F.col("accepted")).select(
        *keys, F.when(F.col("delta_t") <= 0, F.col("pos") + 1).otherwise(F.col("pos")).alias("pos")
    ).distinct()
    kept = segments.join(bad.hint("merge"), [*keys, "pos"], "left_anti")  # grows with the points, so it stays off the driver
    w = Window.partitionBy(*keys)
    return (
        kept.withColumn("_m", F.count(F.lit(1)).over(w))
        .where((F.col("n_points") >= minimum) & (F.col("_m") >= minimum))
        .withColumn("n_points", F.col("_m").cast("int"))
        .withColumn("pos", (F.row_number().over(w.orderBy("pos")) - 1).cast("int"))
        .drop("_m")
    )
