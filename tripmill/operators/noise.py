"""Seeded noise on segments, and how it compares with the noise already there.

A segment table has ``pos`` 0, 1, 2, ... within ``keys`` and ``n_points`` rows per
segment. Every draw hashes the seed and the row's key, so results do not depend
on partitioning. Intensity and seed may be columns, so that one job can carry
many configurations side by side. Joins of a row per segment or point carry a
merge hint: tables that grow with the input do not go through the driver.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tripmill.functions.geo import geodesic_m
from tripmill.functions.scalar import uniform01
from tripmill.operators.scan import hash_rank
from tripmill.schema import DRIFT_FACTOR, MAX_SEGMENT, MIN_POINTS, MISSING_RATE, lookup

SEGMENT = ["trj_id", "seg_id"]
# Metres per degree, correlation of the drift, offset range of outliers.
METERS_PER_DEGREE = 111000.0
PHI = 0.7
OUTLIER_METERS = (50.0, 200.0)


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def draw(seed: Column | int, *keys: str, purpose: int = 0) -> Column:
    """A uniform draw in [0, 1) for a seed, a purpose and the key columns."""
    return uniform01(_lit(seed), purpose, *[F.col(k) for k in keys])


def normal_draw(seed: Column | int, *keys: str, purpose: int = 0) -> Column:
    radius = F.sqrt(-2.0 * F.log(1.0 - draw(seed, *keys, purpose=purpose)))
    return radius * F.cos(2 * math.pi * draw(seed, *keys, purpose=purpose + 1))


def heads_of(segments: DataFrame) -> DataFrame:
    """One row per segment: its first point."""
    return segments.where("pos = 0")


def choose_segments(
    heads: DataFrame, intensity: Column | float, seed: Column | int, keys: list[str] = SEGMENT, config: list[str] | None = None
) -> DataFrame:
    """The keys of ``floor(N * intensity)`` segments, drawn without replacement (per ``config``)."""
    config = config or []
    ids = [k for k in keys if k not in config]
    heads = heads.withColumn("_share", _lit(intensity)).withColumn("_seed", _lit(seed).cast("bigint"))
    ranked = hash_rank(heads.select(*keys, "_share", "_seed"), ids, 0, config, rank="_r", total="_all", salt=F.col("_seed"))
    return ranked.where(F.col("_r") <= F.floor(F.col("_all") * F.col("_share"))).select(*keys)


def _with_choice(segments, heads, intensity, seed, keys, config) -> DataFrame:
    heads = heads_of(segments) if heads is None else heads
    chosen = choose_segments(heads, intensity, seed, keys, config).withColumn("_chosen", F.lit(True))
    return segments.join(chosen.hint("merge"), keys, "left").withColumn("_chosen", F.coalesce("_chosen", F.lit(False)))


def add_drift(
    segments: DataFrame, intensity: Column | float, seed: Column | int = 42, keys: list[str] = SEGMENT,
    config: list[str] | None = None, heads: DataFrame | None = None,
) -> DataFrame:
    """Correlated drift on the chosen segments, scaled by their mean step length and class.

    The drift is an AR(1) series; its closed form is a running sum of the
    innovations over powers of the correlation. It is begun anew every ``MAX_SEGMENT``
    points, so that these powers stay in range in longer series too.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    whole = Window.partitionBy(*keys)
    rows = _with_choice(segments, heads, intensity, seed, keys, config)
    step = geodesic_m(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w))
    ids = [k for k in keys if k not in (config or [])]
    scale = F.avg("_step").over(whole) * (0.05 + _lit(intensity) * 0.10) * lookup(DRIFT_FACTOR, F.col("label"), 1.0)
    # Steps and draws are evaluated for chosen rows only.
    rows = rows.withColumn("_step", F.when(F.col("_chosen"), step)).withColumn("_sigma", scale / METERS_PER_DEGREE)
    rows = rows.withColumn("_shrink", F.cos(F.radians(F.avg("lat").over(whole))))
    rows = rows.withColumn("_blk", F.floor(F.col("pos") / MAX_SEGMENT))
    place = F.pmod(F.col("pos"), F.lit(MAX_SEGMENT))
    run = Window.partitionBy(*keys, "_blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    power = F.pow(F.lit(PHI), place)
    size = F.when(place == 0, 1.0).otherwise(math.sqrt(1 - PHI**2))
    for axis, purpose in (("lat", 10), ("lon", 20)):
        shock = F.when(F.col("_chosen"), normal_draw(seed, *ids, "pos", purpose=purpose) * size / power)
        sum_ = F.sum(shock).over(run)
        rows = rows.withColumn(f"_{axis}", sum_ * power * F.col("_sigma"))
    lat = F.least(F.lit(90.0), F.greatest(F.lit(-90.0), F.col("lat") + F.col("_lat")))
    lon = F.least(F.lit(180.0), F.greatest(F.lit(-180.0), F.col("lon") + F.col("_lon") / F.col("_shrink")))
    moved = F.col("_chosen") & F.col("_sigma").isNotNull()
    return rows.withColumn("lat", F.when(moved, lat).otherwise(F.col("lat"))).withColumn(
        "lon", F.when(moved, lon).otherwise(F.col("lon"))
    ).select(*segments.columns)


# Lengths of lost runs as (share of draws up to, shortest, longest).
LOST_RUNS = ((0.70, 1, 3), (0.95, 4, 8), (1.0, 9, 15))


@pandas_udf(T.ArrayType(T.IntegerType()))
def missing_places(n_points: pd.Series, wanted: pd.Series, key: pd.Series) -> pd.Series:
    """Places to remove from a segment: separate runs, mostly short, until ``wanted`` places are gone.

    Attempt ``i`` draws kind, length and start of a run from the MD5 of ``key`` and
    ``i``; a run that meets an earlier one is given up. A segment has at most
    ``MAX_SEGMENT`` points, so the walk over its attempts is short.
    """

    def one(n: int, want: int, name: str) -> list[int]:
        gone = np.zeros(n, dtype=bool)
        left = want
        for i in itertools.count():
            if left <= 0:
                break
            drawn = hashlib.md5(f"{name}|{i}".encode()).hexdigest()
            kind, length, place = (int(drawn[at : at + 8], 16) / 2**32 for at in (0, 8, 16))
            longest = next(hi for share, _, hi in LOST_RUNS if kind < share)
            most = min(longest, left)
            least = max(lo for _, lo, hi in LOST_RUNS if hi <= longest and lo <= most)
            size = least + int(length * (most - least + 1))
            if n - size <= 0:
                break
            start = int(place * (n - size))
            if not gone[start : start + size].any():
                gone[start : start + size] = True
                left -= size
        return np.flatnonzero(gone).tolist()

    return pd.Series([one(int(n), int(w), k) for n, w, k in zip(n_points, wanted, key)])


def drop_runs(
    segments: DataFrame, intensity: Column | float, seed: Column | int = 42, keys: list[str] = SEGMENT,
    config: list[str] | None = None, heads: DataFrame | None = None, minimum: int = MIN_POINTS,
) -> DataFrame:
    """Runs of points lost from the chosen segments; ``minimum`` points always stay."""
    ids = [k for k in keys if k not in (config or [])]
    heads = heads_of(segments) if heads is None else heads
    rate = F.least(F.lit(0.4), lookup(MISSING_RATE, F.col("label"), 0.10) * (1 + _lit(intensity) * 2))
    want = F.least(F.floor(F.col("n_points") * rate), F.col("n_points") - minimum).cast("int")
    name = F.concat_ws("|", *[c.cast("string") for c in (_lit(seed), *[F.col(k) for k in ids])])
    chosen = heads.join(choose_segments(heads, intensity, seed, keys, config).hint("merge"), keys, "left_semi")
    lost = chosen.withColumn("_want", want).where("_want > 0").select(*keys, F.explode(missing_places(F.col("n_points"), F.col("_want"), name)).alias("pos"))
    w = Window.partitionBy(*keys)
    kept = segments.join(lost.hint("merge"), [*keys, "pos"], "left_anti")
    return (
        kept.withColumn("n_points", F.count(F.lit(1)).over(w).cast("int"))
        .withColumn("pos", (F.row_number().over(w.orderBy("pos")) - 1).cast("int"))
        .select(*segments.columns)
    )


def add_outliers(
    segments: DataFrame, intensity: Column | float, seed: Column | int = 42, keys: list[str] = SEGMENT,
    config: list[str] | None = None, heads: DataFrame | None = None,
) -> DataFrame:
    """One to three inner points of the chosen segments thrown 50 to 200 m off their neighbours' midpoint."""
    ids = [k for k in keys if k not in (config or [])]
    w = Window.partitionBy(*keys)
    rows = _with_choice(segments, heads, intensity, seed, keys, config)
    n = F.col("n_points")
    most = F.least(F.lit(4), F.floor(n / 5) + 1)
    count = F.when(most <= 1, 1).otherwise(1 + F.floor(draw(seed, *ids, purpose=30) * (most - 1)))
    inner = (F.col("pos") >= 1) & (F.col("pos") <= n - 2)
    rows = rows.withColumn("_inner", inner).withColumn(
        "_u", F.when(F.col("_chosen") & inner, draw(seed, *ids, "pos", purpose=31)))
    rows = rows.withColumn("_rank", F.row_number().over(w.orderBy(F.desc("_inner"), "_u", "pos")))
    order = w.orderBy("pos")
    for c in ("lat", "lon"):
        rows = rows.withColumn(f"_{c}", (F.lag(c).over(order) + F.lead(c).over(order)) / 2)
    low, high = OUTLIER_METERS
    far = low + (high - low) * draw(seed, *ids, "pos", purpose=32)
    angle = 2 * math.pi * draw(seed, *ids, "pos", purpose=33)
    lat = F.col("_lat") + far * F.cos(angle) / METERS_PER_DEGREE
    lon = F.col("_lon") + far * F.sin(angle) / (METERS_PER_DEGREE * F.cos(F.radians("_lat")))
    hit = F.col("_chosen") & F.col("_inner") & (F.col("_rank") <= count)
    return rows.withColumn("lat", F.when(hit, F.least(F.lit(90.0), F.greatest(F.lit(-90.0), lat))).otherwise(F.col("lat"))).withColumn(
        "lon", F.when(hit, F.least(F.lit(180.0), F.greatest(F.lit(-180.0), lon))).otherwise(F.col("lon"))
    ).select(*segments.columns)


def add_mixed(segments: DataFrame, intensity: float, seed: int = 42, keys: list[str] = SEGMENT) -> DataFrame:
    """Drift, then lost runs, then outliers, at falling intensity.

    No step adds or removes a segment, so all three choose from the same heads;
    ``segments`` is read several times and should be a stored table.
    """
    heads = heads_of(segments)
    drifted = add_drift(segments, intensity * 0.8, seed, keys, heads=heads)
    thinned = drop_runs(drifted, intensity * 0.6, seed + 1, keys, heads=heads)
    return add_outliers(thinned, intensity * 0.3, seed + 2, keys, heads=heads)


# The noise configurations of the sweep.
SWEEP_KINDS = ["drift", "missing", "outlier", "mixed"]
SWEEP_LEVELS = [0.0, 0.1, 0.2, 0.3]


def noise_sweep(segments: DataFrame, seed: int = 42, changed_only: bool = False) -> DataFrame:
    """All 16 configurations in one table, told apart by ``noise_config``.

    Segments are chosen first, from one row each. Only those that a configuration
    changes go through the three noise steps, once for all configurations, each
    at its own intensity and seed; the others are listed as they are, or left
    out with ``changed_only``. ``segments`` is read several times and should be
    a stored table.
    """
    configs = [
        F.struct(F.lit(f"{kind}_{round(level * 100)}_percent").alias("noise_config"), F.lit(kind).alias("_kind"), F.lit(level).alias("_level"))
        for kind in SWEEP_KINDS for level in SWEEP_LEVELS
    ]
    keys = ["noise_config", *SEGMENT]
    heads = heads_of(segments).select("*", F.inline(F.array(*configs)))

    def level(kind: str, mixed_share: float) -> Column:
        return F.when(F.col("_kind") == kind, F.col("_level")).when(F.col("_kind") == "mixed", F.col("_level") * mixed_share).otherwise(0.0)

    def own_seed(shift: int) -> Column:
        return F.when(F.col("_kind") == "mixed", seed + shift).otherwise(seed)

    steps = [(level("drift", 0.8), own_seed(0)), (level("missing", 0.6), own_seed(1)), (level("outlier", 0.3), own_seed(2))]
    chosen = [choose_segments(heads, share, own, keys, ["noise_config"]) for share, own in steps]
    touched = chosen[0].unionByName(chosen[1]).unionByName(chosen[2]).distinct()
    settings = heads.select(*keys, "_kind", "_level")
    rows = segments.join(settings.join(touched.hint("merge"), keys).hint("merge"), SEGMENT).select("noise_config", *segments.columns, "_kind", "_level")
    for step, (share, own) in zip((add_drift, drop_runs, add_outliers), steps):
        rows = step(rows, share, own, keys, ["noise_config"], heads)
    rows = rows.drop("_kind", "_level")
    if changed_only:
        return rows
    left = segments.join(settings.join(touched.hint("merge"), keys, "left_anti").select(*keys).hint("merge"), SEGMENT)
    return rows.unionByName(left.select("noise_config", *segments.columns))


def sweep_names() -> list[str]:
    return [f"{kind}_{round(level * 100)}_percent" for kind in SWEEP_KINDS for level in SWEEP_LEVELS]


def noise_statistics(steps: DataFrame) -> DataFrame:
    """Mean and population deviation of speed, acceleration and distance, noisy and clean; 0 and 1 where empty."""
    forward = steps.where("delta_t > 0")
    aggregates = []
    for name, flag in (("noise", ~F.col("accepted")), ("clean", F.col("accepted"))):
        for c in ("velocity", "acceleration", "distance"):
            value = F.when(flag, F.col(c))
            aggregates.append(F.coalesce(F.avg(value), F.lit(0.0)).alias(f"{name}_{c}_mean"))
            aggregates.append(F.coalesce(F.stddev_pop(value), F.lit(1.0)).alias(f"{name}_{c}_std"))
    return forward.agg(*aggregates, F.avg((~F.col("accepted")).cast("double")).alias("noise_ratio"))


def noise_ratio_check(original: DataFrame, noisy: DataFrame, config: list[str]) -> DataFrame:
    """Share of implausible steps before and after noise, and how far apart they are, per configuration."""

    def ratio(name: str) -> Column:
        implausible = F.count(F.when(~F.col("accepted"), 1))
        return (implausible / F.greatest(F.count(F.lit(1)), F.lit(1))).alias(name)

    base = original.where("delta_t > 0").agg(ratio("r")).select("r").scalar()
    after = noisy.where("delta_t > 0").groupBy(*config).agg(ratio("generated_noise_ratio"))
    both = after.withColumn("original_noise_ratio", base)
    return both.withColumn("ratio_difference", F.abs(F.col("generated_noise_ratio") - F.col("original_noise_ratio")))


def changed_ratio_check(original: DataFrame, changed: DataFrame, names: list[str], keys: list[str] = SEGMENT) -> DataFrame:
    """``noise_ratio_check`` for each of ``names`` from the steps of the changed segments only.

    What a configuration leaves as it was counts as in ``original``: its counts are
    those of all segments, less those of the changed ones, plus theirs now.
    """
    bad, n = F.count(F.when(~F.col("accepted"), 1)).alias("bad"), F.count(F.lit(1)).alias("n")
    forward = F.col("delta_t") > 0
    before = original.where(forward).groupBy(*keys).agg(bad, n)
    now = changed.groupBy("noise_config", *keys).agg(
        F.count(F.when(forward & ~F.col("accepted"), 1)).alias("new_bad"), F.count(F.when(forward, 1)).alias("new_n"))
    moved = now.join(before, keys, "left").groupBy("noise_config").agg(
        F.sum(F.col("new_bad") - F.coalesce("bad", F.lit(0))).alias("bad"), F.sum(F.col("new_n") - F.coalesce("n", F.lit(0))).alias("n"))
    every = before.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("all_bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("all_n"))
    spark = original.sparkSession
    listed = spark.createDataFrame([(x,) for x in names], "noise_config string").join(moved, "noise_config", "left")

    def ratio(b: Column, m: Column) -> Column:
        return b / F.greatest(m, F.lit(1))

    total_bad, total = every.select("all_bad").scalar(), every.select("all_n").scalar()
    both = listed.select(
        "noise_config",
        ratio(total_bad + F.coalesce("bad", F.lit(0)), total + F.coalesce("n", F.lit(0))).alias("generated_noise_ratio"),
        ratio(total_bad, total).alias("original_noise_ratio"))
    return both.withColumn("ratio_difference", F.abs(F.col("generated_noise_ratio") - F.col("original_noise_ratio")))


def mix_clean_noisy(clean: DataFrame, noisy: DataFrame, keys: list[str], columns: list[str], share: Column | float, seed: int = 42) -> DataFrame:
    """Per sample the noisy values with probability ``share``, else the clean ones; rows matched by key and ``pos``."""
    pairs = clean.select(*keys, "pos", *columns).join(
        noisy.select(*keys, "pos", *[F.col(c).alias(f"_n_{c}") for c in columns]), [*keys, "pos"]
    )
    take = draw(seed, *keys, purpose=40) < _lit(share)
    return pairs.select(
        *keys, "pos", *[F.when(take, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in columns], take.alias("is_noisy")
    )
