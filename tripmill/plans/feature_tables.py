"""The full preparation: points in, the stage tables that training reads out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmill.functions.scalar import hash32
from tripmill.operators import masks, motion, noise, packed_masks, resample, shape_masks
from tripmill.plans.motion_profile import parts_of
from tripmill.schema import FEATURES, FEATURES_WITH_TIME
from tripmill.session import shuffles_dropped, stage, unstage
from tripmill.sources.tables import write_stage

SEGMENT = ["trj_id", "seg_id"]


def _random(rows: DataFrame, keys: list[str], ratio: float, length: int, seed: int) -> DataFrame:
    parts = [F.col(k) if dict(rows.dtypes)[k] != "string" else F.crc32(F.col(k).cast("binary")) for k in keys]
    first, second = (hash32(s, *parts, F.col("pos")) for s in (seed, seed + 1))
    return masks.random_mask(rows, keys, "pos", first, second, ratio, length)


def feature_masks(features: DataFrame, keys: list[str], mode: str = "ep", length: int = 4, ratio: float = 0.15, seed: int = 42) -> DataFrame:
    """One mask per feature (0 masked): around extremes (``ep``) or ``random``; other modes count as ``ep``."""
    if mode != "random":
        return packed_masks.extreme_masks(features, keys, "pos", FEATURES, length)
    long = features.select(*keys, "pos").withColumn("feature", F.explode(F.array(*[F.lit(c) for c in FEATURES])))
    marked = _random(long, [*keys, "feature"], ratio, length, seed)
    return marked.groupBy(*keys, "pos").pivot("feature", FEATURES).agg(F.first("mask"))


def trajectory_masks(
    points: DataFrame, keys: list[str], mode: str = "kde", length: int = 4, ratio: float = 0.15,
    bandwidth: float = 1.0, kernel: str = "epa", seed: int = 42, parts: int = 1,
) -> DataFrame:
    """One mask for both coordinates: around density peaks (``kde``) or ``random``; other modes count as ``kde``."""
    if mode == "random":
        return _random(points.select(*keys, "pos"), keys, ratio, length, seed)
    return shape_masks.density_mask(points, keys, length, bandwidth, kernel, parts)


def feature_tables(
    segments: DataFrame, n_class: int = 5, keys: list[str] = SEGMENT, mask_mode: str = "ep", trj_mask_mode: str = "kde",
    length: int = 4, ratio: float = 0.15, bandwidth: float = 1.0, kernel: str = "epa", staged: dict[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Clean and noisy features and coordinates, their masks, and removed steps per class.

    Features of both variants are stretched to the segment's number of points.
    ``segments`` is read several times and should be a stored table; steps and
    clean rows are staged here, as each feeds two or more of the tables;
    ``staged`` takes them under the last table that reads them. Rows go to as
    many tasks as ``segments`` ask for, whole segments each, which the grouping
    and joins by ``keys`` keep.
    """
    parts = parts_of(segments)

    def dealt(rows: DataFrame, *more: str) -> DataFrame:
        return rows.repartition(parts, *keys, *more)

    segments = dealt(segments)
    steps = stage(motion.step_features(segments, n_class, keys), "steps")
    good = dealt(motion.with_enough_steps(steps))
    sizes = segments.where("pos = 0").select(*keys, "n_points")
    labels = good.where("pos = 0").select(*keys, "label")

    def even(rows: DataFrame) -> DataFrame:
        columns = [F.col(c).cast("double").alias(c) for c in FEATURES_WITH_TIME]
        sized = rows.select(*keys, "pos", *columns).join(sizes, keys)
        return resample.resample_linear(sized, keys, "pos", FEATURES_WITH_TIME, "n_points").join(labels, keys)

    clean = stage(even(good.where("accepted")), "clean-features")
    usable = segments.join(labels.select(*keys), keys, "left_semi")
    kept = dealt(motion.drop_rejected_points(dealt(usable, "pos"), dealt(good, "pos"), keys))
    clean_points = stage(resample.resample_cubic(kept, keys, "pos", ["lat", "lon"], "n_points"), "clean-points")
    if staged is not None:
        staged |= {"feature_masks": clean, "trj_masks": clean_points, "removed": steps}
    return {
        "clean_features": clean,
        "noisy_features": even(good),
        "feature_masks": feature_masks(dealt(clean), keys, mask_mode, length, ratio),
        "clean_points": clean_points,
        "noisy_points": usable.select(*keys, "pos", "lat", "lon"),
        "trj_masks": trajectory_masks(dealt(clean_points), keys, trj_mask_mode, length, ratio, bandwidth, kernel, parts=parts),
        "removed": motion.removed_by_class(steps),
    }


def write_feature_tables(tables: dict[str, DataFrame], folder: str, split: str) -> None:
    for name, df in tables.items():
        write_stage(df.withColumn("split", F.lit(split)), f"{folder}/{name}")


MANIFEST = "split string, noise_config string, name string, n bigint"


def stored_sets(spark: SparkSession, folder: str, split: str) -> set[str]:
    """The noise sets of ``split`` whose tables have all been written to ``folder``, by its manifest."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return set()
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").where(F.col("split") == split)
    return {r["noise_config"] for r in rows.select("noise_config").distinct().collect()}  # a name per set


SHARED = "unchanged"  # the set that holds every segment as it is, and the table of the segments that a set takes from it


def store_sweep(segments: DataFrame, folder: str, split: str, seed: int = 42, at_once: int = 16, **settings) -> list[str]:
    """Prepare and write the tables of all noise sets, ``at_once`` sets in one job; returns the sets written now.

    Tables lie in folders by split and set. What a set leaves as it was is the
    same in all sets, so those rows are made and stored once, as the set
    ``SHARED``, and a table lists the segments that each set takes from it; with
    random masks, which differ by set, every set is stored by itself.
    ``read_stored`` gives whole sets either way. A set is listed in the manifest,
    with its row counts, after all its tables are written, and listed sets are
    not made again: a broken run goes on where it stopped, and folders that it
    left half done are replaced. ``segments`` should be a stored table.
    """
    spark = segments.sparkSession
    done = stored_sets(spark, folder, split)
    left = [x for x in noise.sweep_names() if x not in done]
    shares = "random" not in (settings.get("mask_mode"), settings.get("trj_mask_mode"))
    keys = ["noise_config", *SEGMENT]
    with shuffles_dropped(spark):
        for i in range(0, len(left), at_once):
            now = left[i: i + at_once]
            swept = noise.noise_sweep(segments, seed, changed_only=shares).where(F.col("noise_config").isin(now))
            if shares and not done and i == 0:
                swept = swept.unionByName(segments.withColumn("noise_config", F.lit(SHARED)))
            swept = stage(swept, "sweep")
            listed = segments.where("pos = 0").select(F.explode(F.array(*[F.lit(x) for x in now])).alias("noise_config"), *SEGMENT)
            same = listed.join(swept.where("pos = 0").select(*keys).hint("merge"), keys, "left_anti") if shares else listed.where("false")
            write_stage(same.withColumn("split", F.lit(split)), f"{folder}/{SHARED}", own=True)
            counts, staged = None, {}
            for name, df in feature_tables(swept, keys=keys, staged=staged, **settings).items():
                if "noise_config" not in df.columns:
                    continue
                write_stage(df.withColumn("split", F.lit(split)), f"{folder}/{name}", own=True)
                rows = read_stored(spark, folder, name, split).where(F.col("noise_config").isin(now))
                count = rows.groupBy("split", "noise_config").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
                counts = count if counts is None else counts.unionByName(count)
                if name in staged:
                    unstage(staged.pop(name))
            counts.select("split", "noise_config", "name", "n").write.mode("append").parquet(f"{folder}/manifest")
            for table in (*staged.values(), swept):
                unstage(table)
    return left


def read_stored(spark: SparkSession, folder: str, name: str, split: str) -> DataFrame:
    """One table of ``store_sweep``, whole sets; filters on the set reach the folders."""
    rows = spark.read.parquet(f"{folder}/{name}").where(F.col("split") == split)
    kinds = rows.select(*SEGMENT, "split", "noise_config").schema
    same = spark.read.schema(kinds).parquet(f"{folder}/{SHARED}").where(F.col("split") == split)
    shared = rows.where(F.col("noise_config") == SHARED).drop("noise_config", "split")
    # A row per set and segment on one side; broadcast, it would go through the driver.
    shared = shared.join(same.hint("merge"), SEGMENT).select(*rows.columns)
    return rows.where(F.col("noise_config") != SHARED).unionByName(shared)
