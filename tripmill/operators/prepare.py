"""Training-ready tables: normalised, limited, joined, padded and masked."""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmill.operators.noise import draw, mix_clean_noisy
from tripmill.operators.scan import ordered_rank

EPS = sys.float_info.epsilon
SEGMENT = ["trj_id", "seg_id"]


@dataclass(frozen=True)
class Normalizer:
    """Statistics of the training rows, applied unchanged to any other rows.

    The statistics are one aggregate row; only they reach the driver. The
    per-sample kinds keep none and use a window over each sample.
    """

    kind: str
    columns: tuple[str, ...]
    stats: dict[str, float]

    @classmethod
    def fit(cls, rows: DataFrame, columns: list[str], kind: str = "standardization") -> Normalizer:
        pair = {"standardization": (F.avg, F.stddev_samp), "minmax": (F.min, F.max)}
        if kind in ("per_sample_std", "per_sample_minmax", "none"):
            return cls(kind, tuple(columns), {})
        if kind not in pair:
            raise ValueError(f'normalize method "{kind}" not implemented')
        low, high = pair[kind]
        found = rows.agg(*[low(c).cast("double").alias(f"{c}_a") for c in columns], *[high(c).cast("double").alias(f"{c}_b") for c in columns]).first()
        return cls(kind, tuple(columns), found.asDict())

    def transform(self, rows: DataFrame, sample: list[str] = SEGMENT) -> DataFrame:
        w = Window.partitionBy(*sample)
        changed = {}
        for c in self.columns:
            x = F.col(c)
            if self.kind == "standardization":
                changed[c] = (x - self.stats[f"{c}_a"]) / (self.stats[f"{c}_b"] + EPS)
            elif self.kind == "minmax":
                changed[c] = (x - self.stats[f"{c}_a"]) / (self.stats[f"{c}_b"] - self.stats[f"{c}_a"] + EPS)
            elif self.kind == "per_sample_std":
                changed[c] = (x - F.avg(x).over(w)) / (F.stddev_samp(x).over(w) + EPS)
            elif self.kind == "per_sample_minmax":
                changed[c] = (x - F.min(x).over(w)) / (F.max(x).over(w) - F.min(x).over(w) + EPS)
        return rows.withColumns(changed) if changed else rows


def limit_samples(rows: DataFrame, heads: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """Rows of the first ``limit`` samples by key, or of that share of them if ``limit`` is at most 1.

    ``heads`` has one row per sample.
    """
    ranked = ordered_rank(heads.select(*keys), [], keys, rank="_r", total="_n")
    cut = F.lit(int(limit)) if limit > 1 else F.floor(F.col("_n") * limit)
    return rows.join(ranked.where(F.col("_r") <= cut).select(*keys), keys, "left_semi")


def without_ids(rows: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in ``excluded``."""
    return rows.join(excluded.select(*keys), keys, "left_anti")


def aligned(clean: DataFrame, noisy: DataFrame, masks: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Clean, noisy and mask values of the same step, matched by key."""
    on = [*keys, "pos"]
    return (
        clean.select(*on, "label", *[F.col(c).alias(f"clean_{c}") for c in columns])
        .join(noisy.select(*on, *[F.col(c).alias(f"noisy_{c}") for c in columns]), on)
        .join(masks.select(*on, *[F.col(c).alias(f"mask_{c}") for c in columns]), on)
    )


def hybrid(points: DataFrame, features: DataFrame, keys: list[str] = SEGMENT) -> DataFrame:
    """Coordinates beside the features of the same step."""
    return points.select(*keys, "pos", "lat", "lon").join(features, [*keys, "pos"])


def explode_series(packed: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Equal-length lists to one row per step."""
    return packed.select(*keys, F.posexplode(F.arrays_zip(*columns)).alias("pos", "s")).select(*keys, "pos", "s.*")


def one_hot(label: Column, n_class: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n_class - 1)), lambda i: (i == label).cast("int"))


def recode_labels(rows: DataFrame, label: str = "label", code: str = "code") -> DataFrame:
    """Labels as consecutive codes from 0 in label order; the code table has one row per class."""
    codes = rows.select(label).distinct().withColumn(
        code, (F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(label)) - 1).cast("byte")
    )
    return rows.join(codes, label)


def pack(rows: DataFrame, keys: list[str], columns: list[str], order: str = "pos") -> DataFrame:
    """One row per sample with an array of feature vectors in step order."""
    vector = F.array(*[F.col(c).cast("double") for c in columns])
    steps = F.array_sort(F.collect_list(F.struct(order, vector.alias("x"))))
    return rows.groupBy(*keys).agg(steps["x"].alias("x"))


def padded(x: Column, length: int | Column, width: int) -> Column:
    """A series of ``width``-vectors clipped or filled with zeros to ``length``."""
    length = F.lit(length) if isinstance(length, int) else length
    zeros = F.array_repeat(F.array(*[F.lit(0.0)] * width), F.greatest(F.lit(0), length - F.size(x)))
    return F.concat(F.slice(x, F.lit(1), length), zeros)


def padding_mask(x: Column, length: int | Column) -> Column:
    """True where the padded series holds a real step."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: i < F.size(x))


def pad_batch(packed: DataFrame, length: int, width: int, x: str = "x") -> DataFrame:
    return packed.withColumn("padding_mask", padding_mask(F.col(x), length)).withColumn(x, padded(F.col(x), length, width))


def pad_two(packed: DataFrame, length: int, widths: tuple[int, int], names: tuple[str, str] = ("x1", "x2")) -> DataFrame:
    """Two series per sample, each with its own padding mask."""
    out = packed
    for name, width in zip(names, widths):
        out = out.withColumn(f"mask_{name}", padding_mask(F.col(name), length)).withColumn(name, padded(F.col(name), length, width))
    return out


def imputation_targets(mask: Column, valid: Column) -> Column:
    """Places to predict: masked (0) and not padding."""
    return (mask == 0) & valid


def denoising_targets(valid: Column, width: int) -> Column:
    """The padding mask repeated for each feature."""
    return F.transform(valid, lambda v: F.array_repeat(v, width))


def compensate_masking(rows: DataFrame, columns: list[str], masks: list[str]) -> DataFrame:
    """Each feature scaled by the number of features over the number of unmasked ones (at least 1)."""
    active = F.lit(0)
    for m in masks:
        active = active + F.col(m)
    factor = F.lit(float(len(columns))) / F.greatest(active, F.lit(1))
    return rows.withColumns({c: F.col(c) * factor for c in columns})


def training_view(
    task: str, clean: DataFrame, noisy: DataFrame, columns: list[str], share: float, seed: int = 42,
    masks: DataFrame | None = None, coordinates: tuple[DataFrame, DataFrame] | None = None, disable_mask: bool = False,
) -> DataFrame:
    """The rows a task trains on, one per sample, step and copy.

    ``classification`` gives inputs and the label. ``denoising`` gives inputs and
    clean targets, every sample twice with its own draw of clean or noisy input.
    ``imputation`` adds masks; ``denoising_imputation`` may replace them by ones.
    ``dual_branch`` gives coordinates beside features, both clean or both noisy.
    """
    keys = SEGMENT
    on = [*keys, "pos"]
    labels = clean.select(*on, "label")
    if task == "classification":
        mixed = mix_clean_noisy(clean, noisy, keys, columns, share, seed)
        return mixed.join(labels, on)
    if task == "dual_branch":
        both = [hybrid(c, f) for c, f in zip(coordinates, (clean.select(*on, *columns), noisy.select(*on, *columns)))]
        return mix_clean_noisy(both[0], both[1], keys, ["lat", "lon", *columns], share, seed).join(labels, on)
    if task not in ("denoising", "imputation", "denoising_imputation"):
        raise ValueError(f"unknown task {task}")
    twice = clean.select(*on, *columns, F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    other = noisy.select(*on, *[F.col(c).alias(f"_n_{c}") for c in columns])
    take = draw(seed, *keys, "copy", purpose=41) < share
    rows = twice.join(other, on).select(
        *on, "copy", *[F.when(take, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(f"input_{c}") for c in columns],
        *[F.col(c).alias(f"target_{c}") for c in columns],
    )
    if task == "denoising":
        return rows
    if disable_mask:
        return rows.withColumns({f"mask_{c}": F.lit(1) for c in columns})
    return rows.join(masks.select(*on, *[F.col(c).alias(f"mask_{c}") for c in columns]), on)
