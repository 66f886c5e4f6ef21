"""Extremes and masks of many series of a segment at once.

A segment is packed once, one array per series, and NumPy takes a series of all
segments of a batch together, so that nothing is unpivoted and no series needs
a window. Places are numbered 0, 1, 2, ... and a segment is bounded (200 points);
``operators.masks`` has the same for series of any length. A null value has no
slope to its neighbours and is no extreme.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tripmill.operators.motion import _ragged


def _per_series(rows: DataFrame, keys: list[str], order: str, values: list[str], work: Callable) -> DataFrame:
    """``keys``, ``order`` and per series the whole numbers that ``work`` makes of (values, sizes), padded matrices."""

    @arrow_udf(T.ArrayType(T.IntegerType()))
    def run(series: pa.Array) -> pa.Array:
        n = series.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        width = int(n.max()) if len(n) else 0
        out = work(_ragged(series, width), n)
        offsets = np.concatenate([[0], n.cumsum()]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out[np.arange(width) < n[:, None]].astype(np.int32)))

    packed = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(order, *[F.col(c).cast("double").alias(c) for c in values]))).alias("s"))
    found = packed.select(*keys, F.col(f"s.{order}").alias(order), *[run(F.col(f"s.{c}")).alias(c) for c in values])
    return found.select(*keys, F.inline(F.arrays_zip(order, *values)).alias(order, *values))


def _extremes(x: np.ndarray, kind: str | None = "max") -> tuple[np.ndarray, np.ndarray]:
    """Which places are extremes, and how often the sign of the slope changes; see ``masks.mark_extremes``."""
    rows, width = x.shape
    sign = np.full((rows, width + 1), np.nan)
    sign[:, 1:width] = np.sign(x[:, 1:] - x[:, :-1])  # of the step that starts one place before
    known = ~np.isnan(sign)
    last = width - np.argmax(known[:, ::-1], axis=1)
    sign[:, 0] = np.where(known.any(axis=1), sign[np.arange(rows), last], np.nan)
    now, before = sign[:, 1:], sign[:, :-1]
    change = (now != before) & ~np.isnan(now) & ~np.isnan(before)
    nth = change.cumsum(axis=1)
    changes = nth[:, -1] if width else np.zeros(rows, dtype=np.int64)
    kept = change
    if kind is not None:
        first, second = (np.where(changes >= i, x[np.arange(rows), np.argmax(nth == i, axis=1)], np.nan) for i in (1, 2))
        start = np.where(first < second if kind == "max" else first > second, 2, 1)[:, None]
        kept = change & ((changes == 1)[:, None] | ((nth >= start) & ((nth - start) % 2 == 0)))
    kept = kept.copy()
    kept[:, :1] = False
    return kept, changes


def _around(centre: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Places within ``length`` of a centre; a window at an end covers that end."""
    width, half = centre.shape[1], length // 2
    place, n = np.arange(width), n[:, None]
    at_start, at_end = place - half <= 0, (place - half > 0) & (place + half >= n)
    covered = np.zeros_like(centre)
    plain = centre & ~at_start & ~at_end
    for shift in range(-half, length - half):
        low, high = max(0, -shift), width - max(0, shift)
        if low < high:
            covered[:, low + shift: high + shift] |= plain[:, low:high]
    covered |= (centre & at_start).any(axis=1)[:, None] & (place < length)
    return covered | ((centre & at_end).any(axis=1)[:, None] & (place >= n - length))


def _spaced(first: float, last: float, count: int) -> list[int]:
    """``count`` whole places from ``first`` to ``last`` in even steps, truncated."""
    return [int(last) if count > 1 and j == count - 1 else int(first + j * ((last - first) / (count - 1)) if j else first) for j in range(count)]


def _even_places(x: np.ndarray, n: int, length: int) -> np.ndarray:
    """Evenly spaced places of a series without a slope change, masked around."""
    series = x[:n][~np.isnan(x[:n])]
    if len(series) and series.std() < 1e-6:
        places = _spaced(0.0, n - 1, max(2, int(n * 0.1)))
    else:
        places = [0, *_spaced(float(length), n - length, max(1, n // length - 2)), n - 1]
    covered = np.zeros(len(x), dtype=bool)
    for p in places:
        covered[max(0, int(p - length / 2)): max(0, min(n, int(p + length / 2)))] = True
    return covered


def extreme_places(rows: DataFrame, keys: list[str], order: str, values: list[str], kind: str | None = "max") -> DataFrame:
    """1 at the extremes of each series, as ``masks.mark_extremes`` finds them."""
    return _per_series(rows, keys, order, values, lambda x, n: _extremes(x, kind)[0])


def lowest_places(rows: DataFrame, keys: list[str], order: str, values: list[str], most: int, kind: str | None = "max") -> DataFrame:
    """1 at what ``masks.lowest_extremes`` chooses of each series."""

    def work(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        found, changes = _extremes(x, kind)
        by_value = np.argsort(np.where(found, x, np.inf), axis=1, kind="stable")
        lowest = np.zeros_like(found)
        np.put_along_axis(lowest, by_value[:, :most], True, axis=1)
        step, place = (n // (most + 1))[:, None], np.arange(x.shape[1])
        spaced = (step > 0) & (place % np.maximum(step, 1) == 0) & (place > 0) & (place <= step * most)
        chosen = np.where((found.sum(axis=1) >= most)[:, None], found & lowest, spaced)
        return chosen & (changes > 0)[:, None]

    return _per_series(rows, keys, order, values, work)


def extreme_masks(rows: DataFrame, keys: list[str], order: str, values: list[str], length: int = 2) -> DataFrame:
    """One mask per series, 0 around its maxima, as ``masks.extreme_mask`` gives for one series."""

    def work(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        found, changes = _extremes(x)
        covered = _around(found, n, length)
        for i in np.flatnonzero(changes == 0):
            covered[i] = _even_places(x[i], int(n[i]), length)
        return ~covered

    return _per_series(rows, keys, order, values, work)
