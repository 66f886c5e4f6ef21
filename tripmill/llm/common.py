"""Text rules, vectorised hashing and Arrow plumbing shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 16  # text handled at once inside a task, so that its arrays stay in the cache; a longer text is a slice of its own
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_LOW = np.uint64(0xFFFFFFFF)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves remainder 0 by 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def match_rows(docs: DataFrame, listed: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of whole rows with ``listed`` (``_id``, ``_th``: id and hash of the text); null ids match null ids.

    The row is one struct during the join, so its column names cannot clash.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    same = F.expr("_row.doc_id <=> _id and hash(_row.text) = _th")
    return rows.join(listed, same, how).select("_row.*")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` texts, unless the session sets fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Map each Arrow batch to at most one batch of ``schema``; tasks hold one batch at a time."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column without nulls, end to end, and the n + 1 offsets of its rows."""
    if column.null_count:
        raise ValueError("texts must not be null here")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``size`` bytes; a longer row is a range of its own."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(rows, max(end, at + 1))
        yield at, end
        at = end


def mix(a: np.ndarray, b: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit mixture of two arrays of unsigned 64-bit values."""
    x = a * _A
    x ^= x >> np.uint64(29)
    x += b * _B + np.uint64(seed * int(_C) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(32)
    x *= _C
    x ^= x >> np.uint64(30)
    return x


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` values, by doubling: two halves make a whole."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    h, size = mix(values.astype(np.uint64), np.uint64(width) * np.ones(1, np.uint64)), 1
    while size * 2 <= width:
        h = mix(h[:-size], h[size:], size + 1)
        size *= 2
    rest = width - size
    return mix(h[:-rest], h[rest:], width + 1) if rest else h


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values: running minima from both ends of blocks of that width."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    after = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    before = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(before[: n - width + 1], after[width - 1: n])


def with_position(hashes: np.ndarray) -> np.ndarray:
    """High half of each hash, position in the low half: a minimum then names the leftmost smallest."""
    return (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)


def position_of(keys: np.ndarray) -> np.ndarray:
    return (keys & _LOW).astype(np.int64)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, end to end."""
    total = int(lengths.sum())
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) if len(lengths) else 0
    return np.arange(total) + first


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def kept_ranges(n: int, runs: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], int, int]:
    """Ranges of 0..n outside the union of ``runs`` (half-open), the number removed, and the maximal removed runs."""
    kept, at, removed, groups = [], 0, 0, 0
    for start, end in sorted(runs):
        if start > at or groups == 0:
            kept.append((at, start))
            groups += 1
            removed += end - start
            at = end
        elif end > at:
            removed += end - at
            at = end
    kept.append((at, n))
    return [x for x in kept if x[0] < x[1]], removed, groups
