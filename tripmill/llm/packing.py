"""Length buckets with the least padding, and batches of a token budget inside them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmill.session import stage

MAX_LENGTH = 4096  # tokens of a sequence; longer texts become several
BUCKETS = 16
BUDGET = 65536  # tokens of a batch, padding included
BLOCK_ROWS = 50_000  # sequences ranked in one task, about


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """At most ``buckets`` lengths, the largest included, such that rounding each length up to the next pads least.

    Dynamic programming over the distinct lengths: the least padding of the
    first j lengths in k buckets, over the place where the last bucket begins.
    Of equal choices the one with the longest last bucket is taken.
    """
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    n = np.concatenate(([0], np.cumsum(counts)))
    tokens = np.concatenate(([0], np.cumsum(counts * lengths)))
    m = len(lengths)
    least = np.concatenate(([0], lengths * n[1:] - tokens[1:]))  # one bucket
    choice = []
    for _ in range(1, min(buckets, m)):
        best, begin = least.copy(), np.zeros(m + 1, np.int64)
        for j in range(1, m + 1):
            padding = least[:j] + lengths[j - 1] * (n[j] - n[:j]) - (tokens[j] - tokens[:j])
            begin[j] = int(np.argmin(padding))
            best[j] = padding[begin[j]]
        least = best
        choice.append(begin)
    out, j = [int(lengths[-1])], m
    for begin in reversed(choice):
        j = int(begin[j])
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
    return out[::-1]


def pack(
    docs: DataFrame, tokens: Column | None = None, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = BUDGET
) -> DataFrame:
    """``doc_id, piece, n_tokens, bucket_length, batch`` for each sequence of each row of ``docs``.

    ``tokens`` counts the tokens of a row (default: words of ``text``). A row of
    more than ``max_length`` gives several pieces of that length and a rest; all
    tokens are kept. A row without tokens, null texts among them, gives one
    piece of 0 tokens without bucket or batch. Batches hold budget over bucket
    length sequences (at least one) and are numbered from 0 in each bucket, all
    full but the last; sequences go to them in the order of a hash. Repeated
    rows give repeated pieces. An empty table gives an empty table; other
    columns are left out.
    """
    n = (word_count() if tokens is None else F.coalesce(tokens, F.lit(0)).cast("bigint")).alias("n")
    rows = docs.select("doc_id", n, F.xxhash64("text").alias("h"))
    last = F.greatest(F.ceil(F.col("n") / max_length) - 1, F.lit(0))
    pieces = rows.select("doc_id", "h", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece")).select(
        "doc_id", F.col("piece").cast("int").alias("piece"),
        F.least(F.lit(max_length), F.col("n") - F.col("piece") * max_length).cast("bigint").alias("n_tokens"),
        F.xxhash64("doc_id", "piece", "h").alias("h"))
    pieces = stage(pieces, "pieces")
    histogram = {r["n_tokens"]: r["n"] for r in pieces.where("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    edges = boundaries(histogram, buckets)
    bucket = F.lit(None).cast("bigint")
    for edge in reversed(edges):
        bucket = F.when(F.col("n_tokens") <= edge, F.lit(edge).cast("bigint")).otherwise(bucket)
    placed = pieces.withColumn("bucket_length", F.when(F.col("n_tokens") > 0, bucket))
    blocks = max(1, math.ceil(sum(histogram.values()) / BLOCK_ROWS))
    full = placed.where("n_tokens > 0").withColumn("block", F.pmod("h", F.lit(blocks)))
    sizes = full.groupBy("bucket_length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket_length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket_length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket_length", "block").orderBy("h", "doc_id", "piece")
    ranked = full.withColumn("place", F.row_number().over(inside) - 1).join(offsets, ["bucket_length", "block"])
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_length")))
    batch = F.floor((F.col("before") + F.col("place")) / room).cast("bigint").alias("batch")
    columns = ["doc_id", "piece", "n_tokens", "bucket_length"]
    empty = placed.where("n_tokens = 0").select(*columns, F.lit(None).cast("bigint").alias("batch"))
    return ranked.select(*columns, batch).unionByName(empty)
