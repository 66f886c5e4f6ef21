"""Connected components by contraction, all tables distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmill.session import stage, unstage

LINKS = 1 << 17  # of a round in a task, so that the last rounds are few tasks
LEAST = 32  # tasks of a round
HELD = 1 << 20  # links met at once in a task


def labels(count: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For nodes 0, 1, ... with links ``u, v``: the smallest node that each reaches."""
    label = np.arange(count)
    while True:
        a, b = label[u], label[v]
        if np.array_equal(a, b):
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as ``u, v``: from the smallest of each component to its others."""
    names, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    label = labels(len(names), at[: len(u)], at[len(u):])
    far = np.flatnonzero(label != np.arange(len(names)))
    return names[label[far]], names[far]


def _fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links ``u, v`` of a task as stars, ``HELD`` links at a time."""

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*(np.concatenate(x) for x in zip(*held)))], names=["u", "v"])

    held, size = [], 0
    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy() for c in ("u", "v")))
        size += batch.num_rows
        if size >= HELD:
            yield emit()
            held, size = [], 0
    if size:
        yield emit()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges`` (``u, v`` bigint, in any direction, repeats and loops allowed).

    A task first draws its own links as stars around their smallest nodes. Each
    round every node then moves to the neighbour (or itself) that is first, and
    the links are drawn between the new places. Rounds take turns: by value, as a
    star falls together at once, and in a random order, which takes a constant
    share of the nodes of any graph. The tasks of a round follow the links left.
    Minima are partial sums, so a node with very many links is no single group.
    """
    def fewer(links: DataFrame) -> DataFrame:
        return stage(links.mapInArrow(_fewer, "u bigint, v bigint"), "edges")

    left = fewer(edges.where("u <> v").select("u", "v"))
    moves, tasks = [], []
    while rows := left.count():
        turn = len(moves)
        few = max(LEAST, -(-rows // LINKS))

        def rank(c: str):
            order = F.xxhash64(F.lit(turn), F.col(c)) if turn % 2 else F.lit(0).cast("bigint")
            return F.struct(order.alias("h"), F.col(c).alias("node"))

        read = left.coalesce(few)
        both = read.unionByName(read.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = both.groupBy("u").agg(F.min(rank("v")).alias("near")).coalesce(few)
        move = nearest.select(F.col("u").alias("node"), F.least("near", rank("u")).getField("node").alias("to"))
        move = stage(move, "moves")
        moves.append(move)
        tasks.append(few)
        a, b = (move.withColumnsRenamed({"node": c, "to": f"to_{c}"}) for c in ("u", "v"))
        drawn = read.join(a, "u").coalesce(few).join(b, "v").coalesce(few).where("to_u <> to_v")
        before, left = left, fewer(drawn.select(F.col("to_u").alias("u"), F.col("to_v").alias("v")))
        unstage(before)
    unstage(left)
    if not moves:
        return stage(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).where(F.lit(False)), "roots")
    roots = moves[0].withColumnRenamed("to", "root")
    for move in moves[1:]:
        step = move.withColumnsRenamed({"node": "root"})
        roots = roots.join(step, "root", "left").coalesce(tasks[0]).select("node", F.coalesce("to", "root").alias("root"))
    out = stage(roots, "roots")
    for move in moves:
        unstage(move)
    return out
