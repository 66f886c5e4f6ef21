"""Running values and exact ranks over groups too large for one task.

A window over a whole group puts that group in one task. Here a group is cut
into blocks; windows run inside (group, block), and one summary row per block
carries sums, maxima and last values from the blocks before it. A group that
holds a third of all rows is then spread over as many tasks as it has blocks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmill.functions.scalar import hash32
from tripmill.session import stage

BLOCK = 65536
RANK_BITS = 16


def with_neighbours(
    df: DataFrame, position: str, size: int = BLOCK, before: int = 1, after: int = 1
) -> DataFrame:
    """Cut a densely numbered group into blocks of ``size`` positions, edges shared.

    Adds ``blk`` and ``own``; the last ``before`` rows of a block are copied to
    the next block and the first ``after`` rows to the previous one, with
    ``own`` false, so that lag and lead inside a block see across its edges.
    """
    home = F.floor(F.col(position) / size)
    offset = F.pmod(F.col(position), F.lit(size))
    copies = F.array_compact(F.array(
        home,
        F.when(offset >= size - before, home + 1),
        F.when((offset < after) & (home > 0), home - 1),
    ))
    return (
        df.withColumn("_home", home)
        .withColumn("blk", F.explode(copies))
        .withColumn("own", F.col("blk") == F.col("_home"))
        .drop("_home")
    )


def row_count(columns: Sequence[str]) -> Column:
    """A row count that reads ``columns``.

    A summary over windowed rows then asks for the same columns as the rows
    themselves, so both use one shuffle instead of one each.
    """
    lowest = -(2**31)
    return F.sum(F.least(F.hash(*columns), F.lit(lowest)).cast("bigint") + F.lit(1 - lowest))


def with_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_key``, the keys as one struct, which is never null: rows with null keys are a group in joins too.

    Windows, sums and joins by ``_key`` and a block share one partitioning.
    """
    return df.withColumn("_key", F.struct(*keys) if keys else F.struct(F.lit(0).alias("all")))


def carry_over(
    df: DataFrame,
    keys: Sequence[str],
    block: str = "blk",
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
    merge: bool = False,
) -> DataFrame:
    """Join to each row aggregates over the earlier blocks of its group; null keys are a group of their own.

    Rows that have ``_key`` (``with_key``) already keep it and are not shuffled again for it.
    Values are aggregate expressions per block. ``sums`` adds them up (0 in the
    first block), ``maxima`` takes the largest, ``lasts`` the latest that is not
    null, and ``totals`` the sum over all blocks of the group. ``merge`` keeps the
    row per block off the driver, where blocks are as many as rows may be.
    """
    sums, maxima, lasts, totals = (x or {} for x in (sums, maxima, lasts, totals))
    keyed = df if "_key" in df.columns else with_key(df, keys)
    per_block = keyed.groupBy("_key", block).agg(
        *[agg.alias(name) for part in (sums, maxima, lasts, totals) for name, agg in part.items()]
    )
    group = Window.partitionBy("_key")
    earlier = group.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    everything = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = per_block.select(
        "_key", block,
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums],
        *[F.max(n).over(earlier).alias(n) for n in maxima],
        *[F.last(n, ignorenulls=True).over(earlier).alias(n) for n in lasts],
        *[F.sum(n).over(everything).alias(n) for n in totals],
    )
    joined = keyed.join(carried.hint("merge") if merge else carried, ["_key", block])
    return joined if keyed is df else joined.drop("_key")


def hash_rank(
    df: DataFrame, ids: Sequence[str], seed: int = 42, strata: Sequence[str] = (),
    rank: str = "rnk", total: str | None = None, salt: Column | None = None,
) -> DataFrame:
    """Exact 1-based rank of each row in a seeded random order, per stratum.

    Blocks are ranges of the hash, so they are even in size whatever the strata
    are, and a stratum has at most 2**16 of them.
    """
    parts = [seed, *([salt] if salt is not None else []), *[F.col(c) for c in ids]]
    keyed = df.withColumn("_h", hash32(*parts)).withColumn("_blk", F.shiftright("_h", 32 - RANK_BITS))
    inside = Window.partitionBy("_key", "_blk").orderBy("_h", *ids)
    local = with_key(keyed, strata).withColumn("_in_block", F.row_number().over(inside))
    count = F.count(F.lit(1))
    ranked = carry_over(
        local, strata, "_blk", sums={"_before": count}, totals={total: count} if total else None, merge=True
    )
    return ranked.withColumn(rank, F.col("_before") + F.col("_in_block")).drop("_h", "_blk", "_key", "_in_block", "_before")


def ordered_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: str = "blk") -> DataFrame:
    """Rows sorted over the cluster by key and order, with the partition they fell in as their block.

    A range partitioning cuts large groups wherever their rows lie, so blocks
    are even in size whatever the skew, if ``order`` has no large ties. The
    sorted rows are staged once: block numbers must not change between a
    summary and the join back to it.
    """
    return stage(df.orderBy(*keys, *order).withColumn(block, F.spark_partition_id()), "ordered")


def ordered_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rank: str = "rnk",
    running: dict[str, Column] | None = None, total: str | None = None,
) -> DataFrame:
    """Exact 1-based rank by value per key, with running sums in that order."""
    running = running or {}
    keys = list(keys)
    inside = Window.partitionBy("_key", "_blk").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = with_key(ordered_blocks(df, keys, order, "_blk"), keys).select(
        "*", F.row_number().over(inside).alias("_in_block"),
        *[F.sum(c).over(upto).alias(f"_run_{n}") for n, c in running.items()],
    )
    count = F.count(F.lit(1))
    ranked = carry_over(
        local, keys, "_blk",
        sums={"_before": count, **{f"_pre_{n}": F.sum(c) for n, c in running.items()}},
        totals={total: count} if total else None,
    )
    for name in running:
        ranked = ranked.withColumn(name, F.col(f"_pre_{name}") + F.col(f"_run_{name}"))
    temporary = ["_blk", "_key", "_in_block", "_before", *[f"_{p}_{n}" for n in running for p in ("pre", "run")]]
    return ranked.withColumn(rank, F.col("_before") + F.col("_in_block")).drop(*temporary)


def exact_percentiles(
    df: DataFrame, columns: Sequence[str], shares: Sequence[float], accuracy: int = 10000, margin: float | None = None
) -> dict[tuple[str, float], float]:
    """The linear-interpolated percentile of each column at each share.

    A sketch of bounded size brackets each wanted rank; then only the rows
    inside the bracket are counted by value and ranked, in blocks of equal value
    range, and those below it are counted. Exact, and no task or driver holds
    the column: the driver sees a few numbers per percentile. Should a bracket
    miss its rank, all are widened and ranked again.
    """
    margin = 2.0 / accuracy if margin is None else margin
    wanted = [(c, s) for c in columns for s in shares]
    sides = [min(1.0, max(0.0, s + side * margin)) for s in shares for side in (-1, 1)]
    sketch = df.agg(
        *[F.percentile_approx(F.col(c), sides, accuracy).alias(f"q_{c}") for c in columns],
        *[F.count(c).alias(f"n_{c}") for c in columns],
    ).first()
    if any(sketch[f"n_{c}"] == 0 for c in columns):
        return {}
    candidates, positions = [], []
    for i, (c, s) in enumerate(wanted):
        lo, hi = (float(sketch[f"q_{c}"][2 * shares.index(s) + side]) for side in (0, 1))
        place = F.floor((F.col(c) - lo) / (hi - lo) * 1024) if hi > lo else F.lit(0).cast("bigint")
        # Rows below the bracket share one null value in a block of their own.
        candidates.append(F.when(F.col(c) <= hi, F.struct(
            F.lit(i).alias("i"), F.when(F.col(c) >= lo, F.col(c).cast("double")).alias("v"),
            F.when(F.col(c) >= lo, place).otherwise(-1).alias("blk"))))
        positions.append((sketch[f"n_{c}"] - 1) * s)
    near = (
        df.select(F.explode(F.array_compact(F.array(*candidates))).alias("x")).select("x.*")
        .groupBy("i", "blk", "v").agg(F.count(F.lit(1)).alias("n"))
    )
    inside = Window.partitionBy("_key", "blk").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = carry_over(with_key(near, ["i"]).withColumn("_run", F.sum("n").over(inside)), ["i"], sums={"_before": F.sum("n")})
    through = F.col("_before") + F.col("_run")
    picks = []
    for i, position in enumerate(positions):
        low, high = math.floor(position), math.ceil(position)
        own = F.col("i") == i
        picks += [F.min(F.when(own & (through > edge), F.col("v"))) for edge in (low, high)]
        picks.append(F.max(F.when(own & F.col("v").isNull(), through)) > low)
    found = ranked.agg(*[p.alias(f"p{j}") for j, p in enumerate(picks)]).first()
    if any(found[3 * i + 1] is None or found[3 * i + 2] for i in range(len(wanted))):
        return exact_percentiles(df, columns, shares, accuracy, max(margin * 10, 1.0 / accuracy))
    return {
        key: found[3 * i] + (found[3 * i + 1] - found[3 * i]) * (positions[i] - math.floor(positions[i]))
        for i, key in enumerate(wanted)
    }
