"""Behaviour masks: 0 marks a masked place, 1 a kept one. A series is one segment of at most 200 places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_runs(rows: DataFrame, keys: list[str], order: str, flag: str, longer_than: int) -> DataFrame:
    """Runs of ones longer than ``longer_than``, as half-open ranges [``start``, ``end``)."""
    w = Window.partitionBy(*keys).orderBy(order)
    # Within a run of ones, place minus running number is constant.
    ones = rows.where(F.col(flag) == 1).withColumn("_island", F.col(order) - F.row_number().over(w))
    runs = ones.groupBy(*keys, "_island").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end"))
    return runs.where(F.col("end") - F.col("start") > longer_than).drop("_island")


def mark_extremes(rows: DataFrame, keys: list[str], order: str, value: str, kind: str | None = "max") -> DataFrame:
    """Add ``extreme`` and ``changes``, the number of slope sign changes of the series.

    The slope at the first place is compared with the last slope. A level slope
    is a sign of its own. For ``max`` or ``min`` every second change is kept,
    from the first or second on, whichever is higher or lower; a change at place
    0 counts for that choice and is then left out.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    sign = F.signum(F.lead(value).over(w) - F.col(value))
    before = F.when(F.col(order) == 0, F.last("_sign", ignorenulls=True).over(whole)).otherwise(F.lag("_sign").over(w))
    seen = (
        rows.withColumn("_sign", sign)
        .withColumn("_change", F.coalesce((F.col("_sign") != before).cast("int"), F.lit(0)))
        .withColumn("_nth", F.sum("_change").over(upto))
        .withColumn("changes", F.sum("_change").over(whole))
    )

    def nth(n: int) -> Column:
        return F.max(F.when((F.col("_change") == 1) & (F.col("_nth") == n), F.col(value))).over(whole)

    kept = F.col("_change") == 1
    if kind is not None:
        second = nth(1) < nth(2) if kind == "max" else nth(1) > nth(2)
        seen = seen.withColumn("_from", F.when(second, 2).otherwise(1))
        kept &= (F.col("changes") == 1) | ((F.col("_nth") >= F.col("_from")) & ((F.col("_nth") - F.col("_from")) % 2 == 0))
    return seen.withColumn("extreme", (kept & (F.col(order) > 0)).cast("int")).drop("_sign", "_change", "_nth", "_from")


def lowest_extremes(rows: DataFrame, keys: list[str], order: str, value: str, most: int, kind: str | None = "max") -> DataFrame:
    """At most ``most`` extremes by ascending value; a series with fewer gets evenly spaced places instead."""
    w = Window.partitionBy(*keys)
    marked = mark_extremes(rows, keys, order, value, kind).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn(
        "_have", F.sum("extreme").over(w)
    )
    ranked = marked.withColumn("_rank", F.row_number().over(w.orderBy(F.desc("extreme"), value, order)))
    step = F.floor(F.col("_n") / (most + 1))
    spaced = (step > 0) & (F.col(order) % step == 0) & (F.col(order) > 0) & (F.col(order) <= step * most)
    chosen = F.when(F.col("_have") >= most, (F.col("extreme") == 1) & (F.col("_rank") <= most)).otherwise(spaced)
    return marked_where(ranked, chosen, keys, order)


def marked_where(rows: DataFrame, condition: Column, keys: list[str], order: str) -> DataFrame:
    return rows.where(condition & (F.col("changes") > 0)).select(*keys, order)


def _spaced(first: Column, last: Column, count: Column) -> Column:
    """``count`` whole places from ``first`` to ``last`` in even steps, truncated."""
    step = (last - first) / (count - 1)

    def place(j: Column) -> Column:
        return F.when(count == 1, first).when(j == count - 1, last).otherwise(first + j * step).cast("int")

    return F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), place)


def window_mask(rows: DataFrame, keys: list[str], order: str, centre: str, length: int) -> Column:
    """0 within ``length`` places around each centre, else 1, as a Column over ``rows`` (``_n`` holds the length).

    A window that would start at or before place 0 covers the first ``length``
    places, one that would pass the end the last ``length``.
    """
    half = length // 2
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    i, n = F.col(order), F.col("_n")
    at_start = (F.col(centre) == 1) & (i - half <= 0)
    at_end = (F.col(centre) == 1) & (i - half > 0) & (i + half >= n)
    plain = (F.col(centre) == 1) & ~at_start & ~at_end
    covered = (
        F.max(plain).over(w.rowsBetween(half - length + 1, half))
        | (F.max(at_start).over(whole) & (i < length))
        | (F.max(at_end).over(whole) & (i >= n - length))
    )
    return F.when(covered, 0).otherwise(1)


def extreme_mask(rows: DataFrame, keys: list[str], order: str, value: str, length: int = 2) -> DataFrame:
    """Mask around the maxima of a series; evenly spaced places where it has no slope change."""
    whole = Window.partitionBy(*keys)
    marked = mark_extremes(rows, keys, order, value).withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn(
        "_std", F.stddev_pop(value).over(whole)
    )
    n, i = F.col("_n").cast("int"), F.col(order)
    level = _spaced(F.lit(0.0), (n - 1).cast("double"), F.greatest(F.lit(2), F.floor(n * 0.1).cast("int")))
    middle = F.greatest(F.lit(1), F.floor(n / length).cast("int") - 2)
    rising = F.concat(F.array(F.lit(0)), _spaced(F.lit(float(length)), (n - length).cast("double"), middle), F.array(n - 1))
    places = F.when(F.col("_std") < 1e-6, level).otherwise(rising)
    spaced = F.exists(places, lambda p: (i >= F.greatest(F.lit(0), (p - length / 2).cast("int"))) & (i < F.least(n, (p + length / 2).cast("int"))))
    mask = F.when(F.col("changes") > 0, window_mask(marked, keys, order, "extreme", length)).otherwise(F.when(spaced, 0).otherwise(1))
    return marked.withColumn("mask", mask).drop("extreme", "changes", "_n", "_std")


def random_mask(
    rows: DataFrame, keys: list[str], order: str, first: Column, second: Column, ratio: float = 0.15, length: int = 3
) -> DataFrame:
    """Random spans covering ``round(n * ratio)`` places per series.

    Starts are the places with the smallest ``first`` draw; overlaps are topped
    up with single places by ``second`` draw.
    """
    w = Window.partitionBy(*keys)
    n = F.col("_n")
    sized = (
        rows.withColumn("_n", F.count(F.lit(1)).over(w))
        .withColumn("_want", F.bround(n * F.lit(ratio)).cast("int"))
        .withColumn("_spans", F.greatest(F.lit(1), F.bround(F.col("_want") / length).cast("int")))
        .withColumn("_len", F.greatest(F.lit(1), F.bround(F.col("_want") / F.col("_spans")).cast("int")))
        .withColumn("_h1", first).withColumn("_h2", second)
    )
    can_start = F.col(order) <= n - F.col("_len")
    drawn = sized.withColumn("_can", can_start).withColumn(
        "_r1", F.row_number().over(w.orderBy(F.desc("_can"), "_h1", order))
    ).withColumn("_start", F.when(F.col("_can") & (F.col("_r1") <= F.col("_spans")), F.col(order)))
    latest = F.max("_start").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    spans = drawn.withColumn("_in", F.coalesce((F.col(order) - latest < F.col("_len")).cast("int"), F.lit(0)))
    filled = spans.withColumn("_have", F.sum("_in").over(w)).withColumn(
        "_r2", F.row_number().over(w.orderBy("_in", "_h2", order))
    )
    topped = (F.col("_in") == 1) | (F.col("_r2") <= F.col("_want") - F.col("_have"))
    short = n - F.col("_len") <= 0
    masked = F.when(short, F.col(order) < F.least(F.col("_want"), n)).otherwise(topped)
    extra = [c for c in filled.columns if c not in rows.columns]
    return filled.withColumn("mask", F.when(masked, 0).otherwise(1)).drop(*extra)


def stop_turn_mask(steps: DataFrame, keys: list[str], longer_than: int = 4) -> DataFrame:
    """Point mask from step flags: long runs of stops or turns with the point after them, and rejected steps.

    ``steps`` carries ``stop``, ``turn`` and ``accepted`` per step; the result
    has one more place than the series has steps.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    last = F.max("pos").over(Window.partitionBy(*keys)).alias("_last")
    places = F.when(F.col("pos") == F.col("_last"), F.array(F.col("pos"), F.col("pos") + 1)).otherwise(F.array("pos"))
    rows = steps.select(*keys, "pos", "stop", "turn", "accepted", last).withColumn("_p", F.explode(places))
    real = F.col("_p") == F.col("pos")
    rows = rows.select(
        *keys, F.col("_p").alias("pos"),
        *[F.when(real, F.col(c)).otherwise(0).alias(c) for c in ("stop", "turn")],
        (real & ~F.col("accepted")).alias("_rejected"),
    )
    masked = F.col("_rejected")
    for flag in ("stop", "turn"):
        island = f"_{flag}"
        rows = rows.withColumn(island, F.sum(1 - F.col(flag)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        size = F.sum(flag).over(Window.partitionBy(*keys, island))
        rows = rows.withColumn(f"_long_{flag}", (F.col(flag) == 1) & (size > longer_than))
        masked = masked | F.col(f"_long_{flag}") | F.coalesce(F.lag(f"_long_{flag}").over(w), F.lit(False))
    return rows.withColumn("_m", masked).select(*keys, "pos", F.when(F.col("_m"), 0).otherwise(1).alias("mask"))
