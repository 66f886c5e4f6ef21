"""Packed extremes and masks equal those by windows, over series of every shape."""

import random

import pytest
from pyspark.sql import functions as F

from tripmill.operators import masks, packed_masks


@pytest.fixture(scope="module")
def series(spark):
    draw = random.Random(5)
    rows = []
    for g in range(260):
        n = draw.choice([1, 2, 3, 4, 5, 7, 12, 30, 90, 200])
        shapes = {
            0: lambda i: float(i), 1: lambda i: 3.0, 2: lambda i: float(draw.randint(0, 3)), 3: lambda i: -2.0 * i,
            4: lambda i: draw.random(), 5: lambda i: None if draw.random() < 0.2 else float(draw.randint(0, 4)), 6: lambda i: float(min(i, n // 2)),
        }
        a, b = shapes[draw.randrange(7)], shapes[draw.randrange(7)]
        rows += [(None if g == 0 else g, i, a(i), b(i)) for i in range(n)]
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "g int, pos int, a double, b double").cache()


def by_feature(wide):
    return {(r["g"], r["pos"], r["feature"]): r["v"] for r in wide.unpivot(["g", "pos"], ["a", "b"], "feature", "v").collect()}


def long_rows(series):
    return series.unpivot(["g", "pos"], ["a", "b"], "feature", "x")


@pytest.mark.parametrize("kind", ["max", "min", None])
def test_extremes(series, kind):
    want = masks.mark_extremes(long_rows(series), ["g", "feature"], "pos", "x", kind).collect()
    got = by_feature(packed_masks.extreme_places(series, ["g"], "pos", ["a", "b"], kind))
    assert got == {(r["g"], r["pos"], r["feature"]): r["extreme"] for r in want} and 0 < sum(got.values()) < len(got)


@pytest.mark.parametrize("length", [1, 2, 3, 4, 7])
def test_masks(series, length):
    want = masks.extreme_mask(long_rows(series), ["g", "feature"], "pos", "x", length).collect()
    got = by_feature(packed_masks.extreme_masks(series, ["g"], "pos", ["a", "b"], length))
    assert got == {(r["g"], r["pos"], r["feature"]): r["mask"] for r in want}


def test_lowest(series):
    known = series.where("a is not null and b is not null")
    full = known.groupBy("g").agg(F.count("*").alias("n"), F.max("pos").alias("m")).where("n = m + 1").select(F.col("g").alias("_g"))
    whole = series.join(full, F.expr("g <=> _g")).drop("_g")
    want = masks.lowest_extremes(long_rows(whole), ["g", "feature"], "pos", "x", 3).collect()
    got = by_feature(packed_masks.lowest_places(whole, ["g"], "pos", ["a", "b"], 3))
    assert {k for k, v in got.items() if v} == {(r["g"], r["pos"], r["feature"]) for r in want} and want


def test_no_rows_and_one_exchange(series):
    empty = packed_masks.extreme_masks(series.limit(0), ["g"], "pos", ["a", "b"], 4)
    assert empty.columns == ["g", "pos", "a", "b"] and empty.isEmpty()
    plan = packed_masks.extreme_masks(series, ["g"], "pos", ["a", "b"], 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
