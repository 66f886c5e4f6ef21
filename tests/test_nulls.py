"""Null keys, null labels and repeated times: nothing is lost, and the way of large groups gives what the way of small ones does."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tripmill.operators import clean, density, extract, resample, segment, split


def same(a, b):
    assert a.columns == b.columns
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture(scope="module")
def points(spark):
    """Trips of 60 points; one trip id is null, some points have no number, some times repeat."""
    k = F.when(F.col("id") % 37 == 5, None).otherwise(F.col("id") % 60)
    return spark.range(240).select(
        F.when(F.col("id") >= 60, F.floor(F.col("id") / 60)).alias("trj_id"), k.alias("k"), F.lit(1).alias("label"),
        (F.col("id") * 10 + F.when(F.col("id") % 20 == 0, 2000).otherwise(0) - F.when(F.col("id") % 11 == 0, 10).otherwise(0)).cast("double").alias("t"),
        (F.when(F.col("id") % 17 == 0, 95.0).otherwise(40.0) + F.col("id") * 1e-4).alias("lat"), F.lit(116.0).alias("lon"))


def test_valid_points(points):
    dense = points.where("k is not null").withColumn(
        "k", F.row_number().over(Window.partitionBy("trj_id").orderBy("k")).cast("bigint") - 1)
    whole = clean.valid_points(dense, longest=60)
    same(whole, clean.valid_points(dense, longest=60, block=16))
    assert whole.where("trj_id is null").count() > 30


def test_stays_and_segments(points):
    whole = segment.mark_stays(points, longest=60)
    same(whole, segment.mark_stays(points, longest=60, block=16))
    assert whole.count() == points.where("k is not null").count()
    same(segment.cut_segments(points, longest=60), segment.cut_segments(points, longest=60, block=16))


def test_at_least(points):
    same(clean.at_least(points, ["trj_id"], 50, longest=60), clean.at_least(points, ["trj_id"], 50))
    assert clean.at_least(points, ["trj_id"], 50).count() == 240


def test_numbering(points):
    rows = points.select("trj_id", "t", "lat")
    same(extract.number_points(rows, ["trj_id"], ["t", "lat"]), extract.number_points(rows, ["trj_id"], ["t", "lat"], block=16))


def test_label_runs(spark):
    label = F.when(F.col("id") % 10 == 3, None).otherwise(F.floor(F.col("id") / 7) % 3)
    samples = spark.range(400).select(
        F.when(F.col("id") % 2 == 0, F.lit(7)).alias("user"), F.col("id").cast("double").alias("t"), label.alias("label"))
    whole = extract.label_runs(samples, "user", ["t"])
    same(whole, extract.label_runs(samples, "user", ["t"], block=16))
    assert whole.agg(F.sum("n")).first()[0] == 400 and whole.where("user is null").count() > 0


def test_asof_label(spark):
    points = spark.range(200).select(F.when(F.col("id") % 2 == 0, F.lit(7)).alias("user"), F.col("id").cast("double").alias("t"))
    labels = spark.createDataFrame(
        [(7, 10.0, 50.0, 1), (7, 50.0, 90.0, None), (None, 0.0, 120.0, 2), (None, 120.0, 121.0, 3)],
        "user int, start_time double, end_time double, label int")
    whole = extract.asof_label(points, labels, "user")
    same(whole, extract.asof_label(points, labels, "user", block=16))
    assert whole.count() == 200 and whole.where("user is null and label = 2").count() == 60


@pytest.mark.parametrize("make", [
    lambda rows: split.stratified_split(rows, ["id"]),
    lambda rows: split.repeated_split(rows, ["id"], 1, 0.2, label="label"),
    lambda rows: split.split_dataset(rows, ["id"], 0.2, test=0.1, label="label"),
])
def test_splits_keep_rows_without_label(spark, make):
    rows = spark.range(100).select("id", F.when(F.col("id") % 4 > 0, F.col("id") % 3).alias("label"))
    out = make(rows)
    assert out.count() == 100 and out.where("label is null").count() == 25
    assert out.where("label is null and split <> 'train'").count() > 0


def test_fill_over_blocks(spark):
    rows = spark.range(300).select(
        F.when(F.col("id") >= 100, F.floor(F.col("id") / 100)).alias("s"), (F.col("id") % 100).alias("k"),
        F.when((F.col("id") % 100 > 40) & (F.col("id") % 7 == 0), F.col("id").cast("double") ** 2).alias("v"))
    whole = resample.fill_linear(rows, ["s"], "k", "v")
    same(whole, resample.fill_linear(rows, ["s"], "k", "v", block=8))
    assert whole.count() == 300 and whole.where("v is null").isEmpty()


def test_shortest_interval_of_equal_values(spark):
    """Nine of ten values are equal, and one group is null."""
    rows = spark.range(1000).select(
        F.when(F.col("id") % 2 == 0, 1).alias("g"), F.when(F.col("id") % 20 < 18, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    got = {r.g: (r.hdi_min, r.hdi_max) for r in density.shortest_interval(rows, "v", ["g"], alpha=0.2).collect()}
    assert got == {1: (5.0, 5.0), None: (5.0, 5.0)}


def test_listed_test_ids_may_repeat_and_be_null(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (None, "b"), (4, "b")], "id int, label string")
    listed = spark.createDataFrame([(1,), (1,), (None,), (None,), (9,)], "id int")
    got = split.split_dataset(rows, ["id"], 0.5, 2, test=listed).collect()
    assert sorted((r["fold"], str(r["id"])) for r in got if r["split"] == "test") == [(0, "1"), (0, "None"), (1, "1"), (1, "None")]
    assert len(got) == 8
