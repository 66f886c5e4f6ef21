"""Points to steps against plain Python, and long or hot trips through blocks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripmill.operators import clean, motion, scan, segment
from tripmill.schema import POINTS

MINUTE = 60.0


def frame(spark, trips):
    """Trips as {id: (label, [(t, lat, lon), ...])}."""
    rows = [(i, k, label, float(t), float(a), float(o)) for i, (label, pts) in trips.items() for k, (t, a, o) in enumerate(pts)]
    return spark.createDataFrame(rows, POINTS)


def in_range(p):
    return -90 <= p[1] <= 90 and -180 <= p[2] <= 180


def dropped(points):
    """The places to drop, walking the points one by one."""
    bad = set()
    for i in range(len(points) - 1):
        base = points[i - 1] if i in bad else points[i]
        after = points[i + 1]
        if after[0] - base[0] <= 0:
            bad.add(i + 1)
        elif not in_range(base):
            bad.add(i)
        elif not in_range(after):
            bad.add(i + 1)
    return bad


def random_trip(rng, n):
    t, pts = 0.0, []
    for _ in range(n):
        t += rng.choice([5, 5, 5, -7, 0, 20, -12])
        pts.append((t, rng.choice([40.0, 40.1, 40.2, 95.0]), rng.choice([116.0, 116.1, 200.0, 116.2])))
    return pts


@pytest.mark.parametrize("block", [65536, 8, 3])
def test_valid_points_walk(spark, block):
    rng = random.Random(block)
    trips = {i: (0, random_trip(rng, rng.randint(8, 60))) for i in range(40)}
    want = set()
    for i, (_, pts) in trips.items():
        kept = [k for k in range(len(pts)) if k not in dropped(pts)]
        if len(pts) >= 10 and len(kept) >= 10:
            want |= {(i, k) for k in kept}
    got = {(r[0], r[1]) for r in clean.valid_points(frame(spark, trips), block=block).select("trj_id", "k").collect()}
    assert got == want and want


def chunks(n, size=200, minimum=10):
    out, start = [], 0
    if n <= size:
        return [n]
    while n - start > size:
        out.append(size)
        start += size
    return out + ([n - start] if n - start > minimum else [])


@pytest.mark.parametrize("n", [9, 200, 201, 210, 211, 400, 410, 411])
@pytest.mark.parametrize("block", [65536, 64])
def test_chunk_sizes(spark, n, block):
    trips = {0: (0, [(5.0 * k, 40.0, 116.0) for k in range(n)])}
    out = segment.cut_segments(frame(spark, trips), block=block)
    sizes = [r["count"] for r in out.groupBy("seg_id").count().orderBy("seg_id").collect()]
    assert sizes == chunks(n)


@pytest.mark.parametrize("gap,parts", [(1200.0, 1), (1200.001, 2)])
def test_stay_gap(spark, gap, parts):
    trips = {0: (0, [(0.0, 40.0, 116.0), (gap, 40.0, 116.0)])}
    assert segment.mark_stays(frame(spark, trips)).select("stay_id").distinct().count() == parts


def test_hot_trip_in_blocks(spark):
    """One trip holds a third of all points; blocks give the rows that one window gives."""
    rng = random.Random(7)
    trips = {i: (i % 5, random_trip(rng, 40)) for i in range(50)}
    trips[99] = (3, random_trip(rng, 1000))
    trips = {i: (label, [(t + 1500.0 * (k // 37), a, o) for k, (t, a, o) in enumerate(pts)]) for i, (label, pts) in trips.items()}
    points = frame(spark, trips)
    one = segment.cut_segments(clean.valid_points(points), size=20)
    many = segment.cut_segments(clean.valid_points(points, block=16), size=20, block=16)
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0 and one.count() > 0


def test_steps_remember_accepted_only(spark):
    rng = np.random.default_rng(3)
    trips = {i: (i % 5, [(5.0 * k, 40 + a, 116.0) for k, a in enumerate(np.cumsum(rng.random(30) * 6e-4))]) for i in range(10)}
    seg = segment.cut_segments(frame(spark, trips))
    rows = motion.step_features(seg).orderBy("trj_id", "pos").collect()
    speed, acc = motion.SPEED_LIMIT_5, motion.ACC_LIMIT_5
    seen = {}
    for r in rows:
        v0, h0 = seen.get(r["trj_id"], (0.0, 0.0))
        a = (r["velocity"] - v0) / r["delta_t"]
        assert math.isclose(r["acceleration"], a, abs_tol=1e-12)
        assert math.isclose(r["jerk"], a / r["delta_t"], abs_tol=1e-12)
        assert math.isclose(r["heading_change"], abs(r["heading"] - h0), abs_tol=1e-12)
        ok = r["velocity"] <= speed[r["label"]] and abs(a) <= acc[r["label"]]
        assert r["accepted"] == ok
        if ok:
            seen[r["trj_id"]] = (r["velocity"], r["heading"])
    assert {r["accepted"] for r in rows} == {True, False}


def test_step_options(spark):
    trips = {0: (3, [(5.0 * k, 40 + 1e-4 * (k % 2), 116 + 1e-4 * k) for k in range(12)])}
    seg = segment.cut_segments(frame(spark, trips))
    rows = motion.step_features(seg, true_jerk=True, wrap_heading=True).orderBy("pos").collect()
    assert max(r["heading_change"] for r in rows) <= 180
    for a, b in zip(rows, rows[1:]):
        if a["accepted"] and b["accepted"]:
            assert math.isclose(b["jerk"], (b["acceleration"] - a["acceleration"]) / b["delta_t"], abs_tol=1e-12)


def test_percentiles_exact_under_skew(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([np.full(4000, 7.25), rng.normal(0, 1e3, 6000), rng.random(2000) * 1e-6])
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(7)
    shares = [0.0, 0.01, 0.25, 0.5, 0.734, 0.99, 1.0]
    for margin in (None, 1e-12):  # brackets of almost no width are widened until they hold
        got = scan.exact_percentiles(df, ["x"], shares, 100, margin)
        for s in shares:
            assert math.isclose(got["x", s], np.percentile(values, 100 * s), rel_tol=1e-12, abs_tol=1e-15)


def test_hash_rank_is_a_permutation_and_ignores_partitions(spark):
    df = spark.range(5000).withColumn("label", F.when(F.col("id") % 3 == 0, 0).otherwise((F.col("id") % 7).cast("int")))
    one = scan.hash_rank(df.repartition(1), ["id"], 5, ["label"], total="n")
    many = scan.hash_rank(df.repartition(8), ["id"], 5, ["label"], total="n")
    assert one.exceptAll(many).count() == 0
    bad = one.groupBy("label").agg(F.countDistinct("rnk").alias("d"), F.max("rnk").alias("m"), F.max("n").alias("n"), F.count("*").alias("c"))
    assert bad.where("d <> c OR m <> c OR n <> c").count() == 0


def test_ordered_rank_over_one_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise((F.col("id") % 5).cast("int")).alias("g"), ((F.col("id") * 7919) % 3001).alias("v"))
    out = scan.ordered_rank(df, ["g"], ["v"], running={"s": F.col("v")}, total="n").toPandas().sort_values(["g", "v"])
    for _, part in out.groupby("g"):
        assert part["rnk"].tolist() == list(range(1, len(part) + 1))
        assert part["s"].tolist() == part["v"].cumsum().tolist()
        assert set(part["n"]) == {len(part)}
