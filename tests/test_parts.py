"""Golden cases, NumPy helpers, noise and augmentation properties, log files."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripmill.functions import numeric
from tripmill.operators import augment, density, evaluate, extract, masks, noise, resample
from tripmill.schema import POINTS
from tripmill.sources import logs, tables


def test_top_k_golden(spark):
    rows = spark.createDataFrame([(1, [1, 5, 4]), (0, [2, 0, 3])], "y_true int, ranked array<int>")
    got = {r["k"]: r["accuracy"] for r in evaluate.top_k_accuracy(rows, 3, ranked="ranked").collect()}
    assert got == {1: 0.5, 2: 1.0, 3: 1.0}


def test_grid_peaks_golden():
    grid = np.zeros((7, 7))
    grid[3, 4], grid[3, 2] = 1, 1.5
    assert numeric.local_peaks(grid, 1).tolist() == [[3, 2], [3, 4]]
    assert numeric.local_peaks(grid, 2).tolist() == [[3, 2]]


def test_repeated_peaks_end():
    assert len(numeric.repeated_peaks(np.zeros((9, 9)), 5, 9)) == 0
    grid = np.zeros((9, 9))
    grid[4, 4] = 1
    assert numeric.repeated_peaks(grid, 5, 9).tolist() == [[4, 4]]


def test_smoothing_over_cells_equals_direct():
    rng = np.random.default_rng(0)
    x, y, axis = rng.random(30) * 90, rng.random(30) * 90, np.linspace(-5, 95, 60)
    wide = numeric.kernel_2d("epa", 9.0, axis[1] - axis[0])
    r = len(wide) // 2
    assert r > 8
    cells = numeric.binned_density(x, y, axis, np.array([[1.0]])) * len(x)
    direct = np.zeros_like(cells)
    padded = np.pad(cells, r)
    for i in range(2 * r + 1):
        for j in range(2 * r + 1):
            direct += wide[i, j] * padded[i : i + 60, j : j + 60]
    assert np.allclose(numeric.binned_density(x, y, axis, wide), direct / len(x), atol=1e-12)


def test_cubic_reproduces_cubics():
    x = np.array([0.0, 1.0, 2.5, 3.0, 4.2, 6.0])
    at = np.linspace(0, 6, 41)
    poly = np.poly1d([0.3, -1.0, 0.5, 2.0])
    assert np.allclose(resample.not_a_knot(x, poly(x), at), poly(at), atol=1e-10)


def test_change_points_find_steps():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(m, 0.05, 20) for m in (0, 5, 0, 5)])
    assert numeric.change_points_fixed(values, 3) == [20, 40, 60, 80]
    ends = numeric.change_points_penalised(values, 1.0)
    assert {20, 40, 60, 80} <= set(ends)


def brute_cost(values, i, j):
    return numeric.rbf_costs(values)[i, j]


def test_change_points_are_optimal():
    rng = np.random.default_rng(2)
    values = rng.normal(0, 1, 14)
    cost = numeric.rbf_costs(values)
    best = min(
        cost[0, a] + cost[a, b] + cost[b, 14]
        for a in range(4, 13, 2) for b in range(a + 4, 13, 2) if 14 - b >= 3
    )
    ends = numeric.change_points_fixed(values, 2)
    got = sum(cost[i, j] for i, j in zip([0, *ends], ends))
    assert math.isclose(got, best)


@pytest.mark.parametrize("series,want", [
    ([0, 1, 2, 1, 0, 1, 3, 1], {2, 6}),  # two maxima
    ([1, 1, 1, 1], None),  # level: no change at all
    ([0, 1, 2, 3], None),  # rising: none either
])
def test_extremes(spark, series, want):
    rows = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(series)], "g int, pos int, x double")
    out = masks.mark_extremes(rows, ["g"], "pos", "x").collect()
    if want is None:
        assert {r["changes"] for r in out} == {0}
    else:
        assert {r["pos"] for r in out if r["extreme"]} == want


def segments(spark, n_segments=30, n=40):
    rows = [
        (i, 0, k, i % 5, 5.0 * k, 40 + 1e-4 * k, 116 + 1e-4 * (k % 7), n if i % 3 else n // 3)
        for i in range(n_segments) for k in range(n if i % 3 else n // 3)
    ]
    return spark.createDataFrame(rows, "trj_id long, seg_id long, pos int, label int, t double, lat double, lon double, n_points int")


def test_missing_runs_keep_ten_points(spark):
    seg = segments(spark)
    out = noise.drop_runs(seg, 1.0, 42)
    sizes = {r["trj_id"]: r["count"] for r in out.groupBy("trj_id").count().collect()}
    rate = {0: 0.05, 1: 0.08, 2: 0.15, 3: 0.12, 4: 0.20}
    for i, left in sizes.items():
        n = 40 if i % 3 else 13
        lost = max(0, min(int(n * min(0.4, rate[i % 5] * 3)), n - 10))
        assert left == n - lost >= 10
    assert out.where("pos < 0 OR pos >= n_points").count() == 0


def test_noise_ignores_partitions_and_stays_in_range(spark):
    seg = segments(spark)
    for change in (noise.add_drift, noise.drop_runs, noise.add_outliers):
        one, many = change(seg.repartition(1), 0.5, 7), change(seg.repartition(8), 0.5, 7)
        assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0
        assert one.where("abs(lat) > 90 OR abs(lon) > 180").count() == 0
        assert change(seg, 0.0, 7).exceptAll(seg).count() == 0


def test_sweep_has_sixteen_sets(spark):
    seg = segments(spark)
    out = noise.noise_sweep(seg).groupBy("noise_config").agg(F.countDistinct("trj_id").alias("n"), F.count("*").alias("rows")).collect()
    assert len(out) == 16 and {r["n"] for r in out} == {30}
    assert all(r["rows"] == seg.count() for r in out if r["noise_config"].endswith("_0_percent"))


def trips(spark, sizes):
    rows = [(i, k, label, 100.0 + 5 * k, 10 + 0.01 * k, 20 + 0.02 * k * (i + 1)) for i, (label, n) in enumerate(sizes) for k in range(n)]
    return spark.createDataFrame(rows, POINTS)


def test_balance_golden(spark):
    labels = [0] * 26 + [1] * 11 + [2] * 11
    p = trips(spark, [(c, 12) for c in labels])
    draws = augment.balance_draws(p.where("k = 0").select("trj_id", "label"))
    counts = {r["label"]: r["count"] for r in draws.groupBy("label").count().collect()}
    assert counts == {1: 15, 2: 15}
    assert draws.select("label", "copy").distinct().count() == 30


def test_augmented_copies_follow_methods_in_order(spark):
    """Each copy equals its trip with the drawn methods applied one after the other."""
    p = trips(spark, [(0, 25), (1, 8), (1, 30)])
    source = {i: np.array([(r["t"], r["lat"], r["lon"]) for r in p.where(F.col("trj_id") == i).orderBy("k").collect()]) for i in range(3)}
    draws = spark.createDataFrame([(i % 3, 1, c) for c, i in enumerate(range(24), 1)], "trj_id long, label int, copy long")

    def u(purpose):
        return noise.draw(42, "label", "copy", purpose=purpose)

    got = augment.augmented_copies(p, draws).toPandas()
    plan = draws.select("*", *[u(i).alias(f"u{i}") for i in [*range(80, 84), *range(90, 95), *range(100, 110)]]).collect()
    seen = set()
    for d in plan:
        x = source[d["trj_id"]].copy()
        order = [m for _, m in sorted(zip([d[f"u{i}"] for i in range(80, 84)], ["reverse", "rotate", "translate", "crop"]))]
        n = len(x)
        for m in order[: 1 + int(d["u90"] * 4)]:
            seen.add(m)
            if m == "reverse":
                x[:, 1:] = x[::-1, 1:]
            elif m == "translate":
                x[:, 1:] += -0.001 + 0.002 * np.array([d["u93"], d["u94"]])
            elif m == "crop" and n > 10:
                size = 10 + int(d["u91"] * (n - 9))
                start = int(d["u92"] * (n - size + 1))
                x = x[start : start + size].copy()
                x[:, 0] -= x[0, 0]
            elif m == "rotate":
                for i in range(10):
                    a = 2 * math.pi * d[f"u{100 + i}"]
                    y = x[:, 1:] @ np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]])
                    if (abs(y[:, 0]) <= 90).all() and (abs(y[:, 1]) <= 180).all():
                        x[:, 1:] = y
                        break
        mine = got[(got["copy"] == d["copy"]) & (got["trj_id"] == d["trj_id"])].sort_values("k")
        assert np.allclose(mine[["t", "lat", "lon"]].to_numpy(), x, atol=1e-9), order
    assert len(seen) == 4


def test_reverse_twice_is_identity(spark):
    p = trips(spark, [(0, 12), (1, 30)])
    assert augment.reverse(augment.reverse(p)).exceptAll(p).count() == 0


def test_hot_trip_meets_its_facts_in_blocks(spark):
    p = trips(spark, [(0, 100), (1, 5)])
    facts = augment.trip_sizes(p)
    assert augment.with_facts(p, facts, block=8).groupBy("trj_id").agg(F.count("*").alias("c"), F.max("n").alias("n")).where("c <> n").count() == 0


def test_asof_missing_is_null(spark):
    points = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("a", 20.0), ("b", 1.0)], "user string, t double")
    labels = spark.createDataFrame([("a", 2.0, 6.0, 0), ("a", 10.0, 20.0, 3)], "user string, start_time double, end_time double, label int")
    got = {(r["user"], r["t"]): r["label"] for r in extract.asof_label(points, labels, "user").collect()}
    assert got == {("a", 1.0): None, ("a", 5.0): 0, ("a", 20.0): None, ("b", 1.0): None}


def test_log_files(spark, tmp_path):
    user = tmp_path / "010" / "Trajectory"
    os.makedirs(user)
    head = "Trajectory\nWGS 84\nAltitude is in Feet\nReserved 3\n0,2,255,My Track,0,0,2,8421376\n0\n"
    (user / "a.plt").write_text(head + "39.9,116.3,0,492,39744.1,2008-10-24,02:09:59\n39.8,-116.4,0,-777,39744.2,2008-10-24,02:10:00\n")
    (tmp_path / "010" / "labels.txt").write_text("Start Time\tEnd Time\tTransportation Mode\n2008/10/24 02:09:00\t2008/10/24 02:09:59\ttaxi\n2008/10/24 02:00:00\t2008/10/24 03:00:00\tboat\n")
    (tmp_path / "011" / "Trajectory").mkdir(parents=True)
    (tmp_path / "011" / "Trajectory" / "b.plt").write_text(head + "1.0,2.0,0,3,39744.1,2008-10-24,02:09:59\n")
    points = logs.read_plt(spark, f"{tmp_path}/*/Trajectory/*.plt")
    labels = logs.read_labels(spark, f"{tmp_path}/*/labels.txt")
    assert {(r["user"], r["lat"], r["t"]) for r in points.collect()} == {("010", 39.9, 1224814199.0), ("010", 39.8, 1224814200.0), ("011", 1.0, 1224814199.0)}
    assert {(r["user"], r["mode"], r["label"]) for r in labels.collect()} == {("010", "taxi", 3), ("010", "boat", 7)}
    kept = extract.use_modes(labels, [0, 1, 2, 3, 4]).withColumn("trj_id", F.monotonically_increasing_id())
    found = extract.interval_trips(points, kept.drop("mode"), "user", keep=["user", "lat", "label"]).collect()
    assert [(r["user"], r["lat"], r["label"]) for r in found] == [("010", 39.9, 3)]
    flags = {r["user"]: r["has_labels"] for r in logs.read_user_points(points, labels).collect()}
    assert flags == {"010": True, "011": False}


def test_records_append(spark, tmp_path):
    path = str(tmp_path / "records")
    tables.append_record(spark, path, "r1", "a", {"accuracy": 0.5}, {"accuracy": 0.4})
    tables.append_record(spark, path, "r2", "b", {"accuracy": 0.7})
    wide = tables.records_wide(spark.read.parquet(path), ["Best accuracy", "Final accuracy"])
    assert {(r[0], r[2], r[3]) for r in wide.collect()} == {("r1", 0.5, 0.4), ("r2", 0.7, None)}


def test_grid_densities_leave_python_few_at_a_time(spark, monkeypatch):
    """A batch of many segments must not become one batch of all their grids."""
    sizes = spark.sparkContext.accumulator(0)
    kind = type(spark.range(1))
    plain = kind.mapInArrow

    def watched(self, fn, schema):
        def counted(batches):
            for out in fn(batches):
                sizes.add(1)
                yield out

        return plain(self, counted, schema)

    monkeypatch.setattr(kind, "mapInArrow", watched)
    rows = spark.range(0, 400, 1, 1).selectExpr("if(id < 8, null, id div 4) AS trj_id", "id % 4 AS pos", "id % 7 * 1.0 AS lon", "id % 5 * 1.0 AS lat")
    assert density.kde_grid(rows, ["trj_id"], 0.5, bins=6).groupBy("trj_id").count().where("count = 36").count() == 99
    assert sizes.value >= 99 / 32
