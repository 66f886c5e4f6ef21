"""The stored noise sets: values against the plain preparation, and a broken run that goes on."""

import os

from pyspark.sql import functions as F

from tripmill.operators import noise
from tripmill.plans import feature_tables as ft
from tripmill.plans.tables import VALUES
from tripmill.plans.trip_noise import clean_segments

SF = "/root/testdata/sf0.001"


def rows_of(df, columns):
    return sorted(tuple(r) for r in df.select("trj_id", "seg_id", "pos", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in columns]).collect())


def test_sets_are_stored_once_and_equal_the_preparation(spark, tmp_path, monkeypatch):
    segments, folder = clean_segments(spark, SF), str(tmp_path)
    monkeypatch.setattr(noise, "sweep_names", lambda: ["drift_0_percent", "missing_20_percent"])
    write, calls = ft.write_stage, []

    def breaks(df, path, **kw):
        calls.append(path)
        if len(calls) == 9:
            raise OSError("lost")
        write(df, path, **kw)

    monkeypatch.setattr(ft, "write_stage", breaks)
    try:
        ft.store_sweep(segments, folder, "test", at_once=1)
        raise AssertionError("the run should break")
    except OSError:
        pass
    assert ft.stored_sets(spark, folder, "test") == {"drift_0_percent"}
    monkeypatch.setattr(ft, "write_stage", write)
    assert ft.store_sweep(segments, folder, "test", at_once=1) == ["missing_20_percent"]
    assert ft.store_sweep(segments, folder, "test") == []
    plain = ft.feature_tables(segments)
    swept = noise.noise_sweep(segments).where("noise_config = 'missing_20_percent'")
    noisy = ft.feature_tables(swept.drop("noise_config"))
    for name, columns in VALUES.items():
        stored = ft.read_stored(spark, folder, name, "test")
        assert rows_of(stored.where("noise_config = 'drift_0_percent'"), columns) == rows_of(plain[name], columns)
        assert rows_of(stored.where("noise_config = 'missing_20_percent'"), columns) == rows_of(noisy[name], columns)
    listed = spark.read.parquet(f"{folder}/manifest").groupBy("name").count().collect()
    assert {r["name"]: r["count"] for r in listed} == dict.fromkeys(VALUES, 2)


def test_stage_tables_of_the_sets_are_deleted(spark, tmp_path, monkeypatch):
    """Those of the clean rows when the last table that reads them is written, the others at the end of the job."""
    made, held, write = [], {}, ft.write_stage
    stage = ft.stage

    def staged(df, name):
        out = stage(df, name)
        made.append((name, out.stage_path.removeprefix("file:")))
        return out

    def written(df, path, **kw):
        held[path.rsplit("/", 1)[-1]] = {n for n, p in made if os.path.exists(p)}
        write(df, path, **kw)

    monkeypatch.setattr(noise, "sweep_names", lambda: ["drift_0_percent"])
    monkeypatch.setattr(ft, "stage", staged)
    monkeypatch.setattr(ft, "write_stage", written)
    ft.store_sweep(clean_segments(spark, SF), str(tmp_path), "test")
    assert held["clean_features"] == {"sweep", "steps", "clean-features", "clean-points"}
    assert held["trj_masks"] == {"sweep", "steps", "clean-points"}
    assert not any(os.path.exists(p) for _, p in made)


def test_tasks_follow_the_number_of_points(spark, monkeypatch):
    """Every table comes in tasks of a bounded number of points, whatever the number of shuffle partitions, with the same rows."""
    from tripmill.plans import fixtures, motion_profile

    points = fixtures.points(spark, SF)
    plain = ft.feature_tables(motion_profile.segments_of(points))
    want = {name: rows_of(plain[name], columns) for name, columns in VALUES.items()}
    monkeypatch.setattr(motion_profile, "PART", 100, raising=False)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        segments = motion_profile.segments_of(points)
        assert segments.rdd.getNumPartitions() >= points.count() // 100
        tables = ft.feature_tables(segments)
        least = segments.count() // 100
        assert least > 2
        for name, columns in VALUES.items():
            assert tables[name].rdd.getNumPartitions() >= (1 if name in ("clean_features", "clean_points") else least), name  # these are read back from files
            assert rows_of(tables[name], columns) == want[name]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rows_that_sets_share_are_stored_once(spark, tmp_path, monkeypatch):
    """Every set reads whole, as where each is stored by itself (as with random masks), from far fewer rows; a run may go on with sets that change nothing."""
    names = ["drift_0_percent", "missing_0_percent", "drift_20_percent"]
    monkeypatch.setattr(noise, "sweep_names", lambda: names)
    segments = clean_segments(spark, SF)
    ft.store_sweep(segments, f"{tmp_path}/shared", "test", at_once=1)
    ft.store_sweep(segments, f"{tmp_path}/own", "test", trj_mask_mode="random")
    listed = {f: sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{f}/manifest").collect())) for f in ("shared", "own")}
    assert listed["shared"] == listed["own"] and len(listed["own"]) == 3 * len(VALUES)
    for name, columns in VALUES.items():
        whole = ft.read_stored(spark, f"{tmp_path}/shared", name, "test")
        alone = spark.read.parquet(f"{tmp_path}/own/{name}")
        assert {r["noise_config"] for r in alone.select("noise_config").distinct().collect()} == set(names)
        for set_ in names if name != "trj_masks" else ():
            of_set = F.col("noise_config") == set_
            assert rows_of(whole.where(of_set), columns) == rows_of(alone.where(of_set), columns), (name, set_)
        assert whole.count() == alone.count() > 2 * spark.read.parquet(f"{tmp_path}/shared/{name}").count() > 0, name


def test_shuffle_files_go_with_their_query(spark, tmp_path):
    from tripmill.session import shuffles_dropped

    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        return {str(files.getAllFiles().apply(i).getName()) for i in range(files.getAllFiles().size()) if "shuffle_" in files.getAllFiles().apply(i).getName()}

    before = shuffled()
    with shuffles_dropped(spark):
        spark.range(1000).repartition(3, "id").write.parquet(f"{tmp_path}/out")
    assert not shuffled() - before
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
