"""Text lines written in a folder per user."""

import glob

from pyspark.sql import functions as F

from tripmill.plans import files


def test_a_folder_has_as_many_files_as_its_lines_need(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "LINES", 100)
    rows = spark.range(600).select(
        F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 20 + 1).alias("user"), F.col("id").alias("event_id"), F.col("id").cast("string").alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_folders(rows, "user", f"{tmp_path}/out")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    small = [len(glob.glob(f"{tmp_path}/out/user={u}/part-*")) for u in range(1, 21)]
    assert small == [1] * 20
    assert 1 < len(glob.glob(f"{tmp_path}/out/user=0/part-*")) <= 4  # two salts may meet in one task
    assert sorted(int(r["value"]) for r in spark.read.text(f"{tmp_path}/out/*").collect()) == list(range(600))


def test_folders_are_those_of_sparks_writer(spark, tmp_path):
    """Names with signs, texts that are empty, missing or go over several batches, a file left half done; on a mounted folder and elsewhere."""
    from tripmill.sources import logs

    keys = ["a/b", "x=y %", "é[1]^", "plain", "'\"#:?*\\{}", None]
    rows = spark.createDataFrame([(keys[i % 6], i % 4 // 3, [None, "", "ü", "two words"][i % 7 % 4] if i % 7 < 4 else f"line {i}") for i in range(300)], "key string, part int, value string")
    rows.drop("part").write.partitionBy("key").text(f"{tmp_path}/want")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.folders.link./out", f"file://{tmp_path}")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        logs.write_texts(rows.repartition(3, "key", "part"), "key", "part", f"file://{tmp_path}/got 1%20")
        logs.write_texts(rows.repartition(3, "key", "part"), "key", "part", "viewfs://folders/out/far")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    (tmp_path / "got 1%20" / "key=plain" / ".half").write_text("lost\n")

    def held(name):
        return sorted((str(r["key"]), r["value"]) for r in spark.read.text(f"{tmp_path}/{name}").collect())

    folders = {p.name for p in (tmp_path / "want").glob("key=*")}
    assert {p.name for p in (tmp_path / "got 1%20").glob("key=*")} == folders and len(folders) == 6
    assert held("got 1%20") == held("far") == held("want") and len(held("want")) == 300
    assert {p.name for p in (tmp_path / "got 1%20").glob("key=*/part-*")} == {"part-00000.txt", "part-00001.txt"}


def test_small_files_cost_no_task_and_no_process_each(spark, tmp_path):
    """Tasks open their files themselves (Hadoop's local store starts a process per file and leaves a checksum file), and read many files each."""
    from tripmill.sources import logs

    rows = spark.range(600).selectExpr("id % 300 AS folder", "id AS event_id", "concat(id * 1500, ' ', id % 9, ' 0 0') AS value")
    files.write_folders(rows, "folder", f"{tmp_path}/labels")
    assert len(glob.glob(f"{tmp_path}/labels/*/part-*")) == 300 and not glob.glob(f"{tmp_path}/labels/*/.*")
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "4m")
    try:
        for path in (f"{tmp_path}/labels", f"{tmp_path}/labels/*"):
            read = logs.read_sensor_labels(spark, path)
            assert read.rdd.getNumPartitions() <= 24
            assert sorted(tuple(r) for r in read.collect()) == sorted((f"{i % 300}", i * 1.5, i % 9) for i in range(600))
    finally:
        spark.conf.set(name, before)


def test_sensor_files_are_opened_once(spark):
    """Samples are read for their folders and for their rows, after one pass over the files."""
    import __spark_entry__ as entry

    found = entry.queries()["sensor_samples"](spark, "/root/testdata/sf0.001")
    assert found.count() > 0 and "csv" not in found._jdf.queryExecution().toString().lower()
