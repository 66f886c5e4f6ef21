"""Stage tables and result sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


FILES = 32  # in a folder of a stage table, at most


def write_stage(df: DataFrame, path: str, partitions: list[str] = ["split", "noise_config"], own: bool = False) -> None:
    """Write a stage table, in folders per split and noise configuration where it has those columns.

    With ``own`` only the folders that ``df`` has rows for are replaced, and the others stay.
    """
    present = [c for c in partitions if c in df.columns]
    # Rows of one folder come from at most FILES tasks; the folder key alone would put a split in one task.
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c not in present]), F.lit(FILES))
    writer = df.repartition(*present, salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if own else "static")
    writer.partitionBy(*present).parquet(path)


def cached_stage(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stage table at ``path``; built and written first if it is not there or was not written to its end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """Small results (noise statistics, checks, run settings) as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Named result tables side by side, such as confusion, report and histogram."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        writer.csv(f"{folder}/{name}", header=True) if fmt == "csv" else writer.parquet(f"{folder}/{name}")


RECORDS = "run_id string, name string, stage string, metric string, value double"


def append_record(spark: SparkSession, path: str, run_id: str, name: str, best: dict[str, float], final: dict[str, float] | None = None) -> None:
    """Add one run to the records, one row per stage and metric; the table is created if missing."""
    rows = [(run_id, name, stage, m, float(v)) for stage, part in (("Best", best), ("Final", final or {})) for m, v in part.items()]
    spark.createDataFrame(rows, RECORDS).write.mode("append").parquet(path)


def append_records(metrics: DataFrame, path: str) -> None:
    """Add the runs of a long metrics table."""
    metrics.select("run_id", "name", "stage", "metric", F.col("value").cast("double")).write.mode("append").parquet(path)


def records_wide(records: DataFrame, columns: list[str]) -> DataFrame:
    """One row per run with a column per stage and metric, such as ``Best accuracy``."""
    named = records.withColumn("column", F.concat_ws(" ", "stage", "metric"))
    return named.groupBy("run_id", "name").pivot("column", columns).agg(F.first("value"))


def write_model_results(folder: str, best: DataFrame, cv: DataFrame, report: DataFrame, confusion: DataFrame) -> None:
    """Best parameters, cross-validation results, test report and confusion counts of the classical models."""
    write_tables({"best_params": best, "cv_results": cv, "test_report": report, "confusion": confusion}, folder)
