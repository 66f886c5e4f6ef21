"""The driver's tables as points, intervals, vectors and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT_COLUMNS = """
SELECT CAST(floor(CAST(event_id AS DOUBLE) / 250) AS BIGINT) AS trj_id,
       CAST(event_id % 250 AS BIGINT) AS k,
       CAST(CAST(floor(CAST(event_id AS DOUBLE) / 250) AS BIGINT) % 5 AS INT) AS label,
       CAST(1704067200 + 5 * event_id + (event_id * 7) % 5
            + 1500 * CAST(floor(CAST(event_id AS DOUBLE) / 97) AS BIGINT)
            - CASE WHEN event_id % 211 = 0 THEN 20 ELSE 0 END AS DOUBLE) AS t,
       CAST(39.9 AS DOUBLE) + CAST(0.0002 AS DOUBLE) * (event_id % 250)
            + CASE WHEN event_id % 503 = 0 THEN 60 ELSE 0 END
            + value * CAST(0.000002 AS DOUBLE) AS lat,
       CAST(116.3 AS DOUBLE) + CAST(0.0001 AS DOUBLE) * ((event_id * 13) % 7)
            + value * CAST(0.0000014 AS DOUBLE) AS lon
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled points derived from ``events``; 250 points per trip."""
    columns = [c.strip() for c in POINT_COLUMNS.replace("SELECT", "", 1).split(",\n")]
    return table(spark, sf_dir, "events").selectExpr(*columns)


def epoch(ts):
    """Seconds since 1970 of a wall-clock timestamp, whatever the session zone is."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone())) / 1000000.0
