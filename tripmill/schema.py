"""Table schemas, class codes and class limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.StructType([
    T.StructField("trj_id", T.LongType()),
    T.StructField("k", T.LongType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("t", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
])

FEATURES = [
    "delta_t", "hour", "distance", "velocity", "acceleration",
    "jerk", "heading", "heading_change", "heading_change_rate",
]
FEATURES_WITH_TIME = [*FEATURES, "ts_mid"]

# The limits, codes and thresholds the results depend on.
MIN_POINTS = 10
MAX_SEGMENT = 200
STAY_SECONDS = 1200.0
STOP_METERS = 0.5
TURN_DEGREES = 90.0
SPEED_LIMIT_5 = {0: 7.0, 1: 12.0, 2: 120.0 / 3.6, 3: 180.0 / 3.6, 4: 120.0 / 3.6}
ACC_LIMIT_5 = {0: 3.0, 1: 3.0, 2: 2.0, 3: 10.0, 4: 3.0}
SPEED_LIMIT_8 = {1: 1.0, 2: 7.0, 3: 40.0 / 3.6, 4: 12.0, 5: 180.0 / 3.6, 6: 120.0 / 3.6, 7: 120.0 / 3.6, 8: 120.0 / 3.6}
ACC_LIMIT_8 = {1: 1.0, 2: 3.0, 3: 3.0, 4: 3.0, 5: 10.0, 6: 2.0, 7: 3.0, 8: 3.0}
MODE_CODES = {
    "walk": 0, "bike": 1, "bus": 2, "car": 3, "subway": 4, "train": 4,
    "airplane": 6, "boat": 7, "run": 8, "motorcycle": 9, "taxi": 3,
}
SENSOR_TO_5 = {2: 0, 4: 1, 5: 3, 6: 2, 7: 4, 8: 4}
DRIFT_FACTOR = {0: 0.5, 1: 0.7, 2: 1.0, 3: 1.2, 4: 1.0}
MISSING_RATE = {0: 0.05, 1: 0.08, 2: 0.15, 3: 0.12, 4: 0.20}


def limits(spark: SparkSession, n_class: int = 5) -> DataFrame:
    """Class limits as a table (5 or 8 rows)."""
    speed, acc = (SPEED_LIMIT_5, ACC_LIMIT_5) if n_class == 5 else (SPEED_LIMIT_8, ACC_LIMIT_8)
    rows = [(c, float(speed[c]), float(acc[c])) for c in sorted(speed)]
    return spark.createDataFrame(rows, "label int, max_speed double, max_acc double")


def modes(spark: SparkSession) -> DataFrame:
    """Mode names and their codes (11 rows)."""
    return spark.createDataFrame(sorted(MODE_CODES.items()), "mode string, label int")


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """Literal-map lookup, folded into the projection; unknown keys give ``default``."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, F.lit(default))
