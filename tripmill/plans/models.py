"""Queries on descriptors and classifiers."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tripmill.functions.scalar import rounded
from tripmill.operators import classify as cl
from tripmill.operators import evaluate as ev
from tripmill.operators import motion, noise, prepare
from tripmill.operators import neighbours as nb
from tripmill.plans import fixtures as fx
from tripmill.plans.catalog import query
from tripmill.plans.sql import chain, r
from tripmill.plans.trip_noise import clean_segments, u
from tripmill.plans.trips import good_steps
from tripmill.session import shared_folder, stage
from tripmill.sources.tables import write_model_results

SEG = ["trj_id", "seg_id"]
EXTRA = ["max_h1", "max_h2", "max_h3", "avg_turn", "exp_turn", "var_turn"]


def descriptor_sql(turn: str, change: str, extra: bool) -> str:
    top = {f"max_{s}{i}": f"list_sort(list({c}), 'DESC')[{i}]" for s, c in (("v", "velocity"), ("a", "acceleration"), ("h", turn)) for i in (1, 2, 3)}
    out = {
        "length": "sum(distance)", "avg_v": "sum(distance) / sum(delta_t)", "exp_v": "avg(velocity)", "var_v": "var_pop(velocity)",
        **{n: e for n, e in top.items() if "_h" not in n},
        "turn_rate": f"count(*) FILTER ({turn} > 19) / sum(distance)", "stop_rate": "count(*) FILTER (velocity < 3.4) / sum(distance)",
        "speed_change_rate": "count(*) FILTER (acceleration > 0.26) / sum(distance)",
    }
    if extra:
        out |= {n: e for n, e in top.items() if "_h" in n}
        out |= {"avg_turn": f"sum({change}) / sum(delta_t)", "exp_turn": f"avg({turn})", "var_turn": f"var_pop({turn})"}
    return chain("good", " SELECT trj_id, seg_id, any_value(label) AS label, " + ", ".join(f"{r(e)} AS {n}" for n, e in out.items()) + " FROM good WHERE accepted GROUP BY trj_id, seg_id")


def clean_steps(spark, sf):
    return good_steps(spark, sf).where("accepted")


def _rounded(df, names):
    return df.select(*SEG, "label", *[rounded(F.col(c), 4).alias(c) for c in names])


@query("trip_descriptors", descriptor_sql("heading_change_rate", "heading_change", False))
def _descriptors(spark, sf):
    return _rounded(cl.trip_descriptors(clean_steps(spark, sf), SEG), cl.DESCRIPTORS)


@query("trip_descriptors_legacy", descriptor_sql("heading_change", "heading", True))
def _legacy(spark, sf):
    return _rounded(cl.trip_descriptors(clean_steps(spark, sf), SEG, legacy_layout=True, extra=True), [*cl.DESCRIPTORS, *EXTRA])


@query("top_three_values", chain("good", f""", o AS (SELECT trj_id, seg_id, velocity, CAST(row_number() OVER (PARTITION BY trj_id, seg_id ORDER BY velocity DESC) AS INT) AS place FROM good WHERE accepted)
SELECT trj_id, seg_id, place, {r('velocity', 5)} AS velocity FROM o WHERE place <= 3"""))
def _top(spark, sf):
    d = cl.trip_descriptors(clean_steps(spark, sf), SEG)
    rows = d.select(*SEG, F.posexplode(F.array("max_v1", "max_v2", "max_v3")).alias("place", "velocity"))
    return rows.select(*SEG, (F.col("place") + 1).alias("place"), rounded(F.col("velocity"), 5).alias("velocity"))


def vectors(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


KNN = """WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 4 = 0), t AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 4 <> 0),
d AS (SELECT q.vec_id AS qid, t.vec_id AS id, t.label, sqrt(list_sum(list_transform(list_zip(q.embedding, t.embedding), lambda p: pow(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2)))) AS distance FROM q, t),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS INT) AS place FROM d),
nn AS (SELECT * FROM o WHERE place <= 7)"""


def neighbours(spark, sf, **kw):
    v = vectors(spark, sf)
    return cl.nearest_neighbours(v.where("id % 4 <> 0"), v.where("id % 4 = 0").drop("label"), 7, **kw)


def _near_out(n):
    return n.select("qid", "place", "id", rounded(F.col("distance"), 8).alias("distance"))


@query("nearest_neighbours", KNN + f" SELECT qid, place, id, {r('distance', 8)} AS distance FROM nn")
def _neighbours(spark, sf):
    return _near_out(neighbours(spark, sf))


@query("nearest_neighbours_blocks", KNN + f" SELECT qid, place, id, {r('distance', 8)} AS distance FROM nn")
def _neighbours_blocks(spark, sf):
    """The same through a tree of several levels and blocks of 64 rows, the way taken for more rows than a task holds."""
    return _near_out(neighbours(spark, sf, fan=4, leaf=64, block=64))


def vote_sql(k: int, weight: str) -> str:
    return KNN + f""", v AS (SELECT qid, label, sum({weight}) AS s FROM nn WHERE place <= {k} GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, label) AS rk FROM v)
SELECT qid, label AS y_pred FROM w WHERE rk = 1"""


@query("knn_vote", vote_sql(5, "1.0"))
def _vote(spark, sf):
    return cl.knn_vote(neighbours(spark, sf), 5)


@query("knn_vote_distance", vote_sql(7, "1.0 / distance"))
def _vote_distance(spark, sf):
    return cl.knn_vote(neighbours(spark, sf), 7, "distance")


@query("knn_model", vote_sql(5, "1.0"))
def _knn_model(spark, sf):
    """The classifier in a pipeline, saved and loaded again."""
    v = vectors(spark, sf).withColumn("features", array_to_vector("x"))
    folder = f"{shared_folder(spark)}/knn-{uuid.uuid4().hex}"
    Pipeline(stages=[nb.NearestNeighbours(k=5, leaf=256)]).fit(v.where("id % 4 <> 0")).save(folder)
    scored = PipelineModel.load(folder).transform(v.where("id % 4 = 0").select("id", "features"))
    return scored.select(F.col("id").alias("qid"), F.col("prediction").cast("int").alias("y_pred"))


TEST = "pmod(floor(trj_id / 5), 4) = 0"


def prepared(spark, sf):
    """Descriptors scaled by the training rows, stored once for the folds of the grid search, and the scaling."""
    rows = stage(cl.trip_descriptors(clean_steps(spark, sf), SEG).na.fill(0.0), "descriptors").withColumn("is_test", F.expr(TEST))
    pipe = cl.assembled(rows, cl.DESCRIPTORS).fit(rows.where("NOT is_test"))
    return scaled(pipe, rows), pipe


def scaled(pipe, rows):
    return pipe.transform(rows).withColumn("label", F.col("label").cast("double"))


GRID_ROWS = "model string, parameters string, accuracy double, is_best boolean"


def searched(rows, spark):
    """The best model of each kind after five-fold cross-validation over its whole grid (``classify.model_grid``), and all choices."""
    train = rows.where("NOT is_test")
    best, table = cl.grid_search(train, cl.model_grid(len(cl.DESCRIPTORS), 5))
    return best, spark.createDataFrame(table, GRID_ROWS)


@query("model_grid")
def _grid(spark, sf):
    """Cross-validated accuracy per parameter choice."""
    return searched(prepared(spark, sf)[0], spark)[1]


@query("model_report")
def _report(spark, sf):
    """Held-out report of the best model of each kind, saved and loaded again, through the result sink."""
    rows, _ = prepared(spark, sf)
    best, table = searched(rows, spark)
    folder = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    cl.save_models(best, folder)
    scored = stage(cl.predict_all(cl.load_models(list(best), folder), rows.where("is_test"), SEG), "predicted")
    write_model_results(
        f"{folder}/results", table.where("is_best").select("model", "parameters"), table,
        ev.class_report(scored, by=["model"]), ev.confusion(scored, by=["model"]))
    return spark.read.parquet(f"{folder}/results/test_report")


@query("model_noise_sets")
def _noise_sets(spark, sf):
    """All best models on the held-out trips of the 16 noise sets: one table of descriptors, read once for all models."""
    rows, pipe = prepared(spark, sf)
    best, _ = searched(rows, spark)
    swept = stage(noise.noise_sweep(stage(clean_segments(spark, sf).where(TEST), "held-out")), "sweep")
    keys = ["noise_config", *SEG]
    steps = motion.with_enough_steps(motion.step_features(swept, 5, keys))
    scored = cl.predict_all(best, scaled(pipe, cl.trip_descriptors(steps, keys).na.fill(0.0)), keys)
    return ev.accuracy(scored, by=["model", "noise_config"])


@query("model_noise_levels", chain("good", f""", s AS (SELECT trj_id, seg_id FROM good WHERE accepted AND (trj_id // 5) % 4 = 0 GROUP BY ALL),
m AS (SELECT unnest(['decision_tree', 'linear_svm', 'multilayer_perceptron', 'nearest_neighbours', 'random_forest']) AS model)
SELECT model, CAST(i * 10 AS VARCHAR) || '%noise' AS noise_level, count(*) AS segments, count(*) FILTER (i > 0 AND {u(42, 50, 'trj_id', 'seg_id')} < i / 10.0::DOUBLE) AS noisy
FROM s, m, range(11) l(i) GROUP BY model, i"""))
def _noise_levels(spark, sf):
    """The best models over 11 shares of noisy samples; each sample is scored clean and noisy, once, and a level takes one of the two."""
    rows, pipe = prepared(spark, sf)
    best, _ = searched(rows, spark)
    steps = good_steps(spark, sf).where(TEST).withColumn(
        "variant", F.explode(F.when(F.col("accepted"), F.array(F.lit("noisy"), F.lit("clean"))).otherwise(F.array(F.lit("noisy")))))
    keys = ["variant", *SEG]
    scored = cl.predict_all(best, scaled(pipe, cl.trip_descriptors(steps, keys).na.fill(0.0)), keys)
    scored = cl.at_noise_levels(scored, SEG, [i / 10 for i in range(11)])
    return scored.groupBy("model", "noise_level").agg(F.count(F.lit(1)).alias("segments"), F.count_if("is_noisy").alias("noisy"))


def fixed_network():
    """A stand-in for a trained model: fixed weights over the series' mean and largest values."""

    def predict(x: np.ndarray) -> np.ndarray:
        means, tops = x.mean(axis=1), x.max(axis=1)
        return np.stack([c * means - 0.37 * c * c + 0.01 * tops for c in range(5)], axis=1)

    return predict


@query("score_batches", chain("good", f""", pk AS (SELECT trj_id, seg_id, list(round(velocity, 3) ORDER BY pos) AS x FROM good WHERE accepted GROUP BY ALL), lg AS (SELECT max(len(x)) AS m FROM pk),
m AS (SELECT trj_id, seg_id, list_sum(x) / m AS mean, greatest(list_max(x), CASE WHEN len(x) < m THEN 0.0 ELSE list_max(x) END) AS top FROM pk, lg),
s AS (SELECT trj_id, seg_id, list_transform(range(5), lambda c: c * mean - 0.37 * c * c + 0.01 * top) AS z FROM m)
SELECT trj_id, seg_id, CAST(list_position(z, list_max(z)) - 1 AS INT) AS y_pred, {r('z[5]', 6)} AS last_score FROM s"""))
def _score(spark, sf):
    rows = clean_steps(spark, sf).withColumn("velocity", F.round("velocity", 3))
    packed = prepare.pack(rows, SEG, ["velocity"])
    length = packed.agg(F.max(F.size("x"))).first()[0]
    packed = prepare.pad_batch(packed, length, 1)
    flat = packed.select(*SEG, F.transform("x", lambda v: v[0]).alias("x"))
    out = cl.score_batches(flat, fixed_network, [length])
    return out.select(*SEG, "y_pred", rounded(F.get("scores", F.lit(4)), 6).alias("last_score"))
