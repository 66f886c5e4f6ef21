"""Trip descriptors and classical classifiers over them, with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, LinearSVC, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import predict_batch_udf
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmill.operators import neighbours
from tripmill.operators.noise import draw

# Thresholds of the descriptor rates.
TURN_RATE, STOP_SPEED, SPEED_CHANGE = 19.0, 3.4, 0.26
DESCRIPTORS = [
    "length", "avg_v", "exp_v", "var_v", "max_v1", "max_v2", "max_v3", "max_a1", "max_a2", "max_a3",
    "turn_rate", "stop_rate", "speed_change_rate",
]


def trip_descriptors(steps: DataFrame, keys: list[str], legacy_layout: bool = False, extra: bool = False) -> DataFrame:
    """One row per segment: length, speeds, largest speeds and accelerations, and rates per metre.

    The turn rate counts steep heading change rates; ``legacy_layout`` counts
    heading changes, as the older column order had it. ``extra`` adds the three
    largest of that column with its mean and variance, and the mean turn per second.
    """
    turn, change = ("heading_change", "heading") if legacy_layout else ("heading_change_rate", "heading_change")
    length = F.sum("distance")
    per_metre = F.nullif(length, F.lit(0.0))

    def top(c: str) -> Column:
        return F.slice(F.sort_array(F.collect_list(c), asc=False), 1, 3)

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1)) / per_metre

    aggregates = {
        "length": length, "avg_v": length / F.nullif(F.sum("delta_t"), F.lit(0.0)), "exp_v": F.avg("velocity"), "var_v": F.var_pop("velocity"),
        "_v": top("velocity"), "_a": top("acceleration"), "turn_rate": count(F.col(turn) > TURN_RATE),
        "stop_rate": count(F.col("velocity") < STOP_SPEED), "speed_change_rate": count(F.col("acceleration") > SPEED_CHANGE),
    }
    if extra:
        aggregates |= {
            "_h": top(turn), "avg_turn": F.sum(change) / F.nullif(F.sum("delta_t"), F.lit(0.0)),
            "exp_turn": F.avg(turn), "var_turn": F.var_pop(turn),
        }
    packed = steps.groupBy(*keys).agg(F.first("label").alias("label"), *[a.alias(n) for n, a in aggregates.items()])
    spread = {f"max_{s}{i}": F.get(f"_{s}", F.lit(i - 1)) for s in ("v", "a", *(["h"] if extra else [])) for i in (1, 2, 3)}
    more = ["max_h1", "max_h2", "max_h3", "avg_turn", "exp_turn", "var_turn"] if extra else []
    return packed.withColumns(spread).select(*keys, "label", *DESCRIPTORS, *more)


def assembled(rows: DataFrame, columns: list[str], scale: bool = True) -> Pipeline:
    stages = [VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="error")]
    stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=scale))
    return Pipeline(stages=stages)


def model_grid(n_features: int, n_class: int, small: bool = False) -> dict[str, tuple]:
    """Each classifier with its parameter grid; ``small`` takes the first choice or two.

    Tree depth is at most 30, which stands for no limit; the smallest split is
    given as the smallest child.
    """
    forest, tree = RandomForestClassifier(seed=42), DecisionTreeClassifier(seed=42)
    network = MultilayerPerceptronClassifier(seed=42, maxIter=30 if small else 200)
    svm = LinearSVC(maxIter=10 if small else 100)
    knn = neighbours.NearestNeighbours()
    depths = [5, 10] if small else [10, 20, 30]
    layers = [[n_features, 100, n_class], [n_features, 50, 25, n_class]]

    def grid(**choices):
        builder = ParamGridBuilder()
        for param, values in choices.values():
            builder = builder.addGrid(param, values)
        return builder.build()

    return {
        "random_forest": (forest, grid(
            n=(forest.numTrees, [20] if small else [100, 200]), d=(forest.maxDepth, depths[:1] if small else depths),
            s=(forest.minInstancesPerNode, [1] if small else [1, 2]))),
        "multilayer_perceptron": (network, grid(l=(network.layers, layers[1:] if small else layers))),
        "decision_tree": (tree, grid(d=(tree.maxDepth, depths), s=(tree.minInstancesPerNode, [1] if small else [1, 2]))),
        "linear_svm": (OneVsRest(classifier=svm, parallelism=n_class), grid(c=(svm.regParam, [0.1] if small else [1.0, 0.1]))),
        "nearest_neighbours": (knn, grid(k=(knn.k, [3, 5, 7]), w=(knn.weights, ["uniform", "distance"]))),
    }


def grid_search(train: DataFrame, models: dict[str, tuple], folds: int = 5, parallelism: int = 4) -> tuple[dict, list[tuple]]:
    """Cross-validate each model over its grid by accuracy.

    Returns the best model per name and rows (model, parameters, accuracy, is_best).
    ``train`` has ``features`` and ``label`` and should be a stored or cached table.
    """
    evaluator = MulticlassClassificationEvaluator(metricName="accuracy")
    best, rows = {}, []
    for name, (estimator, grid) in models.items():
        cv = CrossValidator(
            estimator=estimator, estimatorParamMaps=grid, evaluator=evaluator, numFolds=folds, seed=42, parallelism=parallelism
        ).fit(train)
        best[name] = cv.bestModel
        top = max(range(len(grid)), key=lambda i: cv.avgMetrics[i])
        for i, params in enumerate(grid):
            text = ";".join(f"{p.name}={v}" for p, v in params.items())
            rows.append((name, text, float(cv.avgMetrics[i]), i == top))
    return best, rows


def predict_all(models: dict[str, object], rows: DataFrame, keys: list[str]) -> DataFrame:
    """``model, keys, y_true, y_pred``: predictions of every model over the same rows, which are read once.

    Each model adds a column of its own to the rows; one row per model is made
    of them at the end. ``models`` may be fitted models or pipelines of one.
    """
    wide = rows
    for i, model in enumerate(models.values()):
        one = (model.stages[0] if isinstance(model, PipelineModel) else model).copy()
        scored = one.setPredictionCol(f"_prediction_{i}").transform(wide)
        wide = scored.select(*wide.columns, f"_prediction_{i}")
    each = [F.struct(F.lit(n).alias("model"), F.col(f"_prediction_{i}").cast("int").alias("y_pred")) for i, n in enumerate(models)]
    return wide.select(*keys, F.col("label").cast("int").alias("y_true"), F.inline(F.array(*each))).select("model", *keys, "y_true", "y_pred")


def at_noise_levels(scored: DataFrame, keys: list[str], levels: list[float], seed: int = 42) -> DataFrame:
    """``model, noise_level, keys, y_true, y_pred, is_noisy`` for each level, from predictions of both variants of each sample.

    ``scored`` is that of ``predict_all`` with a ``variant`` clean or noisy among
    the keys; at a level a sample is noisy with that chance, by one draw for all
    levels, so the samples of a level are among those of the next. Samples
    without one of the variants are left out.
    """
    def of(variant: str) -> Column:
        return F.max(F.when(F.col("variant") == variant, F.col("y_pred")))

    both = scored.groupBy("model", *keys).agg(F.first("y_true").alias("y_true"), of("clean").alias("_clean"), of("noisy").alias("_noisy"))
    listed = F.inline(F.array(*[F.struct(F.lit(f"{round(100 * x)}%noise").alias("noise_level"), F.lit(float(x)).alias("_share")) for x in levels]))
    rows = both.where("_clean is not null and _noisy is not null").select("*", listed)
    noisy = draw(seed, *keys, purpose=50) < F.col("_share")
    return rows.select(
        "model", "noise_level", *keys, "y_true", F.when(noisy, F.col("_noisy")).otherwise(F.col("_clean")).alias("y_pred"), noisy.alias("is_noisy"))


def save_models(models: dict[str, object], folder: str) -> None:
    for name, model in models.items():
        PipelineModel([model]).write().overwrite().save(f"{folder}/{name}")


def load_models(names: list[str], folder: str) -> dict[str, PipelineModel]:
    return {name: PipelineModel.load(f"{folder}/{name}") for name in names}


def score_batches(packed: DataFrame, make_predict, shape: list[int], x: str = "x", batch_size: int = 256) -> DataFrame:
    """Class scores of a user-supplied model over packed samples, then softmax and class.

    ``make_predict`` builds the model once per task and returns a function from a
    batch of arrays, each of ``shape``, to a matrix of scores.
    """
    from tripmill.functions.scalar import argmax, softmax

    scorer = predict_batch_udf(make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=[shape])
    scored = packed.withColumn("scores", scorer(F.col(x)))
    return scored.withColumn("probs", softmax(F.col("scores"))).withColumn("y_pred", argmax(F.col("scores")))


def nearest_neighbours(
    train: DataFrame, queries: DataFrame, k: int, fan: int = 16, leaf: int = 1024, seed: int = 42, block: int = 4096
) -> DataFrame:
    """The exact ``k`` nearest training rows of each query (``id``, ``x``; training rows also have ``label``), by a tree of balls."""
    tree = neighbours.ball_tree(train, fan, leaf, seed)
    return neighbours.search(tree, queries.select(F.col("id").alias("qid"), F.col("x").alias("qx")), k, block, seed)


knn_vote = neighbours.vote
