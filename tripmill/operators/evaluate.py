"""Classifier evaluation over a long predictions table (``y_true``, ``y_pred``, optional ``by`` columns).

Everything starts from one count per (by, true, predicted), combined before the
shuffle; what follows has at most as many rows as there are class pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmill.functions.scalar import rounded
from tripmill.operators.scan import ordered_rank

# Edges of the precision and recall histogram.
HISTOGRAM_EDGES = [0.0, 0.2, 0.4, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))


def confusion(predictions: DataFrame, by: list[str] = []) -> DataFrame:
    """Counts per class pair, zeros included, with the share of the true class (``ratio``)."""
    counts = predictions.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    classes = counts.select(*by, F.explode(F.array("y_true", "y_pred")).alias("c")).groupBy(*by).agg(
        F.array_sort(F.collect_set("c")).alias("_classes")
    )
    grid = classes.withColumn("y_true", F.explode("_classes")).withColumn("y_pred", F.explode("_classes")).drop("_classes")
    dense = grid.join(counts, [*by, "y_true", "y_pred"], "left").fillna(0, ["n"])
    support = F.sum("n").over(Window.partitionBy(*by, "y_true"))
    return dense.withColumn("ratio", F.col("n") / F.nullif(support, F.lit(0)))


def confusion_matrix(predictions: DataFrame, classes: list[int]) -> DataFrame:
    """One row per true class, one column per predicted class."""
    return predictions.groupBy("y_true").pivot("y_pred", classes).agg(F.count(F.lit(1))).fillna(0)


def existing_classes(predictions: DataFrame) -> DataFrame:
    """Classes among predictions or truth."""
    return predictions.select(F.explode(F.array("y_true", "y_pred")).alias("label")).distinct()


def accuracy(predictions: DataFrame, excluded: list[int] = (), by: list[str] = []) -> DataFrame:
    """Share of right predictions over rows without an excluded class on either side."""
    rows = predictions.where(~F.col("y_true").isin(*excluded) & ~F.col("y_pred").isin(*excluded)) if excluded else predictions
    return rows.groupBy(*by).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))


def class_metrics(cells: DataFrame, by: list[str] = []) -> DataFrame:
    """Precision, recall, F1 and support per class from ``confusion`` counts; 0 where undefined."""
    sides = cells.select(*by, F.inline(F.array(*[
        F.struct(
            F.col(side).alias("label"),
            F.when(F.lit(side == "y_true"), F.col("n")).otherwise(0).alias("_support"),
            F.when(F.lit(side == "y_pred"), F.col("n")).otherwise(0).alias("_predicted"),
            F.when(F.lit(side == "y_true") & (F.col("y_true") == F.col("y_pred")), F.col("n")).otherwise(0).alias("_hit"),
        ) for side in ("y_true", "y_pred")
    ])))
    totals = sides.groupBy(*by, "label").agg(
        F.sum("_support").alias("support"), F.sum("_predicted").alias("predicted"), F.sum("_hit").alias("hit")
    )
    scored = totals.withColumn("precision", _ratio(F.col("hit"), F.col("predicted"))).withColumn(
        "recall", _ratio(F.col("hit"), F.col("support"))
    )
    return scored.withColumn(
        "f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def thieves(cells: DataFrame, by: list[str] = [], count: int = 2) -> DataFrame:
    """The classes a true class is most often taken for: the top ``count`` + 1 without itself."""
    order = Window.partitionBy(*by, "y_true").orderBy(F.desc("ratio"), F.desc("y_pred"))
    top = cells.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= count + 1).where("y_true <> y_pred")
    place = F.row_number().over(Window.partitionBy(*by, "y_true").orderBy("_r"))
    return top.withColumn("place", place).select(*by, F.col("y_true").alias("label"), "place", F.col("y_pred").alias("thief"), "ratio")


def class_report(predictions: DataFrame, by: list[str] = [], average: str = "macro", digits: int = 4, count: int = 2) -> DataFrame:
    """One row per class, most frequent first (``position``), and a total row with averages and accuracy."""
    cells = confusion(predictions, by)
    rows = class_metrics(cells, by)
    whole = Window.partitionBy(*by)
    share = F.col("support") / F.sum("support").over(whole)
    rows = rows.withColumn("rel_freq", share).withColumn(
        "position", F.row_number().over(whole.orderBy(F.desc("support"), F.desc("label")))
    )
    stolen = thieves(cells, by, count).groupBy(*by, "label").agg(*[
        F.max(F.when(F.col("place") == i, F.col(c))).alias(f"thief_{i}" if c == "thief" else f"thief_{i}_ratio")
        for i in range(1, count + 2) for c in ("thief", "ratio")
    ])
    detail = rows.join(stolen, [*by, "label"], "left").withColumn("accuracy", F.lit(None).cast("double"))
    detail = detail.withColumn("class", F.col("label").cast("string"))

    def mean(name: str) -> Column:
        return F.avg(name) if average == "macro" else F.sum(F.col(name) * F.col("rel_freq")) / F.sum("rel_freq")

    total = rows.groupBy(*by).agg(
        *[mean(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("rel_freq").alias("rel_freq"),
        (F.sum("hit") / F.sum("support")).alias("accuracy"), F.sum("support").alias("support"),
        (F.max("position") + 1).alias("position"),
    ).withColumn("class", F.lit("avg / total"))
    names = ["class", "accuracy", "precision", "recall", "f1", "rel_freq", "support", "position"]
    extra = [c for c in stolen.columns if c.startswith("thief")]
    out = detail.select(*by, *names, *extra).unionByName(total.select(*by, *names), allowMissingColumns=True)
    measures = {"accuracy", "precision", "recall", "f1", "rel_freq", *[c for c in extra if c.endswith("ratio")]}
    return out.select(*[rounded(F.col(c), digits).alias(c) if c in measures else F.col(c) for c in out.columns])


def average_precision_recall(cells: DataFrame, excluded: list[int] = (), average: str = "macro", by: list[str] = []) -> DataFrame:
    """Mean precision over predicted classes and mean recall, without excluded classes."""
    rows = class_metrics(cells, by).where(~F.col("label").isin(*excluded)) if excluded else class_metrics(cells, by)

    def mean(name: str, use: Column) -> Column:
        if average == "macro":
            return F.avg(F.when(use, F.col(name)))
        return F.sum(F.when(use, F.col(name) * F.col("support"))) / F.sum(F.when(use, F.col("support")))

    return rows.groupBy(*by).agg(
        mean("precision", F.col("predicted") > 0).alias("precision"), mean("recall", F.lit(True)).alias("recall")
    )


def score_histogram(metrics: DataFrame) -> DataFrame:
    """How many classes fall in each precision and recall bin; the last bin includes its upper edge."""
    edges = HISTOGRAM_EDGES
    last = len(edges) - 2
    bins = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(edges[i]).alias("bin_start"), F.lit(edges[i + 1]).alias("bin_end")) for i in range(last + 1)])

    def inside(c: str) -> Column:
        upper = (F.col(c) < F.col("bin_end")) | ((F.col("bin") == last) & (F.col(c) == F.col("bin_end")))
        return F.count(F.when((F.col(c) >= F.col("bin_start")) & upper, 1)).alias(f"{c}_count")

    return metrics.select("precision", "recall", F.inline(bins)).groupBy("bin_start", "bin_end").agg(inside("precision"), inside("recall"))


def top_k_accuracy(scored: DataFrame, k: int, scores: str = "scores", ranked: str | None = None) -> DataFrame:
    """Accuracy within the first 1 .. k classes, from scores or from ranked class lists.

    Of equal scores the higher class comes first.
    """
    if ranked is None:
        own = F.get(scores, F.col("y_true"))
        ahead = F.size(F.filter(scores, lambda s: s > own)) + F.size(
            F.filter(scores, lambda s, i: (s == own) & (i > F.col("y_true"))))
        place = F.when(own.isNotNull(), ahead + 1)
    else:
        place = F.nullif(F.array_position(ranked, F.col("y_true")), F.lit(0))
    counted = scored.select(place.alias("_p")).agg(
        *[F.avg(F.coalesce((F.col("_p") <= i).cast("double"), F.lit(0.0))).alias(str(i)) for i in range(1, k + 1)]
    )
    return counted.unpivot([], [str(i) for i in range(1, k + 1)], "k", "accuracy").withColumn("k", F.col("k").cast("int"))


def threshold_curve(predictions: DataFrame, label: int, n_points: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Precision and recall of one class as its predictions under a score threshold are dropped.

    Predictions are counted per threshold bucket, then summed from the top: one
    pass however many thresholds there are.
    """
    if low is None or high is None:
        ends = predictions.where(F.col("y_pred") == label).agg(F.min("score").alias("a"), F.max("score").alias("b")).first()
        low, high = 0.99 * (ends["a"] or 0.0), 1.01 * (ends["b"] or 0.0)  # both 0 where the class is never predicted
    step = (high - low) / (n_points - 1) or 1.0  # equal ends: every threshold is that score

    def threshold(j: Column) -> Column:
        return F.when(j == n_points - 1, F.lit(high)).otherwise(F.lit(low) + j * F.lit(step))

    guess = F.greatest(F.lit(-1), F.least(F.lit(n_points - 1), F.floor((F.col("score") - low) / step)))
    up = F.when((guess + 1 < n_points) & (F.col("score") >= threshold(guess + 1)), guess + 1)
    bucket = F.coalesce(up, F.when((guess >= 0) & (F.col("score") < threshold(guess)), guess - 1), guess)
    of_class = F.col("y_pred") == label
    counted = predictions.select(
        F.when(of_class, bucket).otherwise(-1).cast("int").alias("j"), of_class.alias("_p"), (F.col("y_true") == label).alias("_t")
    ).groupBy("j").agg(
        F.count(F.when(F.col("_p"), 1)).alias("_predicted"), F.count(F.when(F.col("_p") & F.col("_t"), 1)).alias("_hit"),
        F.count(F.when(F.col("_t"), 1)).alias("_true"),
    )
    spark = predictions.sparkSession
    grid = spark.range(-1, n_points).select(F.col("id").cast("int").alias("j")).join(counted, "j", "left").fillna(0)
    whole = Window.partitionBy(F.lit(0))  # at most n_points + 1 rows
    above = whole.orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, 0)
    summed = grid.select(
        "j", F.sum("_predicted").over(above).alias("_predicted"), F.sum("_hit").over(above).alias("_hit"),
        F.sum("_true").over(whole).alias("_true"),
    )
    return summed.where("j >= 0").select(
        threshold(F.col("j")).alias("threshold"), _ratio(F.col("_hit"), F.col("_predicted")).alias("precision"),
        _ratio(F.col("_hit"), F.col("_true")).alias("recall"),
    )


def binary_areas(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve and under the precision-recall curve, from ``y_true`` 0/1 and ``score``.

    Rows are counted per distinct score, then summed in falling score order over
    a global sort.
    """
    per_score = scored.groupBy((-F.col("score")).alias("s")).agg(
        F.count(F.when(F.col("y_true") == 1, 1)).alias("pos"), F.count(F.when(F.col("y_true") != 1, 1)).alias("neg")
    )
    curve = ordered_rank(per_score, [], ["s"], running={"tp": F.col("pos"), "fp": F.col("neg")})
    before_p, before_n = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    before = F.when(before_p + before_n == 0, F.lit(1.0)).otherwise(before_p / F.nullif(before_p + before_n, F.lit(0)))
    p, n = F.sum("pos"), F.sum("neg")
    return curve.agg(
        (F.sum(F.col("neg") * (before_p + F.col("pos") / 2)) / (p * n)).alias("auroc"),
        (F.sum(F.col("pos") * (prec + before) / 2) / p).alias("auprc"),
    )


def sweep_summary(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy and macro precision, recall and F1 per noise level or set, in one pass over all of them."""
    rows = class_metrics(confusion(predictions, by), by)
    return rows.groupBy(*by).agg(
        (F.sum("hit") / F.sum("support")).alias("accuracy"),
        *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
    )


def masked_mse(rows: DataFrame, predicted: str, true: str, mask: Column | None = None, by: list[str] = []) -> DataFrame:
    """Mean squared error over the selected rows (all of them without a mask)."""
    error = F.pow(F.col(predicted) - F.col(true), 2)
    selected = rows if mask is None else rows.where(mask)
    return selected.groupBy(*by).agg(F.avg(error).alias("mse"), F.count(F.lit(1)).alias("n"))


def weighted_error(
    rows: DataFrame, predicted: str, true: str, target: Column, valid: Column, imputation: float = 1.0, denoising: float = 1.0
) -> DataFrame:
    """Imputation error at target places and denoising error at other valid places, weighted.

    ``total`` adds the two weighted means; ``per_element`` is the mean of the
    weighted errors over all valid places.
    """
    error = F.pow(F.col(predicted) - F.col(true), 2)
    part = {name: F.coalesce(F.avg(F.when(valid & where, error)), F.lit(0.0)) for name, where in (("imputation", target), ("denoising", ~target))}
    weighted = F.when(target, imputation * error).otherwise(denoising * error)
    return rows.agg(
        part["imputation"].alias("imputation"), part["denoising"].alias("denoising"),
        (imputation * part["imputation"] + denoising * part["denoising"]).alias("total"),
        F.avg(F.when(valid, weighted)).alias("per_element"),
    )


def coordinate_error(rows: DataFrame, target: Column, valid: Column) -> DataFrame:
    """Squared error of latitude and longitude together over masked valid places; 0 where there are none."""
    both = F.pow(F.col("lat_pred") - F.col("lat"), 2) + F.pow(F.col("lon_pred") - F.col("lon"), 2)
    return rows.agg(F.coalesce(F.avg(F.when(target & valid, both)) / 2, F.lit(0.0)).alias("mse"))


def equalised_loss(clean_accuracy: Column, noisy_accuracy: Column) -> Column:
    """Loss under noise relative to clean accuracy, from percentages."""
    return (100 - noisy_accuracy) / clean_accuracy


def best_rows(metrics: DataFrame, by: list[str], key: str, largest: bool = True) -> DataFrame:
    """The best row per group by a key metric; the earliest of equals."""
    rest = [c for c in metrics.columns if c not in by]
    order = F.struct(F.col(key) if largest else -F.col(key), -F.col("epoch"))
    return metrics.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_b")).select(*by, "_b.*")
