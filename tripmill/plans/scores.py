"""Queries on evaluation and ranks: vectors as class scores, labels as binary truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripmill.functions import scalar
from tripmill.functions.scalar import rounded
from tripmill.operators import evaluate as ev
from tripmill.operators import noise, ranks
from tripmill.plans import fixtures as fx
from tripmill.plans.catalog import query
from tripmill.plans.sql import h32, r

SCORES = """WITH s AS (SELECT vec_id AS id, label AS y_true, [CAST(x AS DOUBLE) FOR x IN embedding[1:10]] AS scores,
  [CAST(x AS DOUBLE) FOR x IN embedding[11:20]] AS noisy FROM embeddings),
p AS (SELECT *, CAST(list_position(scores, list_max(scores)) - 1 AS INT) AS y_pred, CAST(list_position(noisy, list_max(noisy)) - 1 AS INT) AS y_noisy FROM s)
"""


def scored(spark, sf):
    """Each vector's first ten numbers as scores of the ten classes, the next ten as scores under noise."""
    e = fx.table(spark, sf, "embeddings")

    def part(start):
        return F.slice("embedding", start, 10).cast("array<double>")

    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("y_true"), part(1).alias("scores"), part(11).alias("noisy"))


def predictions(spark, sf):
    s = scored(spark, sf)
    return s.withColumn("y_pred", scalar.argmax(F.col("scores"))).withColumn("y_noisy", scalar.argmax(F.col("noisy")))


@query("softmax_argmax", SCORES + f"""SELECT id, y_pred, list_transform(scores, lambda x: {r('exp(x) / list_sum(list_transform(scores, lambda z: exp(z)))', 6)}) AS probs FROM p""")
def _softmax(spark, sf):
    probs = F.transform(scalar.softmax(F.col("scores")), lambda x: rounded(x, 6))
    return scored(spark, sf).select("id", scalar.argmax(F.col("scores")).alias("y_pred"), probs.alias("probs"))


@query("cross_entropy", SCORES + f"SELECT id, {r('ln(list_sum(list_transform(scores, lambda z: exp(z)))) - scores[y_true + 1]', 6)} AS loss FROM p")
def _ce(spark, sf):
    return scored(spark, sf).select("id", rounded(scalar.cross_entropy(F.col("scores"), F.col("y_true")), 6).alias("loss"))


@query("accuracy", SCORES + f"SELECT {r('avg(CAST(y_true = y_pred AS DOUBLE))', 6)} AS accuracy FROM p")
def _accuracy(spark, sf):
    return ev.accuracy(predictions(spark, sf)).select(rounded(F.col("accuracy"), 6).alias("accuracy"))


@query("accuracy_excluding", SCORES + f"SELECT {r('avg(CAST(y_true = y_pred AS DOUBLE))', 6)} AS accuracy FROM p WHERE y_true NOT IN (0, 3) AND y_pred NOT IN (0, 3)")
def _accuracy_ex(spark, sf):
    return ev.accuracy(predictions(spark, sf), [0, 3]).select(rounded(F.col("accuracy"), 6).alias("accuracy"))


CELLS = SCORES + """, cls AS (SELECT y_true AS c FROM p UNION SELECT y_pred FROM p),
cells AS (SELECT a.c AS y_true, b.c AS y_pred, (SELECT count(*) FROM p WHERE p.y_true = a.c AND p.y_pred = b.c) AS n FROM cls a, cls b),
rn AS (SELECT *, n / nullif(sum(n) OVER (PARTITION BY y_true), 0) AS ratio FROM cells),
met AS (SELECT c AS label, (SELECT count(*) FROM p WHERE y_true = c) AS support, (SELECT count(*) FROM p WHERE y_pred = c) AS predicted,
  (SELECT count(*) FROM p WHERE y_pred = c AND y_true = c) AS hit FROM cls),
pr AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE hit / predicted END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE hit / support END AS recall FROM met),
m AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr)
"""


@query("confusion", CELLS + f"SELECT y_true, y_pred, n, {r('ratio', 6)} AS ratio FROM rn")
def _confusion(spark, sf):
    return ev.confusion(predictions(spark, sf)).withColumn("ratio", rounded(F.col("ratio"), 6))


@query("confusion_matrix", SCORES + "SELECT y_true, " + ", ".join(f'count(*) FILTER (y_pred = {c}) AS "{c}"' for c in range(10)) + " FROM p GROUP BY y_true")
def _matrix(spark, sf):
    return ev.confusion_matrix(predictions(spark, sf), list(range(10)))


@query("existing_classes", SCORES + "SELECT y_true AS label FROM p UNION SELECT y_pred FROM p")
def _classes(spark, sf):
    return ev.existing_classes(predictions(spark, sf))


@query("class_metrics", CELLS + f"SELECT label, support, predicted, hit, {r('precision', 6)} AS precision, {r('recall', 6)} AS recall, {r('f1', 6)} AS f1 FROM m")
def _metrics(spark, sf):
    out = ev.class_metrics(ev.confusion(predictions(spark, sf)))
    return out.select("label", "support", "predicted", "hit", *[rounded(F.col(c), 6).alias(c) for c in ("precision", "recall", "f1")])


THIEVES = """, o AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY ratio DESC, y_pred DESC) AS rk FROM rn),
th AS (SELECT y_true AS label, y_pred AS thief, ratio, row_number() OVER (PARTITION BY y_true ORDER BY rk) AS place FROM o WHERE rk <= 3 AND y_true <> y_pred)
"""


@query("thieves", CELLS + THIEVES + f"SELECT label, CAST(place AS INT) AS place, thief, {r('ratio', 6)} AS ratio FROM th")
def _thieves(spark, sf):
    return ev.thieves(ev.confusion(predictions(spark, sf))).withColumn("ratio", rounded(F.col("ratio"), 6))


def report_sql(average: str) -> str:
    mean = {c: f"avg({c})" if average == "macro" else f"sum({c} * support) / sum(support)" for c in ("precision", "recall", "f1")}
    return CELLS + THIEVES + f""", st AS (SELECT label, """ + ", ".join(
        f"max(thief) FILTER (place = {i}) AS thief_{i}, max(ratio) FILTER (place = {i}) AS thief_{i}_ratio" for i in (1, 2, 3)
    ) + f""" FROM th GROUP BY label)
SELECT CAST(m.label AS VARCHAR) AS class, CAST(NULL AS DOUBLE) AS accuracy, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1,
  {r('support / sum(support) OVER ()')} AS rel_freq, CAST(support AS BIGINT) AS support, CAST(row_number() OVER (ORDER BY support DESC, m.label DESC) AS INT) AS position,
  thief_1, {r('thief_1_ratio')} AS thief_1_ratio, thief_2, {r('thief_2_ratio')} AS thief_2_ratio, thief_3, {r('thief_3_ratio')} AS thief_3_ratio
FROM m LEFT JOIN st USING (label)
UNION ALL SELECT 'avg / total', {r('sum(hit) / sum(support)')}, {r(mean['precision'])}, {r(mean['recall'])}, {r(mean['f1'])}, 1.0, CAST(sum(support) AS BIGINT), CAST(count(*) + 1 AS INT),
  NULL, NULL, NULL, NULL, NULL, NULL FROM m"""


@query("class_report", report_sql("macro"))
def _report(spark, sf):
    return ev.class_report(predictions(spark, sf))


@query("class_report_weighted", report_sql("weighted"))
def _report_weighted(spark, sf):
    return ev.class_report(predictions(spark, sf), average="weighted")


@query("average_precision_recall", CELLS + f"""SELECT 'macro' AS average, {r('avg(precision) FILTER (predicted > 0)', 6)} AS precision, {r('avg(recall)', 6)} AS recall FROM m WHERE label NOT IN (1)
UNION ALL SELECT 'weighted', {r('sum(precision * support) FILTER (predicted > 0) / sum(support) FILTER (predicted > 0)', 6)}, {r('sum(recall * support) / sum(support)', 6)} FROM m WHERE label NOT IN (1)""")
def _averages(spark, sf):
    cells = ev.confusion(predictions(spark, sf))
    parts = [ev.average_precision_recall(cells, [1], kind).withColumn("average", F.lit(kind)) for kind in ("macro", "weighted")]
    out = parts[0].unionByName(parts[1])
    return out.select("average", rounded(F.col("precision"), 6).alias("precision"), rounded(F.col("recall"), 6).alias("recall"))


@query("score_histogram", CELLS + """, b AS (SELECT * FROM (VALUES (0.0::DOUBLE, 0.2::DOUBLE), (0.2, 0.4), (0.4, 0.6), (0.6, 0.7), (0.7, 0.8), (0.8, 0.9), (0.9, 1.0), (1.0, 1.1)) t(bin_start, bin_end))
SELECT bin_start, bin_end, (SELECT count(*) FROM m WHERE precision >= bin_start AND precision < bin_end) AS precision_count,
  (SELECT count(*) FROM m WHERE recall >= bin_start AND recall < bin_end) AS recall_count FROM b""")
def _hist(spark, sf):
    return ev.score_histogram(ev.class_metrics(ev.confusion(predictions(spark, sf))))


@query("topk_accuracy", SCORES + f""", rk AS (SELECT 1 + len(list_filter(scores, lambda x: x > scores[y_true + 1]))
   + len([i FOR i IN range(1, 11) IF scores[i] = scores[y_true + 1] AND i > y_true + 1]) AS place FROM p)
SELECT CAST(k AS INT) AS k, {r('avg(CAST(place <= k AS DOUBLE))', 6)} AS accuracy FROM rk, range(1, 6) g(k) GROUP BY k""")
def _topk(spark, sf):
    return ev.top_k_accuracy(scored(spark, sf), 5).withColumn("accuracy", rounded(F.col("accuracy"), 6))


@query("topk_accuracy_ranked", SCORES + f""", rk AS (SELECT list_position(list_transform(list_sort([{{'s': -x, 'i': -i}} FOR x, i IN scores]), lambda z: -z.i - 1), y_true) AS place FROM p)
SELECT CAST(k AS INT) AS k, {r('avg(CAST(place <= k AS DOUBLE))', 6)} AS accuracy FROM rk, range(1, 4) g(k) GROUP BY k""".replace("[{'s': -x, 'i': -i} FOR x, i IN scores]", "list_transform(scores, lambda x, i: {'s': -x, 'i': -i})"))
def _topk_ranked(spark, sf):
    order = F.array_sort(F.transform("scores", lambda x, i: F.struct((-x).alias("s"), (-i).alias("i"))))
    lists = scored(spark, sf).withColumn("ranked", F.transform(order, lambda z: -z["i"]))
    return ev.top_k_accuracy(lists, 3, ranked="ranked").withColumn("accuracy", rounded(F.col("accuracy"), 6))


BINARY = """WITH b AS (SELECT l.doc_id, l.toxic AS y_true, CASE WHEN l.quality = 0 THEN 1 ELSE 0 END AS y_pred, CAST(d.n_chars AS DOUBLE) AS score
  FROM labels l JOIN documents d USING (doc_id))
"""


def binary(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    rows = fx.table(spark, sf, "labels").join(d, "doc_id")
    return rows.select("doc_id", F.col("toxic").alias("y_true"), F.when(F.col("quality") == 0, 1).otherwise(0).alias("y_pred"), "score")


@query("threshold_curve", BINARY + f""", e AS (SELECT 0.99::DOUBLE * min(score) AS lo, 1.01::DOUBLE * max(score) AS hi FROM b WHERE y_pred = 1),
g AS (SELECT CASE WHEN j = 20 THEN hi ELSE lo + j * ((hi - lo) / 20) END AS thr FROM e, range(21) t(j)),
c AS (SELECT thr, count(*) FILTER (y_pred = 1 AND score >= thr) AS pr, count(*) FILTER (y_pred = 1 AND score >= thr AND y_true = 1) AS hit,
  count(*) FILTER (y_true = 1) AS tr FROM b, g GROUP BY thr)
SELECT {r('thr', 6)} AS threshold, {r('CASE WHEN pr = 0 THEN 0 ELSE hit / pr END', 6)} AS precision, {r('CASE WHEN tr = 0 THEN 0 ELSE hit / tr END', 6)} AS recall FROM c""")
def _curve(spark, sf):
    out = ev.threshold_curve(binary(spark, sf), 1, 21)
    return out.select(*[rounded(F.col(c), 6).alias(c) for c in out.columns])


@query("binary_areas", BINARY + f""", g AS (SELECT score, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true <> 1) AS neg FROM b GROUP BY score),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, tp / (tp + fp) AS pc, coalesce(lag(tp / (tp + fp)) OVER (ORDER BY score DESC), 1.0) AS pb FROM c)
SELECT {r("(SELECT avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0.0 END) FROM b x, b y WHERE x.y_true = 1 AND y.y_true <> 1)", 8)} AS auroc,
  {r("sum(pos * (pc + pb) / 2) / sum(pos)", 8)} AS auprc FROM q""")
def _areas(spark, sf):
    out = ev.binary_areas(binary(spark, sf))
    return out.select(rounded(F.col("auroc"), 8).alias("auroc"), rounded(F.col("auprc"), 8).alias("auprc"))


LEVELS = list(range(0, 101, 10))


def level_predictions(spark, sf):
    """Predictions at 11 noise levels: the noisy class with the level's probability, else the clean one."""
    p = predictions(spark, sf).withColumn("noise_level", F.explode(F.array(*[F.lit(f"{x}%noise") for x in LEVELS])))
    take = noise.draw(42, "id", purpose=40) < scalar.noise_probability(F.col("noise_level"))
    return p.select("noise_level", "y_true", F.when(take, F.col("y_noisy")).otherwise(F.col("y_pred")).alias("y_pred"))


LEVEL_ROWS = SCORES + f""", lv AS (SELECT l || '%noise' AS noise_level, y_true, CASE WHEN CAST({h32(42, 40, 'id')} AS DOUBLE) / 4294967296.0 < l / 100 THEN y_noisy ELSE y_pred END AS y_pred
  FROM p, range(0, 101, 10) t(l)),
"""


def sweep_sql(rows: str, by: str) -> str:
    return f"""cl AS (SELECT {by}, y_true AS c FROM {rows} UNION SELECT {by}, y_pred FROM {rows}),
t AS (SELECT {by}, y_true AS c, count(*) AS support, count(*) FILTER (y_true = y_pred) AS hit FROM {rows} GROUP BY ALL),
q AS (SELECT {by}, y_pred AS c, count(*) AS predicted FROM {rows} GROUP BY ALL),
mm AS (SELECT {by}, coalesce(support, 0) AS support, coalesce(hit, 0) AS hit, coalesce(hit / predicted, 0.0) AS precision, coalesce(hit / support, 0.0) AS recall
  FROM cl LEFT JOIN t USING ({by}, c) LEFT JOIN q USING ({by}, c))
SELECT {by}, {r('sum(hit) / sum(support)', 6)} AS accuracy, {r('avg(precision)', 6)} AS precision, {r('avg(recall)', 6)} AS recall,
  {r('avg(CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END)', 6)} AS f1 FROM mm GROUP BY {by}"""


def _summary(rows, by):
    out = ev.sweep_summary(rows, [by])
    return out.select(by, *[rounded(F.col(c), 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("noise_level_sweep", LEVEL_ROWS + sweep_sql("lv", "noise_level"))
def _levels(spark, sf):
    return _summary(level_predictions(spark, sf), "noise_level")


CONFIGS = [f"{k}_{int(100 * x)}_percent" for k in noise.SWEEP_KINDS for x in noise.SWEEP_LEVELS]


@query("noise_set_sweep", SCORES + ", st AS (SELECT noise_config, y_true, CASE WHEN (id + i) % 3 = 0 THEN y_noisy ELSE y_pred END AS y_pred FROM p, (VALUES "
       + ", ".join(f"('{c}', {i})" for i, c in enumerate(CONFIGS)) + ") t(noise_config, i)),\n" + sweep_sql("st", "noise_config"))
def _sets(spark, sf):
    """One predictions table for all 16 noise sets; every third sample takes its noisy class."""
    sets = F.array(*[F.struct(F.lit(c).alias("noise_config"), F.lit(i).alias("i")) for i, c in enumerate(CONFIGS)])
    rows = predictions(spark, sf).select("*", F.inline(sets))
    pred = F.when((F.col("id") + F.col("i")) % 3 == 0, F.col("y_noisy")).otherwise(F.col("y_pred"))
    return _summary(rows.select("noise_config", "y_true", pred.alias("y_pred")), "noise_config")


@query("equalised_loss", LEVEL_ROWS + f"""a AS (SELECT noise_level, 100 * avg(CAST(y_true = y_pred AS DOUBLE)) AS acc FROM lv GROUP BY noise_level)
SELECT x.noise_level, {r('(100 - x.acc) / y.acc', 6)} AS ela FROM a x, a y WHERE y.noise_level = '0%noise'""")
def _ela(spark, sf):
    acc = ev.accuracy(level_predictions(spark, sf), by=["noise_level"]).withColumn("a", 100 * F.col("accuracy"))
    base = acc.where("noise_level = '0%noise'").select("a").scalar()
    return acc.select("noise_level", rounded(ev.equalised_loss(base, F.col("a")), 6).alias("ela"))


@query("noise_probability", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1.0::DOUBLE ELSE (event_id % 101) / 100.0::DOUBLE END AS p FROM events")
def _probability(spark, sf):
    text = F.when(F.col("event_id") % 3 == 0, F.lit("noise")).otherwise(F.concat((F.col("event_id") % 101).cast("string"), F.lit("%noise")))
    return fx.table(spark, sf, "events").select("event_id", scalar.noise_probability(text).alias("p"))


def reconstruction(spark, sf):
    """Line items as predicted and true values, with target and padding flags."""
    return fx.table(spark, sf, "lineitem").select(
        (F.col("l_quantity") * 1500).alias("pred"), F.col("l_extendedprice").alias("true"),
        (F.col("l_orderkey") % 7 == 0).alias("target"), (F.col("l_linenumber") <= 5).alias("valid"), "l_returnflag",
        (F.col("l_discount") + 0.01).alias("lat_pred"), F.col("l_discount").alias("lat"), F.col("l_tax").alias("lon"), (F.col("l_tax") * 1.5).alias("lon_pred"))


RECON = "WITH x AS (SELECT pow(l_quantity * 1500 - l_extendedprice, 2) AS e, l_orderkey % 7 = 0 AS tg, l_linenumber <= 5 AS ok, l_returnflag, l_discount, l_tax FROM lineitem) "


@query("masked_mse", RECON + f"SELECT l_returnflag, {r('avg(e)', 2)} AS mse, count(*) AS n FROM x WHERE tg AND ok GROUP BY l_returnflag")
def _mse(spark, sf):
    out = ev.masked_mse(reconstruction(spark, sf), "pred", "true", F.col("target") & F.col("valid"), ["l_returnflag"])
    return out.withColumn("mse", rounded(F.col("mse"), 2))


@query("weighted_error", RECON + f"""SELECT {r('avg(e) FILTER (tg AND ok)', 2)} AS imputation, {r('avg(e) FILTER (NOT tg AND ok)', 2)} AS denoising,
  {r('1.0 * avg(e) FILTER (tg AND ok) + 0.5 * avg(e) FILTER (NOT tg AND ok)', 2)} AS total, {r('avg(CASE WHEN tg THEN e ELSE 0.5 * e END) FILTER (ok)', 2)} AS per_element FROM x""")
def _weighted(spark, sf):
    out = ev.weighted_error(reconstruction(spark, sf), "pred", "true", F.col("target"), F.col("valid"), 1.0, 0.5)
    return out.select(*[rounded(F.col(c), 2).alias(c) for c in out.columns])


@query("coordinate_error", RECON + f"SELECT {r('avg(pow(0.01::DOUBLE, 2) + pow(l_tax * 0.5::DOUBLE, 2)) / 2', 8)} AS mse FROM x WHERE tg AND ok")
def _coordinate(spark, sf):
    out = ev.coordinate_error(reconstruction(spark, sf), F.col("target"), F.col("valid"))
    return out.select(rounded(F.col("mse"), 8).alias("mse"))


@query("best_rows", """WITH m AS (SELECT event_type AS model, CAST(floor(event_id / 1000) AS BIGINT) AS epoch, round(avg(value), 4) AS accuracy FROM events GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY accuracy DESC, epoch) AS rk FROM m) SELECT model, epoch, accuracy FROM o WHERE rk = 1""")
def _best(spark, sf):
    m = fx.table(spark, sf, "events").groupBy(F.col("event_type").alias("model"), F.floor(F.col("event_id") / 1000).alias("epoch")).agg(
        F.round(F.avg("value"), 4).alias("accuracy"))
    return ev.best_rows(m, ["model"], "accuracy")


MODELS = """WITH w AS (SELECT l_returnflag || l_linestatus AS model, CAST(year(l_shipdate) AS INT) AS dataset, round(avg(l_discount), 6) AS "ACC",
  round(avg(l_tax), 6) AS "AUC", round(avg(l_quantity), 4) AS "F1" FROM lineitem GROUP BY ALL),
lg AS (SELECT model, dataset, metric, value FROM w UNPIVOT (value FOR metric IN ("ACC", "AUC", "F1")))"""
RANKED = MODELS + """, rk AS (SELECT *, CAST(rank() OVER (PARTITION BY dataset, metric ORDER BY value DESC) AS INT) AS rank FROM lg)"""


def model_scores(spark, sf):
    """Mean discount, tax and quantity per flag and year, as three metrics of models on datasets."""
    wide = fx.table(spark, sf, "lineitem").groupBy(
        F.concat("l_returnflag", "l_linestatus").alias("model"), F.year("l_shipdate").alias("dataset")
    ).agg(F.round(F.avg("l_discount"), 6).alias("ACC"), F.round(F.avg("l_tax"), 6).alias("AUC"), F.round(F.avg("l_quantity"), 4).alias("F1"))
    return ranks.to_long(wide, ["model", "dataset"], ["ACC", "AUC", "F1"])


@query("scores_long", MODELS + " SELECT model, dataset, metric, value FROM lg")
def _long(spark, sf):
    return model_scores(spark, sf)


@query("scores_wide", MODELS + " FROM (PIVOT lg ON dataset USING max(value) GROUP BY metric, model)")
def _wide(spark, sf):
    return ranks.to_wide(model_scores(spark, sf), ["metric", "model"])


@query("competition_ranks", RANKED + " SELECT model, dataset, metric, value, rank FROM rk")
def _ranks(spark, sf):
    return ranks.competition_ranks(model_scores(spark, sf))


@query("mean_rank", RANKED + f" SELECT metric, model, {r('avg(rank)', 6)} AS avg_rank, count(*) AS datasets FROM rk GROUP BY metric, model")
def _mean_rank(spark, sf):
    out = ranks.mean_ranks(ranks.competition_ranks(model_scores(spark, sf)))
    return out.withColumn("avg_rank", rounded(F.col("avg_rank"), 6))


@query("friedman", RANKED + f""", mr AS (SELECT metric, model, avg(rank) AS ar, count(*) AS n FROM rk GROUP BY metric, model)
SELECT metric, count(*) AS models, max(n) AS datasets, {r('12 * max(n) / (count(*) * (count(*) + 1)) * (sum(ar * ar) - count(*) * pow(count(*) + 1, 2) / 4)', 6)} AS chi2 FROM mr GROUP BY metric""")
def _friedman(spark, sf):
    out = ranks.friedman(ranks.mean_ranks(ranks.competition_ranks(model_scores(spark, sf))))
    return out.withColumn("chi2", rounded(F.col("chi2"), 6))
