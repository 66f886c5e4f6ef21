"""Classifiers on a small separable table."""

from tripmill.operators import classify as cl
from tripmill.operators import evaluate as ev
from tripmill.operators import neighbours as nb


def test_grid_search_and_reload(spark, tmp_path):
    rows = spark.range(240).selectExpr("id", "cast(id % 3 as double) AS label", "id % 3 * 4.0 + id % 5 * 0.1 AS a", "id % 3 * -2.0 + id % 7 * 0.1 AS b")
    data = cl.assembled(rows, ["a", "b"]).fit(rows).transform(rows).cache()
    models = {n: m for n, m in cl.model_grid(2, 3, small=True).items() if n in ("decision_tree", "linear_svm")}
    best, table = cl.grid_search(data, models, folds=2)
    assert {r[0] for r in table} == set(models) and sum(r[3] for r in table) == 2
    cl.save_models(best, str(tmp_path))
    scored = cl.predict_all(cl.load_models(list(best), str(tmp_path)), data, ["id"])
    accuracy = {r["model"]: r["accuracy"] for r in ev.accuracy(scored, by=["model"]).collect()}
    assert accuracy["decision_tree"] == 1.0 and accuracy["linear_svm"] > 0.6


def test_neighbours_with_a_hot_cell(spark):
    """A third of the rows are one point; blocks of 16 rows still give the exact neighbours."""
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.concatenate([np.tile([1.0, 2.0, 3.0], (60, 1)), rng.normal(0, 2, (120, 3))])
    train = spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(x)], "id long, x array<double>, label int")
    q = rng.normal(0, 2, (40, 3))
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id long, x array<double>")
    got = cl.nearest_neighbours(train, queries, 5, fan=4, leaf=16, block=16).toPandas().sort_values(["qid", "place"])
    for i, v in enumerate(q):
        d = np.sqrt(((x - v) ** 2).sum(axis=1))
        want = np.lexsort((np.arange(len(x)), d))[:5]
        assert got[got["qid"] == i]["id"].tolist() == want.tolist()


def test_ball_tree_against_all_pairs(spark):
    """Several levels, ties by id, more neighbours than rows of a leaf."""
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.round(rng.normal(0, 3, (700, 2)), 1)
    train = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "id long, x array<double>, label int")
    q = np.concatenate([rng.normal(0, 4, (30, 2)), x[:5]])
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, qx array<double>")
    tree = nb.ball_tree(train, fan=3, leaf=20)
    assert tree.levels >= 3 and tree.points.groupBy("node").count().agg({"count": "max"}).first()[0] <= 20
    for k in (1, 30):
        got = nb.search(tree, queries, k).toPandas().sort_values(["qid", "place"])
        for i, v in enumerate(q):
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            assert got[got["qid"] == i]["id"].tolist() == np.lexsort((np.arange(len(x)), d))[:k].tolist()


def test_neighbours_in_a_grid_search(spark, tmp_path):
    """Cross-validated like any classifier; the saved model gives the same classes."""
    from pyspark.ml import Pipeline, PipelineModel

    rows = spark.range(180).selectExpr("id", "cast(id % 3 as double) AS label", "id % 3 * 4.0 + id % 5 * 0.1 AS a", "id % 3 * -2.0 + id % 7 * 0.1 AS b")
    data = cl.assembled(rows, ["a", "b"]).fit(rows).transform(rows).cache()
    best, table = cl.grid_search(data, {"nearest_neighbours": cl.model_grid(2, 3)["nearest_neighbours"]}, folds=3)
    assert len(table) == 6 and all(r[2] == 1.0 for r in table)
    cl.save_models(best, str(tmp_path))
    loaded = cl.load_models(list(best), str(tmp_path))
    assert loaded["nearest_neighbours"].stages[0].getOrDefault("k") == best["nearest_neighbours"].getOrDefault("k")
    scored = cl.predict_all({**loaded, "again": best["nearest_neighbours"]}, data, ["id"])
    assert scored.count() == 360 and scored.where("y_true <> y_pred").isEmpty()
    pipe = Pipeline(stages=[nb.NearestNeighbours(k=3, leaf=20, fan=4)]).fit(data)
    pipe.save(str(tmp_path / "deep"))
    again = PipelineModel.load(str(tmp_path / "deep"))
    assert again.stages[0].tree.levels > 0 and again.transform(data).where("label <> prediction").isEmpty()


def test_few_rows(spark):
    train = spark.createDataFrame([(1, [0.0], 2), (2, [1.0], 1)], "id long, x array<double>, label int")
    queries = spark.createDataFrame([(9, [0.2])], "id long, x array<double>")
    assert [r.id for r in cl.nearest_neighbours(train, queries, 5).orderBy("place").collect()] == [1, 2]
    assert cl.nearest_neighbours(train.limit(0), queries, 5).isEmpty() and cl.nearest_neighbours(train, queries.limit(0), 5).isEmpty()


def test_neighbours_store_no_visits(spark, monkeypatch):
    """A search stores nothing per query and leaf; pieces, shares and parts of equal rows give the exact neighbours."""
    import numpy as np

    draw = np.random.default_rng(9)
    x = draw.normal(size=(900, 8))
    x[600:] = x[0]
    train = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id bigint, x array<double>, label int")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:60:2])], "qid bigint, qx array<double>")
    want = [np.lexsort((np.arange(900), np.sqrt(((x - v) ** 2).sum(axis=1))))[:7].tolist() for v in x[:60:2]]
    tree = nb.ball_tree(train, fan=16, leaf=64)

    def stored(*_):
        raise AssertionError("a stage table in a search")

    monkeypatch.setattr(nb, "stage", stored)
    for sizes in ({}, {"PIECE": 300, "SHARE": 10, "PART": 20, "PAIRS": 640}):
        for name, value in sizes.items():
            monkeypatch.setattr(nb, name, value)
        got = nb.search(tree, queries, 7, block=16).toPandas().sort_values(["qid", "place"])
        assert [g["id"].tolist() for _, g in got.groupby("qid")] == want


def test_predictions_are_not_broadcast(spark):
    """A row per query does not go through the driver to meet its prediction, however small the table."""
    rows = spark.range(120).selectExpr("id", "cast(id % 3 as double) AS label", "id % 3 * 4.0 AS a", "id % 3 * -2.0 + id % 7 * 0.1 AS b")
    data = cl.assembled(rows, ["a", "b"]).fit(rows).transform(rows)
    scored = nb.NearestNeighbours(k=3).fit(data).transform(data)
    assert all(r["label"] == r["prediction"] for r in scored.collect())
    joins = [x for x in scored._jdf.queryExecution().simpleString().splitlines() if "Join [_qid" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


def test_queries_search_the_whole_grids(spark, monkeypatch):
    """Every choice of every model, over five folds, reaches the search of the registered queries."""
    from tripmill.plans import models

    asked = {}

    def search(train, grids, folds=5, parallelism=4):
        asked.update(folds=folds, train=train.count(), grids={name: [{p.name: v for p, v in m.items()} for m in grid] for name, (_, grid) in grids.items()})
        asked.update(rounds={name: e.getMaxIter() for name, e in (("network", grids["multilayer_perceptron"][0]), ("svm", grids["linear_svm"][0].getClassifier()))})
        return {}, [("none", "", 0.0, True)]

    monkeypatch.setattr(cl, "grid_search", search)
    rows = spark.range(20).selectExpr("id", "id % 4 = 0 AS is_test")
    models.searched(rows, spark)
    assert asked["folds"] == 5 and asked["train"] == 15 and asked["rounds"] == {"network": 200, "svm": 100}
    assert {name: len(grid) for name, grid in asked["grids"].items()} == {
        "random_forest": 12, "multilayer_perceptron": 2, "decision_tree": 6, "linear_svm": 2, "nearest_neighbours": 6}
    assert {m["maxDepth"] for m in asked["grids"]["random_forest"]} == {10, 20, 30} and {m["numTrees"] for m in asked["grids"]["random_forest"]} == {100, 200}
