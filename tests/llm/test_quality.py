"""The discriminant against its formula, on planted junk, and with nothing to learn from."""

import random

import numpy as np
from pyspark.sql import functions as F

from tripmill.llm import quality


def corpus():
    draw = random.Random(6)
    word = lambda: "".join(draw.choices("abcdefgh", k=draw.randint(2, 8)))
    rows, labels = [], []
    for i in range(300):
        words = [word() for _ in range(draw.randint(5, 200))]
        good = i % 4 > 0
        if not good:
            words = [[w.upper() + "!!" for w in words], [w + "###" for w in words], [words[0]] * len(words), [x for w in words for x in (w, "|")]][i // 4 % 4]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), "clash"))
    return rows, labels


def test_scores(spark, docs_of):
    rows, labels = corpus()
    labels += [(5, None, ""), (None, 1, ""), (7, 3, ""), (9999, 0, "")]
    extra = [(900, None), (901, ""), (None, rows[1][1]), (1, rows[1][1]), (902, "word " * 20000)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, text string")
    docs = docs_of(rows + extra)
    found = quality.scores(docs, table, learn=F.col("doc_id") % 5 > 0).collect()
    assert len(found) == len(rows) + len(extra)
    got = {r.doc_id: r for r in found}
    held = [i for i in range(0, 300, 5)]
    assert all(got[i].predicted == int(i % 4 > 0) for i in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert got[900].score == got[901].score and got[None].score == got[1].score and got[902].predicted == 0
    kept = quality.keep_good(docs, table, learn=F.col("doc_id") % 5 > 0)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in found if r.predicted)


def test_log_odds_are_a_difference_of_normal_densities():
    draw = np.random.default_rng(0)
    model = {"prior": 0.3, "classes": {}}
    x = draw.normal(size=(5, 3))
    want = np.full(5, 0.3)
    for label in (0, 1):
        a = draw.normal(size=(3, 3))
        cov, mean = a @ a.T + np.eye(3), draw.normal(size=3)
        factor = np.linalg.cholesky(cov)
        model["classes"][label] = (mean, np.linalg.inv(factor), np.log(np.diag(factor)).sum())
        density = -0.5 * np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean) - 0.5 * np.log(np.linalg.det(cov))
        want += density if label else -density
    assert np.allclose(quality.log_odds(model, x), want)


def test_nothing_to_learn(spark, docs_of):
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    docs = docs_of([(1, "a b c"), (2, None)])
    one = quality.scores(docs, labels, learn=F.lit(True)).collect()
    assert {round(r.score, 6) for r in one} == {round(2 / 3, 6)}
    none = quality.scores(docs, labels.limit(0), learn=F.lit(True)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.scores(docs_of([]), labels, learn=F.lit(True)).isEmpty()
