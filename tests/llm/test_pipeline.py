"""The pipeline on the smallest tables: what each stage must take away, and nothing else."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.cache()]
    for _, step in pipeline.STAGES:
        docs = step(spark, docs, SF).cache()
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns(results):
    for df in results[:-1]:
        assert df.columns == pipeline.COLUMNS
    assert [name for name, _ in pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontamination", "packing"]


def test_quality_keeps_what_is_labelled_good(spark, results):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = texts(results[0]), texts(results[1])
    wrong = [i for i in before if i in labels and (i in after) != (labels[i] == 1)]
    assert len(wrong) <= 0.03 * len(labels)
    assert all(after[i] == before[i] for i in after)


def test_near_duplicates_leave_one_of_each_group(results):
    before, after = texts(results[1]), texts(results[2])

    def shingles(text):
        words = text.lower().split()
        return {tuple(words[i: i + 5]) for i in range(len(words) - 4)} or {tuple(words)}

    sets = {i: shingles(t) for i, t in before.items()}
    near = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    for i in before:
        others = [near(i, j) for j in before if j != i]
        if i not in after:  # nothing goes without a near copy
            assert max(others) >= 0.8
        elif max(others) >= 0.9:  # clear copies: only one is left
            assert not [j for j in after if j != i and near(i, j) >= 0.9]


def test_repeated_passages(results):
    before, after = texts(results[2]), texts(results[3])
    first = {}
    words = {i: t.split() for i, t in before.items()}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k: k + 50]), i)
    for i, w in words.items():
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k: k + 50])] < i for j in range(k, k + 50)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        assert after.get(i, "").split() == kept
        if not gone:
            assert after[i] == before[i]
    assert all(r.n_chars == len(r.text) for r in results[3].collect())


def test_decontamination(spark, results):
    items = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = texts(results[3]), texts(results[4])
    held = {" ".join(words) for words in items}
    for i, t in before.items():
        whole = " " + " ".join(re.findall(r"\w+", t.lower())) + " "
        assert (i not in after) == any(f" {x} " in whole for x in held)


def test_packing_holds_all_words(results):
    got = {r.doc_id: r.n for r in results[5].groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert got == {i: len(t.encode().split()) for i, t in texts(results[4]).items()}


def test_run_is_the_stages_in_turn(spark, results):
    found = pipeline.run(spark, SF)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, results[5].collect()), key=str)
    assert entry.queries()["pipeline"] is pipeline.run


def test_empty_documents(spark, results):
    docs = results[0].limit(0)
    for _, step in pipeline.STAGES:
        docs = step(spark, docs, SF)
        assert docs.isEmpty()


def test_every_operator_has_a_query():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
