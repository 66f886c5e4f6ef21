"""Sketches against exact sets, edits against Python strings."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tripmill.llm import sketches


def shingles(text):
    words = (text or "").encode().split()
    return {tuple(words[i: i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def rows():
    draw = random.Random(7)
    word = lambda: "".join(draw.choices("abé😀", k=draw.randint(1, 4)))
    out = [(i * 3, " ".join(word() for _ in range(draw.choice([0, 1, 4, 5, 6, 40, 90])))) for i in range(50)]
    return out + [(7, None), (8, ""), (1000, "\t\n "), (-5, " a b\x0bc d\re f ")]


def test_edits_and_likeness(docs_of):
    table = rows()
    got = {r.doc_id: r for r in sketches.with_edits(docs_of(table)).select(
        "doc_id", "n_chars", "edited_sha256", "sketch", sketches.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near"),
        sketches.resemblance(F.col("sketch"), F.col("next_sketch")).alias("next"),
        sketches.containment(F.col("sketch"), F.col("edited_sketch")).alias("inside"),
        sketches.distinct_count(F.col("sketch")).alias("distinct")).collect()}
    order = sorted((i, t or "") for i, t in table)
    assert len(got) == len(order)
    for place, (i, text) in enumerate(order):
        after = order[(place + 1) % len(order)][1]
        moved = len(text) // 4
        edited = text[: len(text) - moved] + after[:moved]
        a, b, c = shingles(text), shingles(edited), shingles(after)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert len(r.sketch) == min(len(a), sketches.K) and r.sketch == sorted(r.sketch)
        # Fewer shingles than a sketch holds: all figures are exact.
        assert r.distinct == len(a)
        assert r.near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert r.next == pytest.approx(len(a & c) / len(a | c) if a | c else 1.0)
        assert r.inside == pytest.approx(len(a & b) / len(a) if a else 1.0)


def test_estimates_of_long_texts(spark):
    words = [f"w{i}" for i in range(6000)]
    texts = [(" ".join(words[:4000]), " ".join(words[1000:5000])), (" ".join(words[:2000]), " ".join(words))]
    found = spark.createDataFrame(texts, "a string, b string").select(
        sketches.sketch(F.col("a")).alias("a"), sketches.sketch(F.col("b")).alias("b")).select(
        sketches.resemblance(F.col("a"), F.col("b")), sketches.containment(F.col("a"), F.col("b")), sketches.distinct_count(F.col("b"))).collect()
    assert found[0][0] == pytest.approx(0.6, abs=0.15) and found[0][1] == pytest.approx(0.75, abs=0.2)
    assert found[1][1] == pytest.approx(1.0, abs=0.3) and found[1][2] == pytest.approx(5996, rel=0.3)


def test_parts_merge_to_the_sketch_of_all(spark, monkeypatch):
    monkeypatch.setattr(sketches, "FAN_IN", 4)
    parts = [("k", " ".join(f"{g}-{i}" for i in range(5))) for g in range(40)] + [(None, "a b c d e"), (None, "f g h i j")] + [("k", "0-0 0-1 0-2 0-3 0-4")]
    table = spark.createDataFrame(parts, "key string, text string")
    merged = sketches.merge_parts(table.select("key", sketches.sketch(F.col("text"), 8).alias("sketch")), ["key"], 8)
    got = {r["key"]: r.sketch for r in merged.collect()}
    every = table.groupBy("key").agg(F.flatten(F.collect_list(sketches.sketch(F.col("text"), 8))).alias("s")).collect()
    assert got == {r["key"]: sorted(set(r.s))[:8] for r in every}


def test_ring_of_ids(spark, docs_of):
    assert sketches.with_edits(docs_of([])).isEmpty()
    one = sketches.with_edits(docs_of([(4, "abcdefgh")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    got = sorted((str(r.doc_id), r.n_chars) for r in sketches.with_edits(docs_of([(1, "aaaa"), (1, "aaaa"), (1, "b" * 8), (None, "cc"), (None, None)])).collect())
    assert got == [("1", 4), ("1", 4), ("1", 8), ("None", 0), ("None", 2)]


def test_no_python_in_the_plan(docs_of):
    plan = sketches.with_edits(docs_of(rows()))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
