"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tripmill.llm import ranking

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def split(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def want_of(docs, items, most=10):
    bags = [(i, Counter(split(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    count, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, bag, n in bags:
            m = 25 + 75 * n * count // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
                        for t in split(text) if t in bag)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if gone else i, -s) for k, (s, gone, i) in enumerate(sorted(scores)[:most])]
    return sorted(out, key=str)


def corpus(number=900, seed=3):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdeÉ漢9", k=draw.randint(1, 5))) for _ in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    text = lambda n: draw.choice([" ", ", ", "\n"]).join(draw.choices(words, weights, k=n))
    docs = [(i, text(draw.choice([1, 5, 40, 200]))) for i in range(number)]
    docs += [(9000, None), (9001, ""), (9002, "_-+"), (None, docs[4][1]), docs[7], docs[7], (9003, "AB " * 400), (9004, text(60000))]
    items = [(k, text(draw.choice([1, 3, 30]))) for k in range(25)] + [(100, None), (101, ""), (102, "zzzz yyyy"), (103, "AB ab Ab"), (None, "a b c")]
    return docs, items + [items[0], (1, "another text a b")]


def found_of(spark, docs_of, docs, items, most=10):
    table = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in items], "item_id bigint, text string, score int, rank int, doc_id int")
    return sorted((tuple(r) for r in ranking.top_documents(docs_of(docs), table, most).collect()), key=str)


@pytest.mark.parametrize("shard, block", [(1 << 14, 128), (1100, 4)])
def test_ranks(spark, docs_of, monkeypatch, shard, block):
    monkeypatch.setattr(ranking, "SHARD_DOCS", shard)
    docs, items = corpus()
    assert found_of(spark, docs_of, docs, items) == want_of(docs, items)
    assert found_of(spark, docs_of, docs, items, 3) == want_of(docs, items, 3)


def test_blocks_of_queries(spark, docs_of, monkeypatch):
    monkeypatch.setattr(ranking, "QUERY_TERMS", 200)
    docs, items = corpus(80)
    assert found_of(spark, docs_of, docs, items) == want_of(docs, items)


def test_blocks_stay_closed():
    """With a score to beat, blocks of common terms are not decompressed, and what is found is right."""
    draw = np.random.default_rng(5)
    docs = 12000
    lengths = draw.integers(50, 400, docs)
    posts = []
    for term, share in enumerate((0.9, 0.7, 0.3, 0.004, 0.002)):
        doc = np.flatnonzero(draw.random(docs) < share)
        posts.append((doc, np.full(len(doc), term), np.where(draw.random(len(doc)) < 0.01, 300, draw.integers(1, 4, len(doc)))))
    total = int(lengths.sum())
    batch = ranking._shard(docs, total, [np.arange(docs)], [lengths], posts)
    row = {c: v[0] for c, v in batch.to_pydict().items()}
    row = {c: np.array(v) if isinstance(v, list) else v for c, v in row.items()}
    shard = ranking.Shard(row, docs, total)
    query = {0: 100, 1: 300, 2: 1200, 3: 5500, 4: 12400}
    score = np.zeros(docs, np.int64)
    for doc, term, tf in posts:
        score[doc] += query[int(term[0])] * (10**9 * tf // (1000 * tf + 8 * (25 + 75 * lengths[doc] * docs // total)))
    best = np.sort(score)[-10]
    found, scores = shard.search(query, 0, 10)
    assert sorted(found[np.argsort(scores)[-10:]]) == sorted(np.argsort(score, kind="stable")[-10:])
    assert (score[found] == scores).all() and (scores >= best).all()
    shard.opened = 0
    assert len(shard.search(query, int(score.max()) + 1, 10)[0]) == 0 and shard.opened < len(shard.first) / 2


def test_empty(spark, docs_of):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert ranking.top_documents(docs_of([]), some).isEmpty()
    assert ranking.top_documents(docs_of([(1, "a b")]), none).isEmpty()
    assert ranking.top_documents(docs_of([(1, None), (2, "")]), some).isEmpty()
