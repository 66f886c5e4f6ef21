"""Bucket boundaries against all choices, and what batches must hold."""

import random
from collections import Counter, defaultdict
from itertools import combinations

from tripmill.llm import packing


def padding(histogram, edges):
    return sum(n * (min(e for e in edges if e >= x) - x) for x, n in histogram.items())


def test_boundaries_pad_least():
    draw = random.Random(5)
    for _ in range(200):
        histogram = {x: draw.randint(1, 9) for x in draw.sample(range(1, 40), draw.randint(1, 9))}
        buckets = draw.randint(1, 5)
        edges = packing.boundaries(histogram, buckets)
        assert edges == sorted(set(edges)) and len(edges) <= buckets and edges[-1] == max(histogram)
        rest = sorted(histogram)[:-1]
        best = min(padding(histogram, [*c, max(histogram)]) for k in range(min(buckets, len(histogram))) for c in combinations(rest, k))
        assert padding(histogram, edges) == best
    assert packing.boundaries({}, 4) == []


def test_batches(docs_of, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ROWS", 20)
    draw = random.Random(3)
    rows = [(i, " ".join("w" * draw.choice([1, 3, 3, 7, 20, 45]))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, " \n"), (None, "a b c"), (3, rows[3][1])]
    got = packing.pack(docs_of(rows), max_length=16, buckets=3, budget=32).collect()
    tokens, pieces = Counter(), defaultdict(list)
    for r in got:
        tokens[r.doc_id] += r.n_tokens
        pieces[r.doc_id].append(r.piece)
    want = Counter()
    for i, t in rows:
        want[i] += len((t or "").split())
    assert tokens == want and set(tokens) == set(want)
    assert all(sorted(set(p)) == list(range(max(p) + 1)) for p in pieces.values())
    assert all(r.bucket_length is None and r.batch is None for r in got if r.n_tokens == 0)
    full = [r for r in got if r.n_tokens]
    edges = packing.boundaries(Counter(r.n_tokens for r in full), 3)
    assert all(r.bucket_length == min(e for e in edges if e >= r.n_tokens) for r in full)
    sizes = Counter((r.bucket_length, r.batch) for r in full)
    for edge in edges:
        own = {b: n for (e, b), n in sizes.items() if e == edge}
        room = max(1, 32 // edge)
        assert sorted(own) == list(range(len(own)))
        assert all(n == room for b, n in own.items() if b < len(own) - 1) and own[len(own) - 1] <= room


def test_empty_tables(docs_of):
    assert packing.pack(docs_of([])).isEmpty()
    (row,) = packing.pack(docs_of([(1, None)])).collect()
    assert tuple(row) == (1, 0, 0, None, None)
