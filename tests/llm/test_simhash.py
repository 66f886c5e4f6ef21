"""Fingerprints, links and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from tripmill.llm import simhash
from tripmill.llm.components import components


def brute_print(text, size):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i: i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(items, linked):
    """The smallest item reachable from each."""
    up = {i: i for i in items}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in items:
        for b in items:
            if a < b and linked(a, b) and top(a) != top(b):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in items}


def corpus():
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdeABÇ", k=draw.randint(1, 6)))
    rows = []
    for i in range(60):
        words = [word() for _ in range(draw.choice([0, 1, 3, 4, 40, 200]))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(draw.choice([0, 0, 1, 3])):
            if words:
                words[draw.randrange(len(words))] = word()
            rows.append((len(rows), "\t".join(words) + " "))
    return rows + [(500, None), (501, " \n"), (502, rows[7][1])]


@pytest.mark.parametrize("group", [4096, 8])
def test_groups(docs_of, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)  # 8: large groups are compared in parts
    rows = corpus()
    prints = {i: brute_print(t, 4) for i, t in rows}
    want = joined(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = simhash.near_groups(docs_of(rows)).collect()
    assert {r.doc_id: r.f0 % 2**64 for r in got} == prints
    assert {r.doc_id: r.first_id for r in got} == want


def test_no_link_is_missed():
    """Dense clusters, with every number of differing bits around the limit, through all tables together."""
    draw = np.random.default_rng(1)
    base = draw.integers(0, 2**63, 12, dtype=np.uint64)
    prints = list(base)
    for b in base:
        for n in (1, 2, 3, 4, 4, 5, 6):
            bits = np.uint64(1) << draw.choice(64, n, replace=False).astype(np.uint64)
            prints.append(b ^ np.bitwise_or.reduce(bits))
    prints = np.unique(np.array(prints, np.uint64))
    where = {}
    for places in simhash.tables(4):
        mask = sum(1 << p for p in places)
        for i, p in enumerate(prints.tolist()):
            where.setdefault((mask, p & mask), []).append(i)
    labels = np.arange(len(prints))
    for group in where.values():
        own = np.arange(len(group))
        simhash.near_pairs(prints[group][:, None], 4, own, most=7)
        simhash._merge(labels, np.array(group), np.array(group)[own])
    want = joined(range(len(prints)), lambda a, b: (int(prints[a]) ^ int(prints[b])).bit_count() <= 4)
    assert labels.tolist() == [want[i] for i in range(len(prints))]


def test_components(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 300)]
    edges += [(draw.randrange(400, 460), draw.randrange(400, 460)) for _ in range(50)] + [(5, 4), (5, 4)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    near = {tuple(sorted(e)) for e in edges}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    want = joined(nodes, lambda a, b: (a, b) in near)
    assert set(found) == set(nodes)
    assert len({(found[n], want[n]) for n in nodes}) == len(set(want.values())) == len(set(found.values()))
    assert components(spark.createDataFrame([], "u bigint, v bigint")).isEmpty()


def test_one_of_each_group_stays(docs_of):
    draw = random.Random(9)
    word = lambda: "".join(draw.choices("abcdefghij", k=6))
    clean = [(i, " ".join(word() for _ in range(300))) for i in range(30)]
    copies = []
    for i in range(10):
        words = clean[i][1].split()
        for n in range(3):
            changed = list(words)
            for _ in range(n * 2):
                changed[draw.randrange(len(words))] = word()
            copies.append((100 + 3 * i + n, " ".join(changed)))
    rows = clean + copies + [clean[20], (None, clean[3][1]), (None, "alone " * 7), (None, "alone " * 7)]
    kept = [(r.doc_id, r.text) for r in simhash.keep_first(docs_of(rows)).collect()]
    assert sorted(kept, key=str) == sorted([*clean, (None, "alone " * 7)], key=str)


def test_empty(docs_of):
    assert simhash.near_groups(docs_of([])).isEmpty() and simhash.keep_first(docs_of([])).isEmpty()


@pytest.mark.parametrize("group", [4096, 8])
def test_links_hold_on_both_sides_of_four_fifths(docs_of, monkeypatch, group):
    """Pairs just below 0.8 stay, pairs at 0.8 and above lose one; chains go by single links."""
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash.tensored, "GROUP", group // 8)
    draw = random.Random(3)
    word = lambda: "".join(draw.choices("abcdefghij", k=6))
    rows, twins = [], []
    for i in range(120):
        size = draw.choice([8, 24, 60, 150, 400])
        words = [word() for _ in range(size + 4)]
        rows.append((i, " ".join(words)))
        near = draw.choice([0.70, 0.75, 0.78, 0.79, 0.80, 0.81, 0.83, 0.9])
        cut = round(size * (1 - near))  # leaves size - cut of size shingles
        twins.append((1000 + i, " ".join(words[cut:])))
    chain = [word() for _ in range(130)]
    rows += twins + [(2000 + k, " ".join(chain[10 * k: 10 * k + 100])) for k in range(4)]  # neighbours share 86 of 106

    def shingles(text):
        words = text.split()
        return {tuple(words[i: i + 5]) for i in range(len(words) - 4)} or {tuple(words)}

    sets = {i: shingles(t) for i, t in rows}
    linked = lambda a, b: 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))
    want = joined(sorted(sets), linked)
    assert len(set(want.values())) > 130 and {want[2000 + k] for k in range(4)} == {2000}
    assert sorted(r.doc_id for r in simhash.keep_first(docs_of(rows)).collect()) == sorted(set(want.values()))


def test_sets_that_are_alike_share_a_key():
    draw = np.random.default_rng(4)
    for _ in range(200):
        values = draw.integers(0, 1 << 63, 100, dtype=np.uint64)
        one, two = (np.frombuffer(simhash.minima(x), np.int64) for x in (values[:90], values[10:]))  # 80 of 100
        assert (one == two).any()
    assert len(simhash.minima(values[:0])) == len(simhash.minima(values))
