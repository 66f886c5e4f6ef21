"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tripmill.llm import variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def want_of(rows):
    times = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            times[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: c for w, c in times.items() if c >= 3 and len(w) >= 5}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, listed in near.items():
        best = min(listed, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(near[w]), form[w] and n[form[w]]) for w in n)


def found_of(docs):
    return sorted((tuple(r) for r in variants.spelling_forms(docs).collect()), key=lambda r: r[0])


def corpus():
    draw = random.Random(6)
    letters = "abÀéÿ×"
    base = ["".join(draw.choices(letters, k=draw.randint(4, 9))) for _ in range(120)]
    bag = []
    for k, w in enumerate(base):
        bag += [w] * draw.choice([3, 8, 40])
        for _ in range(6):
            w = w or "ab"
            at, x = draw.randrange(len(w)), draw.choice(letters)
            w = draw.choice([w[:at] + x + w[at:], w[:at] + w[at + 1:], w[:at] + x + w[at + 1:]])
            bag += [w.upper() if k % 3 == 0 and w.isascii() else w] * draw.choice([1, 3, 4, 9])
    draw.shuffle(bag)
    rows = [(i, draw.choice([" ", "-", "1"]).join(bag[i::60])) for i in range(60)]
    return rows + [(None, "aaaaaa " * 50), (None, None), (70, ""), (71, "ĀÀbcde" * 3), rows[0], (72, "abcdé " * 20000)]


def test_forms(docs_of):
    rows = corpus()
    want = want_of(rows)
    assert len(want) > 300 and sum(r[1] is not None for r in want) > 100 and any(r[1] != r[2] != r[0] for r in want if r[1])
    assert found_of(docs_of(rows)) == want


@pytest.mark.parametrize("letters, size", [("ab", 5), ("abc", 6), ("abcdefgh", 4)])
def test_compositions(letters, size):
    """All pairs of the composed acceptors, each once, and nothing else; equal languages share a state."""
    draw = random.Random(size)
    short = sorted({"".join(draw.choices(letters, k=size)) for _ in range(60)})
    long = sorted({"".join(draw.choices(letters, k=size + 1)) for _ in range(60)})
    want = {(a, b) for a in short for b in short if a < b and one_edit(a, b)} | {(a, b) for a in short for b in long if one_edit(a, b)}
    assert variants.near_pairs(short, long) == want
    acceptor = variants.Acceptor()
    top = acceptor.add(["abxy", "acxy", "adxy"])
    assert len(set(acceptor.arcs[acceptor.arcs[top]["a"]].values())) == 1 and len(acceptor.arcs) == 5


def test_every_pair_meets_once_in_a_state(spark):
    """Words over a small alphabet have pairs with the edit at every place."""
    draw = random.Random(2)
    n = {"".join(draw.choices("ab", k=draw.randint(5, 8))): draw.randint(3, 90) for _ in range(300)}
    found = {r.word: (r.n_near, r.best_n, r.best) for r in variants.near_words(spark.createDataFrame(list(n.items()), "word string, n bigint")).collect()}
    want = {}
    for w in n:
        if near := [v for v in n if one_edit(w, v)]:
            best = min(near, key=lambda v: (-n[v], v))
            want[w] = (len(near), n[best], best)
    assert found == want


def test_long_chains_and_empty_tables(spark, docs_of):
    chain = [(f"w{k:02d}", f"w{k + 1:02d}" if k < 40 else None) for k in range(41)]
    found = variants.with_roots(spark.createDataFrame(chain, "word string, form string")).collect()
    assert {r.word: r.root for r in found} == {f"w{k:02d}": "w40" for k in range(40)}
    assert variants.spelling_forms(docs_of([])).isEmpty()
