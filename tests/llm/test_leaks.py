"""Block-max WAND against scores of all pairs, and planted items."""

import random
from collections import Counter

import pytest

from tripmill.llm import leaks


def vocabulary(draw):
    common = ["the", "of", "and", "to", "is"]
    rare = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(300)]
    return lambda: draw.choice(common) if draw.random() < 0.4 else draw.choice(rare)


@pytest.mark.parametrize("postings, ranges", [(2, 4), (16, 64)])
def test_search_finds_all_above_threshold(monkeypatch, postings, ranges):
    monkeypatch.setattr(leaks, "POSTINGS", postings)
    monkeypatch.setattr(leaks, "RANGES", ranges)
    draw = random.Random(postings)
    word = vocabulary(draw)
    items = {i: [word() for _ in range(draw.randint(1, 30))] for i in range(80)}
    frequency = Counter(w for words in items.values() for w in set(words))
    index = leaks.Index(items, frequency, len(items), sum(map(len, items.values())) / len(items))
    for threshold in (0.05, 0.2, 0.6):
        for _ in range(60):
            words = [word() for _ in range(draw.randint(0, 200))]
            if draw.random() < 0.5:
                words[10:10] = draw.choice(list(items.values()))
            step = index.longest
            for start in range(0, max(1, len(words) - step), step):
                terms = sorted({index.terms[w] for w in words[start: start + 2 * step] if w in index.terms})
                scores = [sum(dict(zip(index.items[t], index.impacts[t])).get(i, 0.0) for t in terms) for i in range(len(items))]
                want = [i for i, s in enumerate(scores) if s >= threshold - 1e-9]
                assert sorted(i for i, _ in index.search(terms, threshold)) == want
                if want:
                    assert start in [p[0] for p in index.passages(words, threshold)]


def planted():
    draw = random.Random(11)
    word = vocabulary(draw)
    items = [(i, " ".join(word() for _ in range(draw.randint(8, 40))).capitalize() + ".") for i in range(50)]
    rows, want = [], set()
    for i in range(120):
        parts = [" ".join(word() for _ in range(draw.randint(0, 150))) for _ in range(2)]
        if i % 3 == 0:
            item = draw.choice(items)
            parts.insert(1, item[1].upper() if i % 2 else item[1].replace(" ", "\n"))
            want.add((i, item[0]))
        rows.append((i, " ".join(parts)))
    return rows, items, want


@pytest.mark.parametrize("index_words", [500_000, 150])
def test_planted_items(spark, docs_of, monkeypatch, index_words):
    monkeypatch.setattr(leaks, "INDEX_WORDS", index_words)  # 150: several indexes, a scan each
    rows, items, want = planted()
    rows += [(500, None), (501, ""), (None, items[3][1]), (0, rows[0][1])]
    items += [(90, None), (91, "..."), (None, items[5][1]), items[2]]
    docs = docs_of(rows)
    table = spark.createDataFrame([(*i, "clash") for i in items], "item_id bigint, text string, doc_id string")
    found = {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs, table).collect()}
    assert found == want | {(None, 3)}
    kept = leaks.without_leaks(docs, table)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, _ in rows if i is not None} - {i for i, _ in want})


def test_question_and_answer():
    words = [f"w{i}" for i in range(20)]
    index = leaks.Index({1: words}, dict.fromkeys(words, 1), 1, 20.0)
    assert list(index.matches(words)) == [1]
    assert not index.matches(words[:15] + ["x"] * 5)  # the answer is missing
    assert leaks.parts(["one"]) == (["one"], ["one"])


def test_changed_words_hide_no_leak():
    """One changed, dropped or added word at every place of an item, and each two changed words of its answer."""
    draw = random.Random(4)
    word = vocabulary(draw)
    items = {i: [word() for _ in range(n)] for i, n in enumerate([15, 16, 18, 23, 30, 45, 59])}
    frequency = Counter(w for words in items.values() for w in set(words))
    index = leaks.Index(items, frequency, len(items), sum(map(len, items.values())) / len(items))
    for i, words in items.items():
        n, later = len(words), len(words) - len(leaks.parts(words)[1])
        edits = [words[:k] + new + words[k + 1:] for k in range(n) for new in (["changed"], [], [words[k], "added"])]
        edits += [[w if j not in (a, b) else "changed" for j, w in enumerate(words)] for a in range(later, n) for b in range(a)]
        for edit in edits:
            text = [word() for _ in range(draw.randint(0, 90))] + edit + [word() for _ in range(draw.randint(0, 90))]
            assert i in index.matches(text), (i, edit)
        for _ in range(20):  # question without its answer
            other = [f"other{k}" for k in range(n - later)]
            assert i not in index.matches([word() for _ in range(30)] + words[:later] + other)


def test_words_in_order():
    assert leaks.in_order("a b c a d".split(), "x a c b a".split()) == 3
    assert [leaks.allowed(n) for n in (1, 2, 3, 4, 10, 15, 45)] == [0, 1, 1, 2, 2, 3, 9]


def test_empty(spark, docs_of):
    items = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert leaks.find_leaks(docs_of([]), items).isEmpty()
    assert leaks.find_leaks(docs_of([(1, "a b c")]), items.limit(0)).isEmpty()
    assert leaks.without_leaks(docs_of([(1, "a b c")]), items.limit(0)).count() == 1
