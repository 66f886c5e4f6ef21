"""Token counts against a tokenizer library, sums over segmentations against enumeration, and language prediction."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripmill.llm import language, pieces, token_counts

ODD = ["", " ", "  a  b ", "日本語 テキスト 😀😀 x", "a\n\nb\tc", "<s> <0x41> <unk>", "x" * 3000, "▁a ▁", "é́ ẞ ﬁ ​", "😀" * 9]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.read_vocabulary()


def unigram(vocab, scores, fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.Unigram(list(zip(vocab, scores)), 0, fallback))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement=pieces.MARK, prepend_scheme="always", split=True)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_counts_are_the_tokenizer_s(vocabulary):
    vocab, scores, kinds = vocabulary
    draw = random.Random(1)
    texts = ODD + ["".join(draw.choices("abcdetn  ▁.é日", k=draw.randint(0, 60))) for _ in range(500)]
    assert token_counts.TokenCounter(vocab, scores, kinds).count(texts) == unigram(vocab, scores, True)(texts)


def test_ties_and_unknown_characters():
    """A small vocabulary with many equal scores and no bytes: ties and fused unknown pieces are the tokenizer's too."""
    draw = random.Random(2)
    for _ in range(60):
        vocab = ["<unk>", pieces.MARK, *dict.fromkeys("".join(draw.choices("ab▁c", k=draw.randint(1, 4))) for _ in range(12))]
        vocab = list(dict.fromkeys(vocab))
        scores = [float(draw.randint(-3, 0)) for _ in vocab]
        texts = ["".join(draw.choices("abcd e", k=draw.randint(0, 14))) for _ in range(40)]
        assert token_counts.TokenCounter(vocab, scores, [0] * len(vocab)).count(texts) == unigram(vocab, scores, False)(texts)


def test_kept_units_do_not_change_counts(vocabulary):
    counter = token_counts.TokenCounter(*vocabulary, keep=3)
    whole = token_counts.TokenCounter(*vocabulary)
    texts = ["the cat sat on the mat", "the mat", "a cat sat", "mat cat the on"] * 2
    assert [counter.count([t])[0] for t in texts] == whole.count(texts)


def test_count_table(docs_of, vocabulary):
    rows = [(1, "hello world"), (2, None), (3, ""), (None, "hello world"), (1, "hello world")]
    got = token_counts.with_token_counts(docs_of(rows)).collect()
    (n,) = unigram(*vocabulary[:2], True)(["hello world"])
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == [(1, n), (1, n), (2, 0), (3, 0), (None, n)]
    assert token_counts.with_token_counts(docs_of([])).isEmpty()


def segmentations(text, vocab):
    if not text:
        yield []
    for i in range(1, len(text) + 1):
        if text[:i] in vocab:
            for rest in segmentations(text[i:], vocab):
                yield [text[:i], *rest]


def test_sums_over_all_segmentations():
    vocab = ["a", "b", "ab", "ba", "aba", pieces.MARK, pieces.MARK + "a"]
    share = np.random.default_rng(0).dirichlet(np.ones(len(vocab)), 2).T
    probabilities = np.vstack([share, [[1e-6, 1e-6]]])
    matcher = pieces.Matcher(vocab)
    units = [pieces.MARK + u for u in ("", "a", "abab", "babba", "aabaabab")]
    alpha, (lengths, _) = language.forward(matcher, units, probabilities)
    number = {p: i for i, p in enumerate(vocab)}
    for i, u in enumerate(units):
        each = [np.prod(share[[number[p] for p in s]], axis=0) for s in segmentations(u, number)]
        assert np.allclose(alpha[i, lengths[i]], np.sum(each, axis=0))
    weights = np.array([2.0, 1.0, 3.0, 1.0, 5.0])
    counts = language.expected_counts(matcher, units, weights, probabilities[:, 0])
    want = np.zeros(len(vocab))
    for u, w in zip(units, weights):
        each = [(s, np.prod(share[[number[p] for p in s], 0])) for s in segmentations(u, number)]
        for s, p in each:
            np.add.at(want, [number[x] for x in s], w * p / sum(q for _, q in each))
    assert np.allclose(counts[:-1], want) and counts[-1] == 0


def test_long_words_are_scored_whole(monkeypatch):
    """Words of up to 900 characters against exact fractions, over many blocks; short ones as by plain sums."""
    monkeypatch.setattr(language, "BLOCK", 7)
    draw = random.Random(3)
    vocab = ["a", "b", "ab", "ba", "aba", "bbabab", "abababababa", pieces.MARK, pieces.MARK + "a"]
    share = np.random.default_rng(1).dirichlet(np.ones(len(vocab)), 3).T
    probabilities = np.vstack([share, np.full((1, 3), 1e-6)])
    matcher, number = pieces.Matcher(vocab), {p: i for i, p in enumerate(vocab)}
    words = [pieces.MARK + "".join(draw.choices("abx", [9, 9, 1], k=n)) for n in (0, 1, 6, 11, 12, 13, 40, 200, 200, 900)] + [pieces.MARK + "x" * 300]
    got = language.long_logs(matcher, words, probabilities)
    for row, w in zip(got, words):
        for c in range(3):
            sums = [Fraction(1)] + [Fraction(0)] * len(w)
            for e in range(1, len(w) + 1):
                for p, i in number.items():
                    if e >= len(p) and w[e - len(p) : e] == p:
                        sums[e] += sums[e - len(p)] * Fraction(share[i, c])
                if w[e - 1] not in number:
                    sums[e] += sums[e - 1] * Fraction(1e-6)
            want = math.log(sums[-1].numerator) - math.log(sums[-1].denominator)
            assert math.isclose(row[c], want, rel_tol=1e-10)
    alpha, (lengths, _) = language.forward(matcher, words[:6], probabilities)
    assert np.allclose(np.log(alpha[np.arange(6), lengths]), got[:6])


def test_kept_numbers_do_not_grow_with_languages():
    for many in (4, 100):
        model = {"languages": [str(i) for i in range(many)], "pieces": ["a"], "probabilities": np.full((2, many), 0.5), "prior": np.zeros(many)}
        scorer = language.Scorer(model, f"test-{many}")
        assert scorer.known.size * many <= language.KEPT and scorer.most * many <= language.CELLS
        assert scorer.posterior(["a" * 5000 + " a", "", None])[0][0] == "0"


def test_language(spark):
    draw = random.Random(4)
    sounds = {"xx": ["ka", "ro", "tin", "mu"], "yy": ["sch", "ei", "ung", "ber"], "zz": ["ção", "nha", "que", "ra"]}
    text = lambda lang, n: " ".join("".join(draw.choices(sounds[lang], k=draw.randint(1, 4))) for _ in range(n))
    rows = [(i, text(lang, draw.randint(2, 80)), lang) for i, lang in enumerate(draw.choices(list(sounds), k=240))]
    rows += [(900, None, "xx"), (901, "12 34 !?", "yy"), (902, "", None), (903, "roka" * 5000, None), (None, "schei ung", None), (0, rows[0][1], rows[0][2])]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, text string, lang string, score string")
    found = language.predict(docs, learn=F.col("doc_id") % 3 > 0).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in found}
    assert all(got[i][0] == lang for i, _, lang in rows[:240])
    assert [got[i] for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903][0] == "xx" and got[None][0] == "yy"
    assert all(0 <= s <= 1 for _, s in got.values())
    nothing = language.predict(docs, learn=F.lit(False)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language.predict(docs.limit(0), learn=F.lit(True)).isEmpty()


def test_length_classes_hold_every_unit():
    draw = random.Random(8)
    units = ["x" * draw.choice([1, 2, 5, 30, 400]) for _ in range(3000)]
    classes = pieces.length_classes(units, most=1000)
    assert sorted(i for c in classes for i in c) == list(range(3000))
    assert pieces.length_classes([]) == []
