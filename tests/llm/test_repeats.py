"""Suffix arrays, repeated byte strings and repeated word windows against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from tripmill.llm import common, recompress, suffix_dedup
from tripmill.llm.gsaca import suffix_array


def test_suffix_array():
    draw = random.Random(3)
    for _ in range(1500):
        text = [draw.randrange(draw.choice([1, 2, 3, 9])) for _ in range(draw.randint(0, 40))]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def texts(draw, alphabet, joiner):
    """Ids and texts with shared stretches, whole copies, periodic ones, nulls, empty ones, repeated rows and null ids."""
    shared = [joiner.join(draw.choices(alphabet, k=draw.randint(20, 60))) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [joiner.join(draw.choices(alphabet, k=draw.randint(0, 30))) for _ in range(3)]
        for at in range(draw.randint(0, 2)):
            parts.insert(at, draw.choice(shared))
        rows.append((i, joiner.join(parts)))
    rows += [(50 + i, rows[i][1]) for i in range(4)]
    rows += [(60, None), (61, ""), (62, joiner.join([alphabet[0]] * 80)), (63, joiner.join([alphabet[0], alphabet[1]] * 60))]
    rows += [rows[3], (None, rows[4][1]), (None, shared[0]), (7, "another text of id seven")]
    draw.shuffle(rows)
    return rows


def brute_bytes(rows, width):
    bodies = [(t or "").encode() for _, t in rows]
    times = Counter(b[i: i + width] for b in bodies for i in range(len(b) - width + 1))
    out = []
    for (doc, _), b in zip(rows, bodies):
        gone = {j for i in range(len(b) - width + 1) if times[b[i: i + width]] > 1 for j in range(i, i + width)}
        spans = sum(j - 1 not in gone for j in gone)
        kept = bytes(x for j, x in enumerate(b) if j not in gone)
        out.append((doc, len(b), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("width, group", [(16, 1500), (24, 1500), (24, 2)])
def test_repeated_bytes(docs_of, monkeypatch, width, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)  # 2: all groups take the way of very large ones
    rows = texts(random.Random(width + group), list("abcdeé"), "")
    found = suffix_dedup.remove_repeats(docs_of(rows), width)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect())
    assert got == brute_bytes(rows, width)


def brute_words(rows, width):
    order = [(2**63 - 1 if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for d, w in order:
        for i in range(len(w) - width + 1):
            key = tuple(w[i: i + width])
            first[key] = min(first.get(key, d), d)
    out = []
    for (doc, _), (d, w) in zip(rows, order):
        gone = {j for i in range(len(w) - width + 1) if first[tuple(w[i: i + width])] < d for j in range(i, i + width)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("width", [6, 13])
def test_repeated_words(docs_of, width):
    rows = texts(random.Random(width), ["the", "of", "ein", "çok", "a", "b", "x y"], " ")
    found = recompress.remove_repeats(docs_of(rows), width)
    assert set(found.columns) >= {"doc_id", "lang", "d", "th", "_row", "kept_text"}
    got = found.collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words(rows, width)
    for r in got:  # the text left has the words left
        assert hashlib.sha256(b" ".join(r.kept_text.encode().split())).hexdigest() == r.kept_sha256


def test_kept_text_keeps_its_spacing(docs_of):
    rows = [(1, "a b c d e f"), (2, "new  line\n a b c d e f\tend")]
    kept = {r.doc_id: r.kept_text for r in recompress.remove_repeats(docs_of(rows), 6).collect()}
    assert kept == {1: "a b c d e f", 2: "new  line\n end"}


def test_empty_tables(docs_of):
    assert suffix_dedup.remove_repeats(docs_of([])).collect() == []
    assert recompress.remove_repeats(docs_of([])).collect() == []


def test_slices_keep_long_rows_whole():
    import numpy as np

    assert list(common.slices(np.array([0, 5, 5, 100, 103, 106]), 6)) == [(0, 2), (2, 3), (3, 5)]
    assert list(common.slices(np.array([0]), 6)) == []


def test_windows_of_all_widths():
    import numpy as np

    values = np.array([1, 2, 3, 1, 2, 3, 4, 1, 2, 3], np.uint64)
    for width in range(1, 8):
        hashes = common.window_hashes(values, width)
        windows = [tuple(values[i: i + width]) for i in range(len(values) - width + 1)]
        assert len(set(zip(windows, hashes.tolist()))) == len(set(windows)) == len(set(hashes.tolist()))
    keys = np.array([5, 3, 9, 3, 7, 1], np.uint64)
    for width in range(1, 7):
        assert common.sliding_minimum(keys, width).tolist() == [min(keys[i: i + width]) for i in range(len(keys) - width + 1)]
