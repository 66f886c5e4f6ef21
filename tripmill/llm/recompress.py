"""Word windows that occur in an earlier document, found by recompression.

In rounds, runs of one symbol and then chosen pairs of neighbours get a name of
their own. A name is the hash of what it stands for, and which symbols may be
first or second in a pair is a bit of their name, so every round names the same
run or pair the same way in every text of the corpus, without any exchange.
Equal substrings therefore have equal symbols inside, except near their ends.
For each symbol the round also carries how many words around it decided it.

A window sees the symbols that it decides alone, and is found by one of them,
its anchor: of the highest level it sees, the one with the smallest name, taken
with the half window of words after it, or before it if it lies in the second
half. Equal windows have equal anchors. Neighbouring windows with one anchor form
a context; an anchor with one kind of context is settled by its smallest
document, and where an anchor has different contexts their windows are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmill.llm import common as C
from tripmill.session import stage, unstage

ROUNDS = 3
LAST = (1 << 63) - 1  # a null id comes after all others

_CONTEXT = "d bigint, th int, anchor bigint, digest bigint, starts array<int>, windows int"


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word of the texts, and the first word of each text (n + 1 numbers)."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    wall = np.zeros(len(data) + 1, bool)
    wall[offsets] = True  # words do not cross texts
    inside = ~space
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | wall[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | wall[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a sum over its bytes of what byte and place give together."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    place = C.spans(np.zeros(len(starts), np.int64), lengths).astype(np.uint64)
    value = data[C.spans(starts, lengths)].astype(np.uint64)
    each = C.mix(value, place, 17)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return C.mix(np.add.reduceat(each, first), lengths.astype(np.uint64), 19)


def levels(names: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Yield (names, low, high) per level: the symbols in order, and the first and last word that decided each.

    ``text`` is the text of each word; ``begin`` and ``end`` are the first word of
    each text and the one after its last. Symbols next to the edge of a text
    count as decided by the word beyond it, which no window holds.
    """
    low = high = np.arange(len(names))
    yield names, low, high
    for turn in range(ROUNDS):
        # Runs: decided by the neighbours too, which must differ.
        n = len(names)
        if not n:
            return
        new = np.ones(n, bool)
        new[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], n) - 1
        size = (last - first + 1).astype(np.uint64)
        run = np.where(size > 1, C.mix(names[first], size, 100 + turn), names[first])
        owner = text[first]
        edge = np.concatenate(([True], owner[1:] != owner[:-1]))
        tail = np.concatenate((owner[1:] != owner[:-1], [True]))
        run_low = np.where(edge, begin[owner] - 1, low[np.maximum(first - 1, 0)])
        run_high = np.where(tail, end[owner], high[np.minimum(last + 1, n - 1)])
        names, low, high, text = run, run_low, run_high, owner
        # Pairs: a first symbol takes the second that follows it; others are decided by that neighbour too.
        n = len(names)
        second = ((C.mix(names, np.full(1, turn, np.uint64), 200) >> np.uint64(40)) & np.uint64(1)).astype(bool)
        starts_text = np.concatenate(([True], text[1:] != text[:-1]))
        ends_text = np.concatenate((text[1:] != text[:-1], [True]))
        follows = np.concatenate((second[1:], [False])) & ~ends_text
        paired = ~second & follows
        taken = np.concatenate(([False], paired[:-1]))
        after, before = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
        name = np.where(paired, C.mix(names, names[after], 300 + turn), names)
        alone_low = np.where(starts_text, begin[text] - 1, low[before])
        alone_high = np.where(ends_text, end[text], high[after])
        pair_low = np.where(paired | ~second, low, alone_low)
        pair_high = np.where(paired, high[after], np.where(second, high, alone_high))
        keep = np.flatnonzero(~taken)
        names, low, high, text = name[keep], pair_low[keep], pair_high[keep], text[keep]
        yield names, low, high


def anchors(names: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray, places: np.ndarray, width: int):
    """For each window start in ``places``: the name of its anchor and a number telling which symbol it is."""
    half = width // 2
    halves = C.window_hashes(names, half) if half else names
    found = np.zeros(len(places), bool)
    key, which = np.zeros(len(places), np.uint64), np.zeros(len(places), np.int64)
    for level, (symbols, low, high) in reversed(list(enumerate(levels(names, text, begin, end)))):
        if not len(symbols):
            continue
        rest = np.flatnonzero(~found)
        s = places[rest]
        a = np.searchsorted(low, s, "left")
        b = np.searchsorted(high, s + width - 1, "right")
        seen = a < b
        rest, a, b = rest[seen], a[seen], b[seen]
        if not len(rest):
            continue
        # The smallest name in symbols[a:b], the leftmost on ties: minima over powers of two, two of which cover a range.
        ordered = C.with_position(C.mix(symbols, np.full(1, level, np.uint64), 400))
        length = b - a
        best = np.empty(len(rest), np.uint64)
        table, size = ordered, 1
        while True:
            now = np.flatnonzero((length >= size) & (length < 2 * size))
            best[now] = np.minimum(table[a[now]], table[b[now] - size])
            if not (length >= 2 * size).any():
                break
            table = np.minimum(table[:-size], table[size:])
            size *= 2
        at = C.position_of(best)
        late = low[at] - s[seen] >= half
        around = halves[np.where(late, np.maximum(low[at] - half + 1, 0), np.minimum(low[at], len(halves) - 1))]
        key[rest] = C.mix(C.mix(symbols[at], around, 500 + level), late.astype(np.uint64), 600)
        which[rest] = (at * 32 + level) * 2 + late
        found[rest] = True
    return key, which


def _read(batch: pa.RecordBatch):
    """Slices of a batch as rows, word bounds, hashes of the words, and the first word of each text."""
    data, offsets = C.text_bytes(batch.column("text"))
    for at, stop in C.slices(offsets):
        part, own = data[offsets[at]: offsets[stop]], offsets[at: stop + 1] - offsets[at]
        starts, ends, bounds = words(part, own)
        yield at, stop, bounds, word_hashes(part, starts, ends)


def _contexts(width: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = []
        for at, stop, bounds, hashes in _read(batch):
            begin, end = bounds[:-1], bounds[1:]
            windows = np.maximum(end - begin - width + 1, 0)
            if not windows.any():
                continue
            rows = np.arange(stop - at)
            text, places = np.repeat(rows, end - begin), C.spans(begin, windows)
            key, which = anchors(hashes, text, begin, end, places, width)
            owner = np.repeat(rows, windows)
            new = np.ones(len(places), bool)
            new[1:] = (which[1:] != which[:-1]) | (owner[1:] != owner[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(places)) - 1
            whole = C.window_hashes(hashes, width)
            s, e, r = places[first], places[last], owner[first]
            digest = C.mix(C.mix(whole[s], whole[e], 3), (e - s).astype(np.uint64), 5)
            found.append((r + at, key[first], digest, s - begin[r], e - s + 1))
        if not found:
            return None
        r, key, digest, s, n = (np.concatenate(x) for x in zip(*found))
        # A text that repeats a context has one row for it, with all its places.
        order = np.lexsort((s, n, digest, key, r))
        r, key, digest, s, n = (x[order] for x in (r, key, digest, s, n))
        first = np.flatnonzero(np.concatenate((
            [True], (r[1:] != r[:-1]) | (key[1:] != key[:-1]) | (digest[1:] != digest[:-1]) | (n[1:] != n[:-1]))))
        starts = pa.ListArray.from_arrays(pa.array(np.append(first, len(r)), pa.int32()), pa.array(s, pa.int32()))
        take = pa.array(r[first])
        return pa.RecordBatch.from_arrays(
            [batch.column("d").take(take), batch.column("th").take(take), pa.array(C.signed(key[first])),
             pa.array(C.signed(digest[first])), starts, pa.array(n[first], pa.int32())],
            names=["d", "th", "anchor", "digest", "starts", "windows"])
    return run


def _open_windows(width: int):
    """Two hashes of each window of the contexts listed with a text, for comparison between contexts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        listed = batch.column("contexts").to_pylist()
        for at, stop, bounds, hashes in _read(batch):
            one = C.window_hashes(hashes, width)
            two = C.window_hashes(C.mix(hashes, np.full(1, 1, np.uint64), 600), width)
            for i in range(at, stop):
                runs = np.array([(a, c["windows"]) for c in listed[i] for a in c["starts"]], np.int64)
                place = C.spans(runs[:, 0], runs[:, 1])
                here = place + bounds[i - at]
                out.append((np.full(len(place), i), C.signed(one[here]), C.signed(two[here]), place))
        if not out:
            return None
        i, one, two, place = (np.concatenate(x) for x in zip(*out))
        take = pa.array(i)
        return pa.RecordBatch.from_arrays(
            [pa.array(one), pa.array(two), batch.column("d").take(take), batch.column("th").take(take), pa.array(place, pa.int32())],
            names=["one", "two", "d", "th", "start"])
    return run


def earlier_runs(texts: DataFrame, width: int = 50) -> DataFrame:
    """``d, th, starts, windows``: windows, by first words and number, that also start in a text with a smaller ``d``.

    ``texts`` has ``d`` (order of the text), ``text`` (not null), ``th`` (hash of the text).
    """
    contexts = stage(C.map_batches(texts.select("d", "th", "text"), _contexts(width), _CONTEXT), "word-contexts")
    shared = (
        contexts.groupBy("anchor")
        .agg(F.min("d").alias("first"), F.max("d").alias("latest"),
             F.min("digest").alias("one"), F.max("digest").alias("other"), F.min_by("digest", "d").alias("lead"))
        .where("first < latest").select("anchor", "first", "lead", (F.col("one") < F.col("other")).alias("mixed"))
    )
    met = stage(contexts.join(shared, "anchor"), "word-shared")
    unstage(contexts)
    # What equals the context of the anchor's first document is settled there, however many copies it has.
    equal = met.where("digest = lead and d > first").select("d", "th", "starts", "windows")
    mixed = met.where("mixed and (digest <> lead or d = first)").drop("first", "lead", "mixed")
    one = F.struct("d", "th", "starts", "windows")
    kinds = stage(mixed.groupBy("anchor", "digest").agg(
        F.min("d").alias("first"), F.min(one).alias("one"), F.count(F.lit(1)).alias("times")), "word-kinds")
    # A kind that occurs once is there already; only the rows of the others meet theirs.
    often = stage(mixed.join(kinds.where("times > 1").select("anchor", "digest", "first"), ["anchor", "digest"]), "word-often")
    equal_mixed = often.where("d > first").select("d", "th", "starts", "windows")
    alone = kinds.where("times = 1").select("one.*").unionByName(often.where("d = first").select("d", "th", "starts", "windows"))
    listed = (
        alone.groupBy("d", "th").agg(F.collect_set(F.struct("starts", "windows")).alias("contexts"))
        .withColumnsRenamed({"d": "_d", "th": "_t"})
    )
    # All columns stay, so that this join and the one that cuts the texts read one and the same exchange.
    opened = texts.join(listed, F.expr("d = _d and th = _t")).select(*texts.columns, "contexts")
    windows = C.map_batches(opened, _open_windows(width), "one bigint, two bigint, d bigint, th int, start int")
    first = windows.groupBy("one", "two").agg(F.min("d").alias("first"), F.max("d").alias("latest")).where("latest > first")
    single = windows.join(first, ["one", "two"]).where("d > first").select("d", "th", F.array("start").alias("starts"), F.lit(1).alias("windows"))
    return equal.unionByName(equal_mixed).unionByName(single)


def _cut(width: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import hashlib

        data, offsets = C.text_bytes(batch.column("text"))
        rows = []
        for i, found in enumerate(batch.column("runs").to_pylist()):
            body = data[offsets[i]: offsets[i + 1]]
            starts, ends, _ = words(body, np.array([0, len(body)]))
            runs = [(a, a + x["windows"] - 1 + width) for x in found or () for a in x["starts"]]
            kept, removed, _ = C.kept_ranges(len(starts), runs)
            raw = body.tobytes()
            bare = b" ".join(raw[a:b] for x, y in kept for a, b in zip(starts[x:y].tolist(), ends[x:y].tolist()))
            edge = [*starts.tolist(), len(raw)]
            rest = b"".join([raw[: edge[0]]] + [raw[edge[x]: edge[y]] for x, y in kept]) if removed else raw
            rows.append((len(starts), removed, rest, hashlib.sha256(bare).hexdigest()))
        cols = list(zip(*rows))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), *[pa.array([x.decode() for x in c] if i == 2 else c, t) for i, (c, t) in enumerate(zip(cols, kinds))]],
            names=["row", "n_words", "n_removed", "kept_text", "kept_sha256"])
    return run


def remove_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """``n_words, n_removed, kept_text, kept_sha256`` and the columns of ``docs`` except the text.

    Words are separated by ASCII white space. A word goes if any window of
    ``width`` words over it, within its row, also starts in a row with a smaller
    ``doc_id``; windows are judged on the input. ``kept_text`` is the text
    without the words that go and the space after each of them, ``kept_sha256``
    that of the kept words joined by one space. A null text counts as empty. A
    null id counts as larger than any other; rows with equal ids, repeated rows
    among them, remove nothing from each other. Columns named like a result are
    replaced. An empty table gives an empty table.
    """
    results = ["n_words", "n_removed", "kept_text", "kept_sha256"]
    columns = [c for c in docs.columns if c not in results]
    texts = docs.select(
        F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.coalesce("text", F.lit("")).alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"]).alias("row"),
    ).withColumn("th", F.hash("text"))
    runs = earlier_runs(texts, width).groupBy("d", "th").agg(F.collect_set(F.struct("starts", "windows")).alias("runs"))
    runs = runs.withColumnsRenamed({"d": "_d", "th": "_t"})
    joined = texts.join(runs, F.expr("d = _d and th = _t"), "left").select(*texts.columns, "runs")
    row = joined.schema["row"].dataType.simpleString()
    out = C.map_batches(joined, _cut(width), f"row {row}, n_words bigint, n_removed bigint, kept_text string, kept_sha256 string")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in columns if c != "text"], *results)
