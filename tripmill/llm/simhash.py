"""SimHash fingerprints and the documents they link, by pivot distance tables.

A fingerprint bit is set if it is set in over half of the shingle hashes of the
text. Fingerprints meet in tables by some of their bits, or, where more of them may
differ, by minima of their shingle hashes. In a group of a table the Hamming
distances to fixed reference fingerprints are worked out once; by the triangle
inequality two fingerprints can only be near if they are about as far from each
reference, so pairs whose largest coordinate difference is over the limit are
discarded, and the true distance is taken of those that are left.
``keep_first`` takes such pairs as candidates only and compares their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripmill.llm import common as C
from tripmill.llm import tensored
from tripmill.llm.components import components
from tripmill.session import stage, unstage

PIVOTS = 16
GROUP = 4096  # fingerprints compared at once; a larger group of a table is compared in pairs of such parts
KEYS, MINIMA = 20, 4  # keys that texts with many equal shingles share, and minima of each
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M64 = (1 << 64) - 1


def shingle_hashes(body: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words of lower-cased UTF-8, joined by spaces; of all words if there are fewer."""
    import xxhash

    words = body.translate(_LOWER).split()  # splits bytes at the six ASCII white-space characters only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1:].tolist())], np.uint64)


def majority(hashes: np.ndarray, lanes: int = 1) -> list[int]:
    """``lanes`` 64-bit words of the fingerprint; the first lane votes with the hashes, the others with mixtures of them."""
    out = []
    for lane in range(lanes):
        votes = hashes if lane == 0 else C.mix(hashes, np.full(1, lane, np.uint64), 7)
        bits = np.unpackbits(votes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        half = bits.sum(axis=0, dtype=np.int64) * 2 > len(votes)
        out.append(int(np.packbits(half, bitorder="little").view(np.int64)[0]))
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, lanes: int = 1) -> DataFrame:
    """``doc_id, th, f0 ...`` for each row of ``docs``, ``th`` a hash of the text; zeros for a null text and one without words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [
            majority(h, lanes) if len(h := shingle_hashes(t, shingle)) else [0] * lanes
            for t in batch.column("text").cast(pa.binary()).to_pylist()
        ]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("th")] + [pa.array(c, pa.int64()) for c in zip(*rows)],
            names=["doc_id", "th", *names])

    names = [f"f{i}" for i in range(lanes)]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.hash("text").alias("th"))
    return C.map_batches(texts, run, "doc_id bigint, th int, " + ", ".join(f"{n} bigint" for n in names))


def tables(max_bits: int) -> list[list[int]]:
    """The bits each table goes by, for 64 bits: blocks such that two are left untouched whatever bits differ, a table for each two."""
    blocks = np.array_split(np.arange(64), max_bits + 2)
    return [np.concatenate(pair).tolist() for pair in combinations(blocks, 2)]


def _matrix(batch: pa.RecordBatch, lanes: int) -> np.ndarray:
    return np.stack([batch.column(f"f{i}").to_numpy().view(np.uint64) for i in range(lanes)], axis=1)


def _by_bits(chosen: list[list[int]]):
    """Each fingerprint of one lane under the key of each table."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = _matrix(batch, 1)
        bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
        keys = []
        for i, places in enumerate(chosen):
            value = bits[:, places].astype(np.uint64) @ (np.uint64(1) << np.arange(len(places), dtype=np.uint64))
            keys.append(C.mix(value, np.full(1, i, np.uint64), 11))
        row = pa.array(np.tile(np.arange(len(prints)), len(chosen)))
        return pa.RecordBatch.from_arrays(
            [pa.array(C.signed(np.concatenate(keys))), batch.column("node").take(row), batch.column("f0").take(row)], names=["key", "node", "f0"])
    return run


def _by_minima(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each row under each of the keys that its set has from its smallest shingle hashes."""
    keys = np.frombuffer(b"".join(batch.column("minima").to_pylist()), np.int64)
    row = pa.array(np.repeat(np.arange(batch.num_rows), KEYS))
    rest = [n for n in batch.schema.names if n != "minima"]
    return pa.RecordBatch.from_arrays([pa.array(keys), *[batch.column(n).take(row) for n in rest]], names=["key", *rest])


def minima(hashes: np.ndarray) -> bytes:
    """``KEYS`` keys of a set of hashes, each of ``MINIMA`` minima: sets that are 0.8 alike share none with chance 3e-5."""
    draw = np.random.default_rng(7).integers(0, 1 << 63, (KEYS, MINIMA), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.array([[(hashes * odd).min() for odd in row] for row in draw]) if len(hashes) else np.zeros((KEYS, MINIMA), np.uint64)
    key = np.arange(KEYS, dtype=np.uint64)
    for k in range(MINIMA):
        key = C.mix(key, least[:, k], 61 + k)
    return key.tobytes()


def _near(prints: np.ndarray, max_bits: int, most: int = 1 << 20, sizes: np.ndarray | None = None) -> Iterator[tuple]:
    """Pairs of at most ``max_bits`` differing bits, and their bits; with ``sizes`` (of sets) those that can share four fifths."""
    seeds = np.arange(1, PIVOTS * prints.shape[1] + 1, dtype=np.uint64)
    pivots = C.mix(seeds, seeds, 13).reshape(PIVOTS, -1)
    far = np.zeros((len(prints), PIVOTS), np.int16)
    for lane in range(prints.shape[1]):
        far += np.bitwise_count(prints[:, lane, None] ^ pivots[None, :, lane]).astype(np.int16)
    by = far[:, 0] if sizes is None else sizes
    order = np.argsort(by, kind="stable")
    first = by[order]
    until = np.searchsorted(first, first + max_bits if sizes is None else first * 5 // 4, "right")
    counts = until - np.arange(len(order)) - 1
    at = 0
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(np.cumsum(counts[at:]), most, "right")) + at)
        a = np.repeat(np.arange(at, end), counts[at:end])
        b = C.spans(np.arange(at, end) + 1, counts[at:end])
        a, b = order[a], order[b]
        for column in far.T[1 if sizes is None else 0:]:
            near = np.abs(column[a] - column[b]) <= max_bits
            a, b = a[near], b[near]
        bits = np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int64)
        true = bits <= max_bits
        yield a[true], b[true], bits[true]
        at = end


def near_pairs(prints: np.ndarray, max_bits: int, labels: np.ndarray, most: int = 1 << 20) -> None:
    """Give linked fingerprints one label, the smallest of theirs. ``labels`` starts as 0, 1, 2, ..."""
    for a, b, _ in _near(prints, max_bits, most):
        _merge(labels, a, b)


def forest(count: int, pairs: Iterator[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a shortest spanning forest over 0..count, kept up to date while pairs come in."""
    kept = tuple(np.zeros(0, np.int64) for _ in range(3))
    for new in pairs:
        if not len(new[0]):
            continue
        a, b, bits = (np.concatenate(x) for x in zip(kept, new))
        order = np.argsort(bits, kind="stable")
        a, b, bits = a[order], b[order], bits[order]
        labels, used, at, size = np.arange(count), [], 0, 1024
        while at < len(a):
            apart = np.flatnonzero(labels[a[at: at + size]] != labels[b[at: at + size]]) + at
            up = labels.tolist()
            for i, x, y in zip(apart.tolist(), a[apart].tolist(), b[apart].tolist()):
                while up[x] != x:
                    x = up[x]
                while up[y] != y:
                    y = up[y]
                if x != y:
                    up[max(x, y)] = min(x, y)
                    used.append(i)
            labels = np.array(up)
            while not np.array_equal(top := labels[labels], labels):
                labels = top
            at, size = at + size, size * 2
        kept = a[used], b[used], bits[used]
    return kept[0], kept[1]


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up


def _by_group(lanes: int, also: list[str], emit):
    """Call ``emit`` with fingerprints, nodes and the columns ``also`` of each group; rows come sorted by key and part."""

    def pairs(held: list[tuple]) -> pa.RecordBatch | None:
        if sum(len(h[1]) for h in held) < 2:
            return None
        u, v = emit(*map(np.concatenate, zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"]) if len(u) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = [_matrix(batch, lanes), *[batch.column(c).to_numpy() for c in ("node", *also)]]
            where = np.stack([batch.column(c).to_numpy() for c in ("key", "one", "two")], axis=1)
            edge = np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1
            for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(where)]):
                here = tuple(where[s].tolist())
                if here != last:
                    if (out := pairs(held)) is not None:
                        yield out
                    held = []
                held.append(tuple(x[s:e] for x in values))
                last = here
        if (out := pairs(held)) is not None:
            yield out
    return run


def _met(rows: DataFrame, lanes: int, emit, also: tuple = ()) -> DataFrame:
    """``u, v`` that ``emit`` gives for each group of ``rows`` (``key, node, f0 ...``); large groups meet in pairs of parts."""
    large = rows.groupBy("key").count().where(F.col("count") > GROUP)
    parts = large.select("key", F.ceil(F.col("count") / (GROUP // 2)).cast("int").alias("parts"))
    many = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("node"), many).cast("int")
    dealt = (
        rows.join(parts, "key", "left")
        .withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), many - 1)))
        .select("key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "node", *also,
                *[f"f{i}" for i in range(lanes)])
    )
    group = ["key", "one", "two"]
    sorted_rows = dealt.repartition(*group).sortWithinPartitions(*group)
    return sorted_rows.mapInArrow(_by_group(lanes, list(also), emit), "u bigint, v bigint")


def linked(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """``f0, root, first_id`` for each distinct fingerprint: its component and the component's smallest id."""
    kinds = stage(prints.groupBy("f0").agg(F.min("doc_id").alias("first_id")).withColumn("node", F.col("f0")), "fingerprints")

    def emit(prints: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        labels = np.arange(len(prints))
        near_pairs(prints, max_bits, labels)
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        return nodes[moved], nodes[labels[moved]]

    rows = C.map_batches(kinds.select("node", "f0"), _by_bits(tables(max_bits)), "key bigint, node bigint, f0 bigint")
    edges = _met(rows, 1, emit)
    roots = components(edges)
    placed = kinds.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = placed.groupBy("root").agg(F.min("first_id").alias("first_id"))
    return placed.drop("first_id", "node").join(first, "root")


def near_groups(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``doc_id, th, f0, root, first_id`` for each row of ``docs``.

    ``root`` names the component of the row under links of at most ``max_bits``
    differing bits, ``first_id`` is the smallest doc_id in it (null if all are).
    Texts without words, null ones among them, have the zero fingerprint and are
    linked like any other. Repeated rows and ids stay rows of their own. An
    empty table gives an empty table; other columns are left out.
    """
    prints = stage(fingerprints(docs, shingle), "prints")
    return prints.join(linked(prints, max_bits), "f0")


def shingle_sets(texts: DataFrame, shingle: int, lanes: int, whole: bool = False) -> DataFrame:
    """For each row its distinct shingles: ``node``, a digest of the set, and either the set (``whole``) or ``doc_id, th, size, f0 ..., minima``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        sets = [np.unique(shingle_hashes(t, shingle)) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        node = pa.array(C.signed(np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets], np.uint64)))
        if whole:
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.array(C.signed(np.concatenate(sets))))
            return pa.RecordBatch.from_arrays([node, held], names=["node", "shingles"])
        rows = [majority(x, lanes) if len(x) else [0] * lanes for x in sets]
        size = pa.array([len(x) for x in sets], pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("th"), node, size] + [pa.array(c, pa.int64()) for c in zip(*rows)]
            + [pa.array([minima(x) for x in sets], pa.binary())],
            names=["doc_id", "th", "node", "size", *names, "minima"])

    names = [f"f{i}" for i in range(lanes)]
    texts = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.hash("text").alias("th"))
    prints = "doc_id bigint, th int, node bigint, size bigint, " + ", ".join(f"{n} bigint" for n in names) + ", minima binary"
    return C.map_batches(texts, run, "node bigint, shingles array<bigint>" if whole else prints)


def alike_groups(docs: DataFrame, shingle: int = 5, lanes: int = 4, max_bits: int = 64) -> DataFrame:
    """``doc_id, th, root, first_id`` for each row of ``docs``: components of texts whose sets of shingles are at least 0.8 alike.

    Rows that share one of ``KEYS`` keys, whose number is the same at every size,
    have their fingerprints compared by pivot distances; those of at most
    ``max_bits`` differing bits are candidates, and of each group the shortest
    spanning forest leaves the task. The sets of a tree of such edges are compared
    as a whole if it is small; in a large one its edges are checked first, then
    the components they leave. Sets are compared by 64-bit hashes of their
    shingles; texts without words are alike.
    """
    names = [f"f{i}" for i in range(lanes)]
    prints = stage(shingle_sets(docs, shingle, lanes), "prints")
    kinds = stage(prints.groupBy("node", "size", *names, "minima").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "th")).alias("one")), "fingerprints")

    def nearest(prints: np.ndarray, nodes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = forest(len(nodes), _near(prints, max_bits, sizes=sizes))
        return nodes[a], nodes[b]

    columns = ", ".join(f"{n} bigint" for n in ["key", "node", "size", *names])
    rows = C.map_batches(kinds.select("node", "size", *names, "minima"), _by_minima, columns)
    found = _met(rows, lanes, nearest, ("size",))
    tried = stage(found.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "candidates")
    trees = components(tried).withColumnRenamed("root", "key")
    members = kinds.select("node", "size", "one").join(trees, "node")
    many = members.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("shingles")).select(
        "key", F.expr(f"rows > {tensored.GROUP} or shingles > {tensored.GROUP_SHINGLES}").alias("large"))
    members = stage(members.join(many, "key"), "members")
    ids = members.select(F.col("one.doc_id").alias("_id"), F.col("one.th").alias("_th"))
    texts = C.match_rows(docs.select("doc_id", "text"), ids.hint("merge"), "left_semi")  # one plan at every size
    sets = stage(shingle_sets(texts, shingle, lanes, whole=True).dropDuplicates(["node"]), "shingles")
    part = F.lit(0)
    small = members.where("not large").select("key", part.alias("one"), part.alias("two"), "node", F.col("node").alias("place"))
    links = tensored.linked(small, sets)
    large = members.where("large").select("key", "node", "size")
    if not large.isEmpty():
        inside = tried.join(large.select(F.col("node").alias("u")), "u", "left_semi")
        sure = stage(tensored.alike(inside, sets), "links")
        placed = large.join(components(sure), "node", "left").select("key", "node", F.coalesce("root", "node").alias("place"), "size")
        links = links.unionByName(sure).unionByName(tensored.between(stage(placed, "places"), sets))
    roots = components(links)
    placed = kinds.select("node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = placed.groupBy("root").agg(F.min("first_id").alias("first_id"))
    out = stage(prints.select("doc_id", "th", "node").join(placed.drop("first_id").join(first, "root"), "node").drop("node"), "groups")
    for table in (prints, kinds, tried, members, sets, roots):
        unstage(table)
    return out


def keep_first(docs: DataFrame, shingle: int = 5, lanes: int = 4, max_bits: int = 64) -> DataFrame:
    """The rows of ``docs`` without those alike to others: of each component one row with the smallest id stays.

    Texts are linked if their sets of five-word shingles are at least 0.8 alike.
    The fingerprint that finds them has 256 bits, since such texts differ in
    about 15 of 100 bits (19 for sets of four and five), which 64 bits do not
    tell well from chance. All columns are kept.
    """
    groups = alike_groups(docs, shingle, lanes, max_bits)
    same = groups.where("doc_id <=> first_id").groupBy("root", "doc_id", "th").agg(F.count(F.lit(1)).alias("rows"))
    kept = stage(same.groupBy("root").agg(F.min(F.struct("doc_id", "th", "rows")).alias("k")).select(
        F.col("k.doc_id").alias("_id"), F.col("k.th").alias("_th"), F.col("k.rows").alias("_rows")), "kept")
    unstage(groups)
    left = C.match_rows(docs, kept.drop("_rows").distinct().hint("merge"), "left_semi")
    if kept.where("_rows > 1").isEmpty():
        return left
    rank = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(*docs.columns))  # of rows alike in id and text the first by all columns
    return left.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
