"""MinHash near duplicates by tensored banding, with links confirmed on whole sets of shingles.

Two small collections of ``M`` half keys are made, each half key of ``K`` minhashes.
Every pair of a half key of the first and one of the second is the key of a
table: ``M * M`` tables of ``2 * K`` minhashes for ``2 * M * K`` minhashes in all.
Sets with resemblance s share a key with chance ``(1 - (1 - s**K)**M)**2``:
0.9985 at 0.8, 0.99997 at 0.85.

Sets that share a key are all tied to the smallest node of that key, its hub;
equal sets are one node. Trees of such ties are compared as wholes if they are
small: all their sets, in one task, by bitmaps of their common shingles. In a large tree each set is first compared
with the hub it shares most keys with; where that leaves a hub with sets in
several components, sets outside its main component are compared with all of
that hub. Sets of one component are never compared again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmill.llm import common as C
from tripmill.llm.components import components, stars
from tripmill.llm.recompress import word_hashes, words
from tripmill.session import stage, unstage

K, M = 3, 10  # minhashes of a half key, half keys of a collection
GROUP = 512  # sets compared at once, and shingles of them
GROUP_SHINGLES = 1 << 21
CHUNK = 1 << 20  # 64-bit words of bitmaps met at once

_A, _Z = 65, 90


def shingle_sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of a batch: first row, hashes of the distinct shingles of its texts end to end, and their number by text.

    A-Z count as a-z. A text of fewer words than ``size`` has one shingle, all of them; one without words has none.
    """
    data, offsets = C.text_bytes(batch.column("text"))
    for at, stop in C.slices(offsets):
        part, own = data[offsets[at]: offsets[stop]], offsets[at: stop + 1] - offsets[at]
        part = np.where((part >= _A) & (part <= _Z), part + np.uint8(32), part)
        starts, ends, bounds = words(part, own)
        names = word_hashes(part, starts, ends)
        count = np.diff(bounds)
        number = np.where(count >= size, count - size + 1, np.minimum(count, 1))
        owner = np.repeat(np.arange(stop - at), number)
        first = C.spans(bounds[:-1], number)
        length = np.minimum(count, size)[owner]
        value = C.mix(names[first], length.astype(np.uint64), 31)
        for k in range(1, size):
            more = np.flatnonzero(length > k)
            value[more] = C.mix(value[more], names[first[more] + k], 31 + k)
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[new], owner[new]
        yield at, value, np.bincount(owner, minlength=stop - at)


def half_keys(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The ``2 * M`` half keys of each set; sets are not empty and begin at ``first``."""
    draw = np.random.default_rng(11)
    out = np.zeros((len(first), 2 * M), np.uint64)
    for h in range(2 * M):
        for k in range(K):
            odd = draw.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            least = np.minimum.reduceat(value * odd, first)
            out[:, h] = C.mix(out[:, h], least, 41 + k)
    return out


def _signatures(size: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        nodes, sizes, halves = [], [], []
        for _, value, number in shingle_sets(batch, size):
            edge = np.concatenate(([0], np.cumsum(number)))
            raw = value.tobytes()
            nodes += [xxhash.xxh64_intdigest(raw[8 * a: 8 * b], 11) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            full = np.flatnonzero(number)
            rows = np.zeros((len(number), 2 * M), np.uint64)
            if len(full):
                rows[full] = half_keys(value, edge[full])
            sizes.append(number)
            halves += [r.tobytes() if n else None for r, n in zip(rows, number)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("th"), pa.array(C.signed(np.array(nodes, np.uint64))),
             pa.array(np.concatenate(sizes), pa.int64()), pa.array(halves, pa.binary())],
            names=["doc_id", "th", "node", "n_shingles", "halves"])
    return run


def _sets(size: int):
    """``node, key, large, shingles``; of rows of one node that follow each other in a batch the first."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        node = batch.column("node").to_numpy()
        batch = batch.filter(pa.array(np.concatenate(([True], node[1:] != node[:-1]))))
        found = [(value, number) for _, value, number in shingle_sets(batch, size)]
        value, number = (np.concatenate(x) for x in zip(*found))
        held = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(number))), pa.int32()), pa.array(C.signed(value)))
        carried = ["node", "key", "large"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), held], names=[*carried, "shingles"])
    return run


def _keys(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``key, u``: each node under all its keys."""
    halves = np.frombuffer(b"".join(batch.column("halves").to_pylist()), np.uint64).reshape(-1, 2 * M)
    pair = C.mix(np.repeat(halves[:, :M], M, axis=1), np.tile(halves[:, M:], (1, M)), 47)
    key = C.mix(pair, np.broadcast_to(np.arange(M * M, dtype=np.uint64), pair.shape).copy(), 53).reshape(-1)
    node = np.repeat(batch.column("node").to_numpy(), M * M)
    return pa.RecordBatch.from_arrays([pa.array(C.signed(key)), pa.array(node)], names=["key", "u"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties of each key's first node with its others, from rows sorted by key and node."""
    last, hub = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = batch.column("key").to_numpy(), batch.column("u").to_numpy()
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        new[0] = last is None or key[0] != last
        place = np.cumsum(new) - 1
        heads = node[new]
        own = np.where(place < 0, hub, heads[np.maximum(place, 0)]) if len(heads) else np.full(len(node), hub)
        last, hub = key[-1], own[-1]
        far = np.flatnonzero(~new & (own != node))
        if len(far):
            yield pa.RecordBatch.from_arrays([pa.array(own[far]), pa.array(node[far])], names=["u", "v"])


def ties(kinds: DataFrame) -> DataFrame:
    """``u, v, n``: the hubs ``u`` of the keys of each of ``kinds`` (``node, halves``), and the number of keys."""
    keyed = C.map_batches(kinds.select("node", "halves"), _keys, "key bigint, u bigint")
    tied = keyed.repartition("key").sortWithinPartitions("key", "u").mapInArrow(_stars, "u bigint, v bigint")
    return tied.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))


def forest(nodes: np.ndarray, places: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between sets of different places that are four fifths alike, without those that close a ring."""
    label = np.unique(places, return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    names, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    common = times > 1
    number = np.where(common, np.cumsum(common) - 1, -1)[at]
    wide = -(-max(1, int(common.sum())) // 64)
    bits = np.zeros((len(sets), wide), np.uint64)
    edge = np.concatenate(([0], np.cumsum(size)))
    row = np.zeros(wide * 64, bool)
    for i in range(len(sets)):
        own = number[edge[i]: edge[i + 1]]
        own = own[own >= 0]
        row[own] = True
        bits[i] = np.packbits(row).view(np.uint64)
        row[own] = False
    order = np.argsort(size, kind="stable")
    ranked = size[order]
    until = np.searchsorted(ranked * 4, ranked * 5, "right")
    step = max(1, CHUNK // wide)
    links = []
    for i, one in enumerate(order.tolist()):
        for begin in range(i + 1, int(until[i]), step):
            others = order[begin: min(begin + step, int(until[i]))]
            others = others[label[others] != label[one]]
            if not len(others):
                continue
            both = np.bitwise_count(bits[one] & bits[others]).sum(axis=1, dtype=np.int64)
            others = others[9 * both >= 4 * (size[one] + size[others])]
            if len(others):
                found, first = np.unique(label[others], return_index=True)
                links += [(int(nodes[one]), int(nodes[j])) for j in others[first]]
                label[np.isin(label, found)] = label[one]
    return links


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each group of rows ``key, one, two, node, place, shingles``, sorted by group and node, as stars: a node is one ``v`` at most.

    Of rows of one node in a group the first counts.
    """

    def emit(held: list[tuple]) -> pa.RecordBatch | None:
        if len(held) < 2:
            return None
        nodes, places, sets = zip(*held)
        links = forest(np.array(nodes), np.array(places), list(sets))
        if not links:
            return None
        u, v = stars(*(np.array(x, np.int64) for x in zip(*links)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    held, last = [], None
    for batch in batches:
        node, place = batch.column("node").to_numpy(), batch.column("place").to_numpy()
        where = list(zip(*(batch.column(c).to_pylist() for c in ("key", "one", "two"))))
        lists = batch.column("shingles")
        for i, here in enumerate(where):
            if here != last:
                if (out := emit(held)) is not None:
                    yield out
                held, last = [], here
            elif held[-1][0] == node[i]:
                continue
            held.append((int(node[i]), int(place[i]), lists[i].values.to_numpy()))
    if (out := emit(held)) is not None:
        yield out


def compared(held: DataFrame) -> DataFrame:
    """``u, v`` for groups of ``held`` (``key, one, two, node, place, shingles``), each compared in one task; sets are shuffled once."""
    group = ["key", "one", "two"]
    rows = held.select(*group, "node", "place", "shingles")
    return rows.repartition(*group).sortWithinPartitions(*group, "node").mapInArrow(_compare, "u bigint, v bigint")


def linked(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``u, v`` for groups of ``rows`` (``key, one, two, node, place``), each compared in one task."""
    return compared(rows.join(sets, "node"))


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (``u, v``) whose sets share at least four fifths of all their shingles, in whole numbers."""
    one, two = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"in_{c}")) for c in ("u", "v"))
    both = F.size(F.array_intersect("in_u", "in_v"))
    return pairs.join(one, "u").join(two, "v").where(both * 9 >= (F.size("in_u") + F.size("in_v")) * 4).select("u", "v")


def between(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different places inside each key of ``placed`` (``key, node, place, size``).

    The place with most nodes of a key is its main one; the others are compared
    with each other and with it, in pairs of parts where they are many.
    """
    sizes = placed.groupBy("key", "place").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size"))
    parts = F.ceil(F.greatest(F.col("rows") / (GROUP // 2), F.col("size") / (GROUP_SHINGLES // 2))).cast("int")
    split = (
        sizes.groupBy("key").agg(
            F.max(F.struct("rows", "size", "place")).alias("main"), F.sum("rows").alias("rows"), F.sum("size").alias("size"))
        .where("rows > main.rows")
        .select("key", "main.place", F.col("rows") - F.col("main.rows"), F.col("size") - F.col("main.size"), "main.rows", "main.size")
        .toDF("key", "main", "rows", "size", "main_rows", "main_size")
        .withColumn("loose", parts).withColumn("rows", F.col("main_rows")).withColumn("size", F.col("main_size"))
        .select("key", "main", "loose", parts.alias("fixed"))
    )
    rows = placed.join(split, "key")
    by = F.xxhash64("node")
    own = F.when(F.col("place") == F.col("main"), F.col("loose") + F.pmod(by, F.col("fixed"))).otherwise(F.pmod(by, F.col("loose")))
    other = F.sequence(F.lit(0), F.col("loose") + F.when(F.col("place") == F.col("main"), 0).otherwise(F.col("fixed")) - 1)
    dealt = rows.withColumn("own", own.cast("int")).withColumn("other", F.explode(other)).select(
        "key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "node", "place")
    return linked(dealt, sets)


def _large(ties: DataFrame, trees: DataFrame, sets: DataFrame) -> DataFrame:
    """Links in large trees: by the hub with most shared keys first, then between the components around each hub."""
    inside = ties.join(trees.select(F.col("node").alias("v")), "v", "left_semi")
    best = inside.groupBy("v").agg(F.max(F.struct("n", "u")).getField("u").alias("u")).select("u", "v")
    links = stage(alike(best, sets), "tie-links")
    roots = components(links)
    around = inside.select(F.col("u").alias("key"), F.col("v").alias("node")).union(inside.select("u", "u")).distinct()
    placed = around.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("place"))
    placed = stage(placed.join(sets.select("node", F.size("shingles").alias("size")), "node"), "tie-places")
    return links.unionByName(between(placed, sets))


def near_groups(docs: DataFrame, shingle: int = 2) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``: components of texts at least four fifths alike.

    The set of a text is its distinct runs of ``shingle`` words, A-Z as a-z; with
    fewer words it is all of them as one. Sets are linked if their common part is
    at least 0.8 of their union, in whole numbers on 64-bit hashes. Texts without
    words, null ones among them, have empty sets and are linked with nothing:
    their component is their own id. ``component_id`` is the smallest id reached
    (null only if all are), ``kept`` tells rows whose id it is; null ids equal
    each other, repeated rows stay rows of their own. Other columns are left out;
    an empty table gives an empty table.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.hash("text").alias("th"))
    prints = stage(C.map_batches(texts, _signatures(shingle), "doc_id bigint, th int, node bigint, n_shingles bigint, halves binary"), "signatures")
    kinds = stage(prints.where("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "th")).alias("one"), F.min("n_shingles").alias("size"),
        F.min("halves").alias("halves")), "kinds")
    tied = stage(ties(kinds), "ties")
    trees = components(tied.select("u", "v")).withColumnRenamed("root", "key")
    members = kinds.join(trees, "node").select("node", "key", "size", "one")
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("shingles"))
    members = stage(members.join(counts.select("key", (F.expr(f"rows > {GROUP} or shingles > {GROUP_SHINGLES}")).alias("large")), "key"), "members")
    wanted = members.select(F.col("one.doc_id").alias("_id"), F.col("one.th").alias("_th"), "node", "key", "large")
    same = F.expr("doc_id <=> _id and th = _th")
    needed = texts.join(wanted.hint("merge"), same).select("node", "key", "large", "text")  # one plan at every size; wanted grows with the copies
    # Sets carry their tree, so that those of small trees go to it without a join. Rows that share id and text may repeat a node.
    sets = stage(C.map_batches(needed, _sets(shingle), "node bigint, key bigint, large boolean, shingles array<bigint>"), "sets")
    zero = F.lit(0)
    links = compared(sets.where("not large").withColumns({"one": zero, "two": zero, "place": F.col("node")}))  # the stars of whole trees, so their components
    roots = links.select(F.explode(F.array_distinct(F.array("u", "v"))).alias("node"), F.col("u").alias("root")).distinct()
    large = members.where("large").select("node", "key")
    used = [tied, members, sets]
    if not large.isEmpty():
        used.append(stage(sets.where("large").select("node", "shingles").dropDuplicates(["node"]), "large-sets"))
        roots = roots.unionByName(components(_large(tied, large, used[-1])))
    roots = stage(roots, "component-roots")
    for table in used:
        unstage(table)
    placed = stage(kinds.select("node", "first_id").join(roots, "node"), "placed")
    first = placed.groupBy("root").agg(F.min("first_id").alias("least"))
    found = placed.join(first, "root").select("node", "least")
    own = kinds.select("node", "first_id").join(found, "node", "left").select("node", F.coalesce("least", "first_id").alias("component_id"))
    own = prints.select("doc_id", "node", "n_shingles").join(own, "node", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return own.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
