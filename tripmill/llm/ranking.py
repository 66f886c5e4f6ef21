"""The documents that rank highest for each query text, by block-max MaxScore over shards of an inverted index.

A task turns its texts into shards: for each term of the queries the numbers of
the shard's documents that hold it and how often, in compressed blocks. Of each
block the largest frequency and the shortest length stay outside, which bound
what any of its documents can score. The shards are written to the shared folder;
they tell the counts that the weights need, and are then searched for all queries.

A query's lists are sorted by the most they can add. Those that together stay
below the score to beat are not essential: a document only in them cannot rank.
Candidates come from the essential lists; in the others they are looked up from
the strongest down, and a candidate whose score, the bound of the block it would
be in and the bounds of the lists still to come fall short goes before that
block is decompressed. A task carries its heaps from shard to shard; those of
the tasks are merged in two steps.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripmill.llm import common as C
from tripmill.llm.recompress import word_hashes
from tripmill.session import stage, unstage

BLOCK = 128  # postings of a block
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1 << 21
QUERY_TERMS = 1 << 18  # terms of the queries searched at once; more queries go in blocks
LAST = (1 << 63) - 1  # a null id comes after all others
SALTS = 16

_INDEX = ("docs bigint, total bigint, ids array<bigint>, lengths array<bigint>, terms array<int>, counts array<int>, first array<int>, "
          "span array<int>, most array<bigint>, least array<bigint>, near binary, far binary, few binary, many binary")
_INSIDE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of texts, in order, and the first term of each text (n + 1 numbers).

    Terms are the longest runs of ASCII letters, digits and all that is not ASCII, with A-Z lower-cased.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = _LOWER[data]
    inside = _INSIDE[data]
    wall = np.zeros(len(data) + 1, bool)
    wall[offsets] = True
    starts = np.flatnonzero(inside & (wall[:-1] | np.concatenate(([True], ~inside[:-1]))))
    ends = np.flatnonzero(inside & (wall[1:] | np.concatenate((~inside[1:], [True])))) + 1
    return word_hashes(data, starts, ends), np.searchsorted(starts, offsets)


class Queries:
    """A bounded block of query texts: distinct terms, numbered in order of their hashes, and how often each query has them."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        hashes, bounds = terms(np.frombuffer(b"".join(raw), np.uint8), offsets)
        self.terms, number = np.unique(hashes, return_inverse=True)
        self.lists = [Counter(number[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]

    def weigh(self, docs: int, frequency: dict[int, int]) -> None:
        """Weights from the number of documents with terms and of those with each term."""
        weight = {t: math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1))) for t, df in frequency.items()}
        self.lists = [{t: n * weight[t] for t, n in x.items() if weight.get(t, 0) > 0} for x in self.lists]


def _shard(docs: int, total: int, ids: list, lengths: list, posts: list) -> pa.RecordBatch:
    """One row of the index from parts of (document number, term, frequency)."""
    own, n = np.concatenate(ids), np.concatenate(lengths)
    doc, term, tf = (np.concatenate(x) for x in zip(*posts))
    order = np.lexsort((doc, term))
    doc, term, tf = doc[order], term[order], tf[order]
    begin = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
    counts = np.diff(np.append(begin, len(term)))
    blocks = -(-counts // BLOCK)
    head = np.repeat(begin, blocks) + BLOCK * C.spans(np.zeros(len(blocks), np.int64), blocks)
    size = np.diff(np.append(head, len(term)))
    block = np.repeat(np.arange(len(head)), size)
    first = doc[head]
    offset = doc - first[block]
    top = lambda f, x: f.reduceat(x, head) if len(head) else np.zeros(0, np.int64)
    span, most, least = top(np.maximum, offset), top(np.maximum, tf), top(np.minimum, n[doc])
    wide, large = (span > 255)[block], (most > 255)[block]
    columns = [
        [docs], [total], [own], [n], [term[begin]], [counts], [first], [span], [most], [least],
        [offset[~wide].astype(np.uint8).tobytes()], [offset[wide].astype(np.uint16).tobytes()],
        [tf[~large].astype(np.uint8).tobytes()], [tf[large].astype(np.int64).tobytes()]]
    kinds = [pa.int64()] * 2 + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.int32())] * 4 + [pa.list_(pa.int64())] * 2 + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _INDEX.split(", ")])


def _index(wanted: np.ndarray):
    """Shards of the texts of a task, for the terms whose sorted hashes are ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = total = kept = posted = 0
        ids, lengths, posts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [(np.zeros(0, np.int64),) * 3]
        for batch in batches:
            data, offsets = C.text_bytes(batch.column("text"))
            all_ids = batch.column("doc_id").to_numpy()
            for at, stop in C.slices(offsets):
                hashes, bounds = terms(data[offsets[at]: offsets[stop]], offsets[at: stop + 1] - offsets[at])
                n = np.diff(bounds)
                docs, total = docs + int((n > 0).sum()), total + int(n.sum())
                if not len(hashes) or not len(wanted):
                    continue
                place = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
                hit = wanted[place] == hashes
                owner = np.repeat(np.arange(stop - at), n)[hit]
                pair, tf = np.unique(owner * len(wanted) + place[hit], return_counts=True)
                owner, term = np.divmod(pair, len(wanted))
                with_terms, number = np.unique(owner, return_inverse=True)
                ids.append(all_ids[at:stop][with_terms])
                lengths.append(n[with_terms])
                posts.append((number + kept, term, tf))
                kept, posted = kept + len(with_terms), posted + len(tf)
                if kept + 1000 > SHARD_DOCS or posted > SHARD_POSTINGS:
                    yield _shard(docs, total, ids, lengths, posts)
                    docs = total = kept = posted = 0
                    ids, lengths, posts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [(np.zeros(0, np.int64),) * 3]
        if docs:
            yield _shard(docs, total, ids, lengths, posts)
    return run


class Shard:
    """The postings of one row of the index, with bounds that follow from the corpus counts ``docs`` and ``total``."""

    def __init__(self, row: dict, docs: int, total: int):
        self.ids, lengths, first, span, most, least = (row[c] for c in ("ids", "lengths", "first", "span", "most", "least"))
        self.first, self.span = first.astype(np.int64), span
        self.norms = 8 * (25 + 75 * lengths * docs // total)
        self.bounds = self._impact(most, 8 * (25 + 75 * least * docs // total))
        counts = row["counts"].astype(np.int64)
        blocks = -(-counts // BLOCK)
        edge = np.concatenate(([0], np.cumsum(blocks)))
        self.lists = {t: (int(a), int(b)) for t, a, b in zip(row["terms"].tolist(), edge[:-1], edge[1:])}
        self.size = np.full(len(first), BLOCK)
        self.size[edge[1:] - 1] = counts - BLOCK * (blocks - 1)
        self.wide, self.large = span > 255, most > 255
        self.near, self.few = np.frombuffer(row["near"], np.uint8), np.frombuffer(row["few"], np.uint8)
        self.far, self.many = np.frombuffer(row["far"], np.uint16), np.frombuffer(row["many"], np.int64)
        self.at = [self._places(x) for x in (~self.wide, self.wide, ~self.large, self.large)]
        self.opened = 0

    def _places(self, here: np.ndarray) -> np.ndarray:
        size = np.where(here, self.size, 0)
        return np.cumsum(size) - size

    @staticmethod
    def _impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + norm)

    def open(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of the postings in ``blocks``, decompressed."""
        self.opened += len(blocks)
        size = self.size[blocks]
        owner = np.repeat(np.arange(len(blocks)), size)
        out = []
        for flag, narrow, broad, low, high in ((self.wide, self.near, self.far, self.at[0], self.at[1]), (self.large, self.few, self.many, self.at[2], self.at[3])):
            value, there = np.empty(len(owner), np.int64), flag[blocks]
            for take, data, start in ((~there, narrow, low), (there, broad, high)):
                value[take[owner]] = data[C.spans(start[blocks[take]], size[take])]
            out.append(value)
        doc = self.first[blocks][owner] + out[0]
        return doc, self._impact(out[1], self.norms[doc])

    def search(self, query: dict[int, int], beat: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of all that reach ``beat`` and could be among the ``most`` first."""
        lists = [(weight * int(self.bounds[a:b].max()), weight, a, b) for t, weight in query.items() for a, b in [self.lists.get(t, (0, 0))] if b > a]
        lists.sort()
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        below = np.cumsum([0] + [x[0] for x in lists])
        seeds = np.zeros(0, np.int64)  # documents of the strongest lists: their scores are real, so they may raise the score to beat
        for _, _, a, b in reversed(lists if not beat else []):
            seeds = np.union1d(seeds, self.open(np.arange(a, b))[0])
            if len(seeds) >= most:
                scores = self._look_up(lists, below, seeds, np.zeros(len(seeds), np.int64), len(lists), 0)[1]
                beat = max(beat, int(np.partition(scores, len(scores) - most)[len(scores) - most]))
                break
        essential = int(np.searchsorted(below[1:], beat, "left"))
        if essential == len(lists):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        score = np.zeros(len(self.ids), np.int64)
        for _, weight, a, b in lists[essential:]:
            doc, impact = self.open(np.arange(a, b))
            score[doc] += weight * impact
        found = np.flatnonzero(score)
        found, scores = self._look_up(lists, below, found, score[found], essential, beat)
        good = scores >= max(beat, 1)
        return found[good], scores[good]

    def _look_up(self, lists: list, below: np.ndarray, found: np.ndarray, scores: np.ndarray, until: int, beat: int):
        """Add what the lists under ``until`` have for the candidates; those that cannot reach ``beat`` go."""
        for i in range(until - 1, -1, -1):
            _, weight, a, b = lists[i]
            alive = scores + below[i + 1] >= beat
            found, scores = found[alive], scores[alive]
            if not len(found):
                break
            block = a + np.maximum(np.searchsorted(self.first[a:b], found, "right") - 1, 0)
            past = found - self.first[block]
            inside = (past >= 0) & (past <= self.span[block])
            alive = scores + np.where(inside, weight * self.bounds[block], 0) + below[i] >= beat
            found, scores, block, inside = found[alive], scores[alive], block[alive], inside[alive]
            if inside.any():
                doc, impact = self.open(np.unique(block[inside]))
                at = np.minimum(np.searchsorted(doc, found), len(doc) - 1)
                scores = scores + np.where(doc[at] == found, weight * impact[at], 0)
        return found, scores


def _search(queries: Queries, docs: int, total: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries.lists]  # ids, scores
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                row = {c: v.values.to_numpy() if isinstance(v, pa.ListScalar) else v.as_py() for c, v in row.items()}
                shard = Shard(row, docs, total)
                for q, query in enumerate(queries.lists):
                    ids, scores = heaps[q]
                    found, more = shard.search(query, int(scores[-1]) if len(scores) == most else 0, most)
                    if len(found):
                        ids, scores = np.append(ids, shard.ids[found]), np.append(scores, more)
                        best = np.lexsort((ids, -scores))[:most]
                        heaps[q] = ids[best], scores[best]
        query = np.repeat(np.arange(len(heaps)), [len(h[0]) for h in heaps])
        if len(query):
            ids, scores = (np.concatenate(x) for x in zip(*heaps))
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids), pa.array(scores)], names=["query", "doc_id", "score"])
    return run


def _ranked(texts: DataFrame, queries: Queries, most: int) -> DataFrame:
    """``query, rank, doc_id, score`` for one block of queries."""
    C.small_batches(texts.sparkSession)
    index = stage(texts.mapInArrow(_index(queries.terms), _INDEX), "shards")
    docs, total = index.agg(F.sum("docs"), F.sum("total")).first()
    lists = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    queries.weigh(docs or 0, dict(lists.groupBy("x.terms").agg(F.sum("x.counts")).collect()))  # a row per term of the block
    found = index.mapInArrow(_search(queries, docs or 0, total or 1, most), "query bigint, doc_id bigint, score bigint")
    order = [F.col("score").desc(), F.col("doc_id")]
    part = Window.partitionBy("query", "salt").orderBy(*order)
    first = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    first = first.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= most).drop("rank", "salt")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    out = stage(first.withColumn("rank", rank).where(F.col("rank") <= most), "ranked")
    unstage(index)
    return out


def top_documents(docs: DataFrame, items: DataFrame, most: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``most`` documents with the highest scores above 0 for each row of ``items``.

    ``docs`` has ``doc_id, text``, ``items`` has ``item_id, text``. Scores are
    whole numbers: a sum of term weight times a saturated frequency over the
    terms of the item, repeats included (terms are told apart by 64-bit hashes).
    Equal scores go by ascending id, null ids last. A null or empty text has no
    terms; an item without terms, or whose terms no document has, has no rows.
    Repeated documents rank each for themselves, items repeated as a whole count
    once, items with one id and different texts are ranked apart. Items are read
    in blocks of ``QUERY_TERMS`` words; what the driver holds is one block of
    items with the counts of its terms. An empty table gives an empty table.
    """
    texts = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    out = None
    held, size = [], 0

    def block() -> DataFrame:
        found = _ranked(texts, Queries([t for _, t in held]), most)
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(held)], f"query bigint, item_id {kind}")
        doc_id = F.when(F.col("doc_id") < LAST, F.col("doc_id"))
        return found.join(names, "query").select("item_id", F.col("rank").cast("int").alias("rank"), doc_id.alias("doc_id"), "score")

    kind = items.schema["item_id"].dataType.simpleString()
    for item, text in items.where("text is not null").select("item_id", "text").distinct().toLocalIterator():
        if held and size > QUERY_TERMS:
            part, held, size = block(), [], 0
            out = part if out is None else out.unionByName(part)
        held.append((item, text))
        size += len(text) // 2 + 1
    if held or out is None:
        part = block()
        out = part if out is None else out.unionByName(part)
    return out
