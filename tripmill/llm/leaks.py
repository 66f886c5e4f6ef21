"""Benchmark items inside texts: BM25 over an inverted index of the items with block-max WAND, then overlap of words in order."""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmill.llm import common as C
from tripmill.session import stage

K1, B = 1.2, 0.75
THRESHOLD = 0.6  # of the score that the item itself has
SHINGLE = 5
OVERLAP = 0.6  # share of the shingles of question and of answer that must be in the passage, unless their words are there in order
EDITS = 0.2  # share of the words of question or answer that may be missing from that order; two words in any case
SLIP = 2  # words by which edits may move a part of the item
ANSWER = 0.25  # share of an item's words, its last ones, that is its answer
POSTINGS = 16  # in a block of a posting list
RANGES = 64  # of items, for which the largest impact of each term is kept too
INDEX_WORDS = 500_000  # words of items in one index, about; more items are searched in several
_WORD = re.compile(r"\w+")
_SLACK = 1e-9


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Index:
    """Postings of a bounded set of items: impacts are BM25 weights over the score of the item by itself."""

    def __init__(self, items: dict[int, list[str]], frequency: dict[str, int], n_items: int, mean_words: float):
        self.ids = sorted(items)
        self.words = [items[i] for i in self.ids]
        self.longest = max((len(w) for w in self.words), default=1)
        lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for number, words in enumerate(self.words):
            counts: dict[str, int] = {}
            for w in words:
                counts[w] = counts.get(w, 0) + 1
            weights = {}
            for w, tf in counts.items():
                idf = math.log(1 + (n_items - frequency[w] + 0.5) / (frequency[w] + 0.5))
                weights[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_words))
            own = sum(weights.values())
            for w, x in weights.items():
                lists[w].append((number, x / own))
        self.terms = {w: t for t, w in enumerate(lists)}
        self.items = [[p[0] for p in x] for x in lists.values()]
        self.impacts = [[p[1] for p in x] for x in lists.values()]
        self.block_most = [[max(x[i: i + POSTINGS]) for i in range(0, len(x), POSTINGS)] for x in self.impacts]
        self.most = np.array([max(x) for x in self.impacts] + [0.0])
        size = max(1, -(-len(self.ids) // RANGES))
        self.range_most = np.zeros((len(self.most), -(-len(self.ids) // size) or 1))
        for t, (listed, impacts) in enumerate(zip(self.items, self.impacts)):
            np.maximum.at(self.range_most[t], np.array(listed) // size, impacts)

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score for these distinct terms is at least ``threshold``, by block-max WAND."""
        end = len(self.ids)
        need = threshold - _SLACK
        cursors = [[self.items[t][0], 0, t] for t in terms]  # item, place in the list, term
        out = []

        def advance(cursor: list, to: int) -> None:
            listed, at = self.items[cursor[2]], cursor[1]
            while at < len(listed) and listed[at] < to:
                at += 1
            cursor[0], cursor[1] = (listed[at] if at < len(listed) else end), at

        while True:
            cursors = [c for c in cursors if c[0] < end]
            cursors.sort()
            total, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                total += self.most[c[2]]
                if total >= need:
                    pivot = i
                    break
            if pivot < 0:
                return out
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, past = 0.0, end
            for c in cursors[: pivot + 1]:
                listed, at = self.items[c[2]], c[1]
                block = at // POSTINGS
                while (stop := min(len(listed), (block + 1) * POSTINGS)) < len(listed) and listed[stop - 1] < item:
                    block += 1
                if listed[stop - 1] >= item:
                    bound += self.block_most[c[2]][block]
                    past = min(past, listed[stop - 1] + 1)
            if bound >= need:
                if cursors[0][0] == item:
                    score = sum(self.impacts[c[2]][c[1]] for c in cursors[: pivot + 1])
                    if score >= need:
                        out.append((item, score))
                    for c in cursors[: pivot + 1]:
                        advance(c, item + 1)
                else:
                    for c in cursors[:pivot]:
                        if c[0] < item:
                            advance(c, item)
            else:
                if pivot + 1 < len(cursors):
                    past = min(past, cursors[pivot + 1][0])
                for c in cursors[: pivot + 1]:
                    advance(c, max(past, item + 1) if past > item else item + 1)

    def passages(self, words: list[str], threshold: float) -> list[tuple[int, int, int, list[int]]]:
        """Passages that could reach the threshold: first word, one past the last, and the distinct terms in it.

        A passage is left out if its largest impacts in each range of items add up to
        less, the test of block-max WAND for all passages of a text at once. Passages are ``SLIP`` words more than twice as long as the
        longest item and begin every such length, so each stretch of an item's length lies inside one, inserted words with it.
        """
        step = self.longest
        none = len(self.most) - 1
        get = self.terms.get
        terms = np.fromiter((get(w, none) for w in words), np.int64, len(words))
        starts = np.arange(0, max(1, len(words) - step), step)
        stops = np.minimum(starts + 2 * step + SLIP, len(words))
        lengths = stops - starts
        passage, term = np.repeat(np.arange(len(starts)), lengths), terms[C.spans(starts, lengths)]
        pairs = np.unique((passage * len(self.most) + term)[term < none])
        if not len(pairs):
            return []
        passage, term = np.divmod(pairs, len(self.most))
        first = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
        bound = np.add.reduceat(self.range_most[term], first, axis=0).max(axis=1)
        ends = np.append(first[1:], len(pairs))
        return [
            (int(starts[passage[f]]), int(stops[passage[f]]), term[f:e].tolist())
            for f, e, most in zip(first, ends, bound) if most >= threshold - _SLACK
        ]

    def matches(self, words: list[str], threshold: float = THRESHOLD, overlap: float = OVERLAP) -> dict[int, tuple[float, float, float]]:
        """Items found in a text: item id to score and the overlaps of question and answer, the best of its passages."""
        found: dict[int, tuple[float, float, float]] = {}
        for start, stop, terms in self.passages(words, threshold):
            hits = self.search(terms, threshold)
            if not hits:
                continue
            passage = words[start:stop]
            shingles = {n: {tuple(passage[i: i + n]) for i in range(len(passage) - n + 1)} for n in range(1, SHINGLE + 1)}
            for number, score in hits:
                question, answer = parts(self.words[number])
                shares = _share(question, shingles), _share(answer, shingles)
                ok = min(shares) >= overlap
                if not ok:
                    for asked, told in aligned(self.words[number], passage):
                        least = overlap * len(question) if shares[0] >= overlap else len(question) - allowed(len(question))
                        if asked >= least and (shares[1] >= overlap or told >= len(answer) - allowed(len(answer))):
                            ok, shares = True, (max(shares[0], asked / len(question)), max(shares[1], told / len(answer)))
                            break
                if ok:
                    item = self.ids[number]
                    found[item] = max(found.get(item, (0.0, 0.0, 0.0)), (score, *shares))
        return found


def parts(words: list[str]) -> tuple[list[str], list[str]]:
    """Question and answer of an item; the answer is at least one word, of an item of one word that word is both."""
    size = max(1, round(len(words) * ANSWER))
    return (words[:-size] or words), words[-size:]


def _share(words: list[str], shingles: dict[int, set]) -> float:
    n = min(SHINGLE, len(words))
    own = {tuple(words[i: i + n]) for i in range(len(words) - n + 1)}
    return sum(s in shingles[n] for s in own) / len(own)


def allowed(n: int) -> int:
    """Words of a part of ``n`` words that may be changed or missing: two, at most half of a part; more of a long one."""
    return max(min(2, n // 2), int(n * EDITS))


def in_order(words: list[str], text: list[str]) -> int:
    """Length of the longest common subsequence, by bits."""
    masks: dict[str, int] = {}
    for i, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << i
    open_ = full = (1 << len(words)) - 1
    for w in text:
        hit = open_ & masks.get(w, 0)
        open_ = (open_ + hit) | (open_ - hit)
    return len(words) - (open_ & full).bit_count()


def aligned(words: list[str], passage: list[str]) -> list[tuple[int, int]]:
    """Words of question and of answer found in order, for each place of the passage where half of the item's words line up.

    Of places less than half an item apart only the one counts at which most words do.
    """
    at: dict[str, list[int]] = defaultdict(list)
    for j, w in enumerate(words):
        at[w].append(j)
    votes: dict[int, int] = defaultdict(int)
    for i, w in enumerate(passage):
        for j in at.get(w, ()):
            votes[i - j] += 1
    question, answer = parts(words)
    out, taken = [], []
    for d in sorted(votes, key=lambda d: (-votes[d], d)):
        if any(2 * abs(d - t) < len(words) for t in taken):
            continue
        if 2 * sum(votes.get(d + k, 0) for k in range(-SLIP, SLIP + 1)) >= len(words):
            taken.append(d)
            start = max(0, d - SLIP)
            asked = in_order(question, passage[start: max(0, d + len(question) + SLIP)])
            # What the whole item has beyond its question, so that no word counts for both parts.
            told = in_order(words, passage[start: max(0, d + len(words) + SLIP)]) - asked
            out.append((asked, told if len(words) > 1 else asked))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``doc_id, th, item_id, score, question_overlap, answer_overlap``: each text with each item found in it.

    ``items`` has ``item_id, text``; they go into indexes of about ``INDEX_WORDS``
    words, a scan of the texts each, with document frequencies over all of them.
    Words are runs of word characters in lower case. Items that are null or
    without words are not looked for; a repeated item counts once per distinct
    id and text, and its id is found if any of its texts is. A null text has no
    words. Repeated rows are found alike. Empty tables give an empty table.
    Of question and of answer either ``overlap`` of the shingles must be in the
    passage or all words but ``allowed`` in order, where the item lines up.
    """
    spark = docs.sparkSession
    listed = items.where("text is not null and item_id is not null").select("item_id", "text").distinct()
    tokens = F.expr(r"regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+', 0)")
    sized = stage(listed.withColumn("n", F.size(tokens)).where("n > 0"), "items")
    total = sized.agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("words")).first()
    schema = "doc_id bigint, th int, item_id bigint, score double, question_overlap double, answer_overlap double"
    if not total["items"]:
        return spark.createDataFrame([], schema)
    blocks = math.ceil(total["words"] / INDEX_WORDS)
    sized = sized.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    texts = docs.select("doc_id", F.hash("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    by_word = sized.select("item_id", "block", F.explode(F.array_distinct(tokens)).alias("word"))
    frequency = stage(by_word.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "item-words")
    out = None
    for block in range(blocks):
        held = {(r["item_id"], i): words_of(r["text"]) for i, r in enumerate(
            sized.where(F.col("block") == block).select("item_id", "text").orderBy("item_id", "text").collect())}
        own = by_word.where(F.col("block") == block).select("word").distinct()
        counts = {r["word"]: r["df"] for r in frequency.join(own, "word").collect()}
        held = {k: w for k, w in held.items() if w}
        if not held:
            continue
        for words in held.values():
            for w in words:
                counts.setdefault(w, 1)
        index = Index(held, counts, total["items"], total["words"] / total["items"])

        def run(batch: pa.RecordBatch, index=index) -> pa.RecordBatch | None:
            rows = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                best: dict[int, tuple] = {}
                for (item, _), shares in index.matches(words_of(text), threshold, overlap).items():
                    best[item] = max(best.get(item, (0.0,)), shares)
                rows += [(i, item, *shares) for item, shares in sorted(best.items())]
            if not rows:
                return None
            i, item, *shares = zip(*rows)
            take = pa.array(i)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(item, pa.int64()),
                 *[pa.array(s, pa.float64()) for s in shares]],
                names=["doc_id", "th", "item_id", "score", "question_overlap", "answer_overlap"])

        found = C.map_batches(texts, run, schema)
        out = found if out is None else out.unionByName(found)
    if blocks == 1:
        return out
    # An id may have different texts in several indexes.
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best")
    return out.groupBy("doc_id", "th", "item_id").agg(best).select("doc_id", "th", "item_id", "best.*")


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns kept."""
    found = stage(find_leaks(docs, items).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct(), "leaks")
    return C.match_rows(docs, found, "left_anti")
