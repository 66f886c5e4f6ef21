"""Words one edit apart, by composing acceptors of the vocabulary with a one-edit transducer.

The vocabulary is an acyclic acceptor; it is composed with a transducer that
copies all symbols but one, which it inserts, deletes or replaces, and with the
acceptor again. The composition is taken apart at its initial states: words of
``n`` and ``n + 1`` symbols are dealt by the state that their first ``n // 2``
symbols lead to, where the edit comes later, and by the state that their last
ones lead to from the end, where it comes earlier. Each such state is small,
since the symbols left are few or the ones read are many. Its two residual
languages (words of ``n`` and of ``n + 1`` symbols) are minimised into one
acceptor with shared states, and the accepted pairs are listed by walking the
composition; equal states of a minimised acceptor have equal languages, so the
walk after the edit is worked out once per pair of states. Only sums per word
leave the task: how many words are near, and the most frequent of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmill.session import stage

RUN = r"[a-zÀ-ÿ]+"  # of texts with A-Z lower-cased
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, spoilt: int = 97) -> DataFrame:
    """``word``: each run of letters of ``docs``, A-Z lower-cased; one of ``spoilt`` (by hash) lacks a letter. A null id counts as empty."""
    run = F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(RUN), F.lit(0)))
    runs = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return hashed.select(F.when(F.col("h") % spoilt == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(found: DataFrame, length: int = 5, times: int = 3) -> DataFrame:
    """``word, n`` for the words of at least ``length`` symbols that occur at least ``times`` times."""
    counted = found.where(F.length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= times)


class Acceptor:
    """Minimised acyclic acceptor: state 0 has no arcs and accepts; a state is known by its arcs and whether it accepts."""

    def __init__(self):
        self.states: dict[tuple, int] = {(True, ()): 0}
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[bool] = [True]
        self.shared: dict[tuple[int, int], list[str]] = {}

    def add(self, language: list[str]) -> int:
        """The state whose language is ``language`` (sorted, distinct)."""
        final = bool(language) and not language[0]
        arcs, at, end = {}, int(final), len(language)
        while at < end:
            symbol, stop = language[at][0], at
            while stop < end and language[stop][0] == symbol:
                stop += 1
            arcs[symbol] = self.add([w[1:] for w in language[at:stop]])
            at = stop
        key = (final, tuple(arcs.items()))
        if key not in self.states:
            self.states[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return self.states[key]

    def common(self, p: int, q: int) -> list[str]:
        """The words that both states accept: what may follow the edit."""
        if p > q:
            p, q = q, p
        if (p, q) not in self.shared:
            out = [""] if self.final[p] and self.final[q] else []
            one, two = self.arcs[p], self.arcs[q]
            for symbol in one.keys() & two.keys():
                out += [symbol + rest for rest in self.common(one[symbol], two[symbol])]
            self.shared[p, q] = out
        return self.shared[p, q]

    def replaced(self, p: int, read: str = "") -> Iterator[tuple[str, str]]:
        """Accepted pairs of ``p``, the transducer with one symbol replaced, and ``p``; each pair once."""
        arcs = list(self.arcs[p].items())
        for i, (a, to) in enumerate(arcs):
            for b, other in arcs[i + 1:]:
                for rest in self.common(to, other):
                    yield read + a + rest, read + b + rest
            yield from self.replaced(to, read + a)

    def inserted(self, p: int, q: int, read: str = "") -> Iterator[tuple[str, str]]:
        """Accepted pairs of ``p``, the transducer with one symbol inserted, and ``q``; some more than once."""
        for b, other in self.arcs[q].items():
            for rest in self.common(p, other):
                yield read + rest, read + b + rest
        one, two = self.arcs[p], self.arcs[q]
        for a in one.keys() & two.keys():
            yield from self.inserted(one[a], two[a], read + a)


def near_pairs(short: list[str], long: list[str]) -> set[tuple[str, str]]:
    """Pairs one edit apart of which the first is in ``short``; ``long`` has words of one symbol more."""
    acceptor = Acceptor()
    p, q = acceptor.add(sorted(short)), acceptor.add(sorted(long))
    return {*acceptor.replaced(p), *acceptor.inserted(p, q)}


def states(vocabulary: DataFrame) -> DataFrame:
    """``size, back, state, word, n``: each word under the states it goes through, as one of ``size`` symbols or of one more."""
    size = F.col("size")
    both = vocabulary.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("size"))
    ways = both.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    half = F.floor(size / 2).cast("int")
    read = F.when(F.col("back"), F.expr("substr(word, -(size - floor(size / 2)))")).otherwise(F.substr("word", F.lit(1), half))
    return ways.select("size", "back", read.alias("state"), "word", "n")


def _enumerate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, near, best``: for each word of a state the number of near words found there and the first of them."""

    def emit(key: tuple, held: dict[str, int]) -> list[tuple]:
        size, back, _ = key
        head = size // 2
        if back:  # read from the end: what is left is the beginning, and it must differ there
            tail = size - head
            left = {w[:-tail][::-1]: w for w in held}
        else:
            left = {w[head:]: w for w in held}
        rest = size - (tail if back else head)
        found: dict[str, list] = {}
        for a, b in near_pairs([x for x in left if len(x) == rest], [x for x in left if len(x) == rest + 1]):
            one, two = left[a], left[b]
            if back and one[:head] == two[:head]:
                continue  # found from the beginning
            for w, other in ((one, two), (two, one)):
                here = found.setdefault(w, [0, 0, ""])
                here[0] += 1
                if (-held[other], other) < (-here[1], here[2]):
                    here[1:] = held[other], other
        return [(w, *x) for w, x in found.items()]

    def rows(listed: list[tuple]) -> pa.RecordBatch:
        word, near, n, best = zip(*listed)
        return pa.RecordBatch.from_arrays(
            [pa.array(word, pa.string()), pa.array(near, pa.int64()), pa.array(n, pa.int64()), pa.array(best, pa.string())],
            names=["word", "n_near", "best_n", "best"])

    last, held, out = None, {}, []
    for batch in batches:
        for *key, word, n in zip(*(batch.column(c).to_pylist() for c in ("size", "back", "state", "word", "n"))):
            if key != last:
                if len(held) > 1:
                    out += emit(last, held)
                last, held = key, {}
            held[word] = n
        if len(out) > 5000:
            yield rows(out)
            out = []
    if len(held) > 1:
        out += emit(last, held)
    if out:
        yield rows(out)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` for the words with near ones: their number, and the most frequent with its count."""
    state = ["size", "back", "state"]
    dealt = states(vocabulary)
    found = dealt.repartition(*state).sortWithinPartitions(*state).mapInArrow(
        _enumerate, "word string, n_near bigint, best_n bigint, best string")
    order = F.struct(-F.col("best_n"), "best")  # most frequent first, then in code-point order, that of UTF-8 bytes
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.max("best_n").alias("best_n"), F.min_by("best", order).alias("best"))


def with_roots(formed: DataFrame) -> DataFrame:
    """``word, root`` for the words with a ``form``: the end of the chain of forms, by doubling steps."""
    links = stage(formed.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        step = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stage(links.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if longer.where("moved").isEmpty():
            return links
        links = longer.select("word", "root")


def spelling_forms(docs: DataFrame, ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for the vocabulary of ``docs``.

    Words are maximal runs of Latin letters with A-Z lower-cased, one of 97 runs
    (by a hash of id and run) without one of its letters; those of at least five
    symbols and three occurrences count. Two words are near if one inserted,
    deleted or replaced symbol tells them apart. ``form`` is the near word of
    largest ``n`` (ties: the first in code-point order) if that is at least
    ``ratio`` times the word's own, else null with ``form_n``; ``root`` is the
    last of the forms of forms, the word itself if there is none. Null texts
    have no words, a null id counts as empty text, repeated rows count again;
    an empty table gives an empty table. Columns of ``docs`` but id and text
    are left out.
    """
    known = stage(vocabulary(words(docs)), "vocabulary")
    placed = known.join(near_words(known), "word", "left")
    near = F.col("best_n") >= F.col("n") * ratio
    formed = stage(placed.select(
        "word", F.when(near, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(near, F.col("best_n")).alias("form_n")), "forms-found")
    roots = with_roots(formed)
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
