"""Numbers of unigram tokens, without the tokens: best paths that carry a score and a count."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmill.llm import common as C
from tripmill.llm import pieces as P

UNKNOWN_PENALTY = 10.0  # fixed value: an unknown character scores this much below the lowest piece
_COUNTERS: dict[tuple, TokenCounter] = {}


class TokenCounter:
    """Tokens of a unigram model with byte fallback, where each space begins a new unit.

    Among segmentations of a unit the one with the highest score wins. Paths are
    extended from left to right, and a path only replaces another to the same
    place if its score is higher, so of equal ones that with the longest last
    piece stays. A character without a piece of its own may be an unknown piece,
    which counts as its bytes if the vocabulary has all bytes, else as one with
    its unknown neighbours.
    """

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], keep: int = 800_000):
        self.matcher = P.Matcher(pieces)
        self.scores = np.array([*scores, min(scores) - UNKNOWN_PENALTY])
        self.bytes = sum(k == 2 for k in kinds) == 256
        self.known = P.Kept(keep)

    def count_units(self, units: list[str]) -> list[int]:
        """Tokens of each of the distinct ``units``."""
        new = self.known.missing(units)
        for chosen in P.length_classes(new):
            group = [new[i] for i in chosen]
            self.known.young.update(zip(group, self._best(group)))
        return [self.known.young[u] for u in units]

    def _best(self, units: list[str]) -> list[int]:
        lengths = np.array([len(u) for u in units], np.int64)
        unknown = len(self.scores) - 1
        unit, start, end, piece = P.with_unknown(*self.matcher.find(units), lengths, unknown)
        score = np.full((len(units), int(lengths.max()) + 1), -np.inf)
        score[:, 0] = 0.0
        count = np.zeros(score.shape, np.int64)
        open_run = np.zeros(score.shape, bool)  # whether the best path ends in an unknown piece
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        offset = np.cumsum(lengths) - lengths
        edges = np.searchsorted(end, np.arange(score.shape[1] + 1))
        for e in range(1, score.shape[1]):
            lo, hi = edges[e], edges[e + 1]
            if lo == hi:
                continue
            u, s, p = unit[lo:hi], start[lo:hi], piece[lo:hi]
            value = score[u, s] + self.scores[p]
            first = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
            best = np.repeat(np.maximum.reduceat(value, first), np.diff(np.append(first, len(u))))
            winner = np.flatnonzero(value == best)
            winner = winner[np.concatenate(([True], u[winner][1:] != u[winner][:-1]))]
            u, s, p = u[winner], s[winner], p[winner]
            score[u, e] = value[winner]
            strange = p == unknown
            if self.bytes:
                code = codes[(offset[u] + s)[strange]]
                step = np.ones(len(u), np.int64)
                step[strange] += (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
            else:
                step = np.where(strange & open_run[u, s], 0, 1)
            count[u, e] = count[u, s] + step
            open_run[u, e] = strange
        return count[np.arange(len(units)), lengths].tolist()

    def count(self, texts: list[str]) -> list[int]:
        split = []
        for t in texts:
            t = t.replace(" ", P.MARK)
            split.append(Counter([P.MARK + x for x in (t[1:] if t.startswith(P.MARK) else t).split(P.MARK)]) if t else Counter())
        units = list(dict.fromkeys(u for c in split for u in c))
        number = dict(zip(units, self.count_units(units)))
        return [sum(number[u] * n for u, n in c.items()) for c in split]


def with_token_counts(docs: DataFrame, path: str = P.DEFAULT_MODEL) -> DataFrame:
    """``doc_id, n_tokens`` for each row of ``docs``; a null or empty text has none.

    The vocabulary file is read by the driver and sent with the tasks; its size
    does not depend on the input. Repeated rows and null ids are rows like any
    other; an empty table gives an empty table; other columns are left out.
    """
    pieces, scores, kinds = P.read_vocabulary(path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if path not in _COUNTERS:
            _COUNTERS[path] = TokenCounter(pieces, scores, kinds)
        counts = _COUNTERS[path].count(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return C.map_batches(texts, run, "doc_id bigint, n_tokens bigint")
