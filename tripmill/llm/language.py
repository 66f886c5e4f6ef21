"""Language of a text by unigram pieces, summed over all segmentations."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmill.llm import common as C
from tripmill.llm import pieces as P
from tripmill.session import stage

LEARN_UNIT = 40  # characters; longer words are learned from, not scored, in parts of this many
PLAIN = 24  # characters; sums over longer words are kept as logarithms, as plain ones could vanish
BLOCK = 1024  # characters of long words in hand at a time
CELLS = 1 << 21  # numbers (units x characters x languages) in one table of sums
KEPT = 2_400_000  # numbers (units x languages) kept from earlier batches
ROUNDS = 3
SMOOTHING = 0.05  # added to the expected count of each piece
LEARN_ROWS = 1000  # labelled texts learned from per language, at most, whole
UNKNOWN = 1e-6  # probability of a character that the vocabulary lacks, in any language
_MATCHERS: dict[str, P.Matcher] = {}


def units(text: str) -> list[str]:
    """Words, whole and in lower case, with the mark that begins a word; a word is what stands between blanks."""
    return [P.MARK + w for w in text.lower().split()]


def learned_parts(text: str) -> list[str]:
    """``units`` with words of ``LEARN_UNIT`` characters and more in parts."""
    return [w[i: i + LEARN_UNIT] for w in units(text) for i in range(0, len(w), LEARN_UNIT)]


def _matcher(pieces: list[str], path: str) -> P.Matcher:
    if path not in _MATCHERS:
        _MATCHERS[path] = P.Matcher(pieces)
    return _MATCHERS[path]


def _edges(matcher: P.Matcher, group: list[str], unknown: int):
    lengths = np.array([len(u) for u in group], np.int64)
    return lengths, P.with_unknown(*matcher.find(group), lengths, unknown)


def forward(matcher: P.Matcher, group: list[str], probabilities: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Sums over all segmentations of each prefix of each unit, per column of ``probabilities`` (piece x language)."""
    lengths, found = _edges(matcher, group, len(probabilities) - 1)
    unit, start, end, piece = found
    alpha = np.zeros((len(group), int(lengths.max()) + 1, probabilities.shape[1]))
    alpha[:, 0] = 1.0
    edges = np.searchsorted(end, np.arange(alpha.shape[1] + 1))
    for e in range(1, alpha.shape[1]):
        lo, hi = edges[e], edges[e + 1]
        if lo < hi:
            u = unit[lo:hi]
            first = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
            alpha[u[first], e] = np.add.reduceat(alpha[u, start[lo:hi]] * probabilities[piece[lo:hi]], first, axis=0)
    return alpha, (lengths, found)


def long_logs(matcher: P.Matcher, group: list[str], probabilities: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over all segmentations of whole units of any length, unit x language.

    The same recursion as ``forward`` on logarithms. The characters come a block at a
    time; between blocks only the sums of the last ``reach`` prefixes are carried,
    ``reach`` being the length of the longest piece.
    """
    logs, reach = np.log(probabilities), max(1, int(matcher.lengths.max(initial=1)))
    block = max(BLOCK, reach)
    lengths = np.array([len(u) for u in group], np.int64)
    out = np.zeros((len(group), logs.shape[1]))
    carried = np.zeros((len(group), 1, logs.shape[1]))
    for at in range(0, int(lengths.max()), block):
        live = np.flatnonzero(lengths > at)
        before = carried.shape[1] - 1
        parts, found = _edges(matcher, [group[i][at - before : at + block] for i in live], len(logs) - 1)
        unit, start, end, piece = found
        sums = np.full((len(live), int(parts.max()) + 1, logs.shape[1]), -np.inf)
        sums[:, : before + 1] = carried
        edges = np.searchsorted(end, np.arange(sums.shape[1] + 1))
        for e in range(before + 1, sums.shape[1]):
            lo, hi = edges[e], edges[e + 1]
            if lo < hi:
                u = unit[lo:hi]
                new = np.concatenate(([True], u[1:] != u[:-1]))
                first = np.flatnonzero(new)
                ways = sums[u, start[lo:hi]] + logs[piece[lo:hi]]
                top = np.maximum.reduceat(ways, first, axis=0)
                sums[u[first], e] = top + np.log(np.add.reduceat(np.exp(ways - top[np.cumsum(new) - 1]), first, axis=0))
        ends = lengths[live] <= at + block
        out[live[ends]] = sums[ends, parts[ends]]
        carried = sums[~ends, -(min(reach, at + block) + 1) :]
    return out


def expected_counts(matcher: P.Matcher, group: list[str], weights: np.ndarray, probabilities: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece over all segmentations of ``group`` in one language, each unit ``weights`` times."""
    alpha, (lengths, (unit, start, end, piece)) = forward(matcher, group, probabilities[:, None])
    alpha = alpha[:, :, 0]
    beta = np.zeros_like(alpha)
    rows = np.arange(len(group))
    beta[rows, lengths] = 1.0
    order = np.argsort(start, kind="stable")
    unit, start, end, piece = unit[order], start[order], end[order], piece[order]
    edges = np.searchsorted(start, np.arange(alpha.shape[1] + 1))
    for s in range(alpha.shape[1] - 1, -1, -1):
        lo, hi = edges[s], edges[s + 1]
        if lo < hi:
            np.add.at(beta[:, s], unit[lo:hi], beta[unit[lo:hi], end[lo:hi]] * probabilities[piece[lo:hi]])
    share = alpha[unit, start] * probabilities[piece] * beta[unit, end] / alpha[unit, lengths[unit]] * weights[unit]
    return np.bincount(piece, weights=share, minlength=len(probabilities))


def vocabulary(path: str = P.DEFAULT_MODEL) -> list[str]:
    pieces, _, kinds = P.read_vocabulary(path)
    return sorted({p.lower() for p, k in zip(pieces, kinds) if k == 0 and p})


def fit(texts: DataFrame, path: str = P.DEFAULT_MODEL) -> dict:
    """Languages, their log shares, and the probability of each piece in each of them.

    ``texts`` has ``text`` and ``lang``, neither null. Expected counts are gathered by
    expectation maximisation over the words of at most about ``LEARN_ROWS`` different
    texts per language, chosen by a hash; the driver gets a number per language and piece.
    """
    pieces = vocabulary(path)
    shares = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(shares)
    if not languages:
        return {"languages": [], "pieces": pieces}
    bound = F.create_map(*[F.lit(x) for lang in languages for x in (lang, LEARN_ROWS / shares[lang])])
    draw = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30)) / (1 << 30)
    chosen = texts.where(draw < bound[F.col("lang")]).distinct()  # copies of a text count once

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts.update((lang, u) for u in learned_parts(text))
        langs, found = zip(*counts) if counts else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(found, pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["lang", "unit", "n"])

    table = C.map_batches(chosen.select("lang", "text"), words, "lang string, unit string, n bigint")
    table = stage(table.groupBy("lang", "unit").agg(F.sum("n").alias("n")), "language-words")
    probabilities = np.full((len(pieces) + 1, len(languages)), 1.0 / len(pieces))
    probabilities[-1] = UNKNOWN
    for _ in range(ROUNDS):

        def expect(batch: pa.RecordBatch, now=probabilities) -> pa.RecordBatch:
            matcher = _matcher(pieces, path)
            langs, found, n = (batch.column(c).to_pylist() for c in ("lang", "unit", "n"))
            out = []
            for i, lang in enumerate(languages):
                mine = [j for j, x in enumerate(langs) if x == lang]
                sums = np.zeros(len(now))
                for rows in P.length_classes([found[j] for j in mine]) if mine else ():
                    own = [mine[r] for r in rows]
                    sums += expected_counts(matcher, [found[j] for j in own], np.array([n[j] for j in own], float), now[:, i])
                used = np.flatnonzero(sums)
                out.append((np.full(len(used), i), used, sums[used]))
            language, piece, value = (np.concatenate(x) for x in zip(*out))
            return pa.RecordBatch.from_arrays(
                [pa.array(language, pa.int32()), pa.array(piece, pa.int32()), pa.array(value)], names=["language", "piece", "value"])

        C.small_batches(texts.sparkSession)
        sums = C.map_batches(table, expect, "language int, piece int, value double")
        gathered = np.full(probabilities.shape, SMOOTHING)
        for row in sums.groupBy("language", "piece").agg(F.sum("value").alias("value")).collect():
            gathered[row["piece"], row["language"]] += row["value"]
        probabilities = gathered / gathered[:-1].sum(axis=0)
        probabilities[-1] = UNKNOWN
    total = sum(shares.values())
    return {"languages": languages, "prior": np.log([shares[x] / total for x in languages]), "pieces": pieces,
            "probabilities": probabilities}


class Scorer:
    """Log probabilities of units per language; those of short units met before are kept, a number bounded by the languages."""

    def __init__(self, model: dict, path: str):
        many = max(4, len(model["languages"]))
        self.model, self.matcher, self.most, self.known = model, _matcher(model["pieces"], path), CELLS // many, P.Kept(KEPT // many)

    def logs(self, found: list[str]) -> dict[str, list[float]]:
        """Per unit one number per language."""
        probabilities, out = self.model["probabilities"], {}
        short = [u for u in found if len(u) <= PLAIN]
        new = self.known.missing(short)
        for rows in P.length_classes(new, self.most):
            group = [new[i] for i in rows]
            alpha, (lengths, _) = forward(self.matcher, group, probabilities)
            self.known.young.update(zip(group, np.log(alpha[np.arange(len(group)), lengths]).tolist()))
        out.update((u, self.known.young[u]) for u in short)
        wide = [u for u in found if len(u) > PLAIN]
        for rows in P.length_classes(wide, self.most):
            group = [wide[i] for i in rows]
            out.update(zip(group, long_logs(self.matcher, group, probabilities).tolist()))
        return out

    def posterior(self, texts: list[str | None]) -> list[tuple[str, float]]:
        languages = self.model["languages"]
        if not languages:
            return [("und", 0.0)] * len(texts)
        counts = [Counter(units(t)) if t and any(map(str.isalpha, t)) else None for t in texts]
        known = self.logs(list(dict.fromkeys(u for c in counts if c for u in c)))
        out = []
        for c in counts:
            if not c:
                out.append(("und", 0.0))
                continue
            logs = np.array([known[u] for u in c]).T @ np.fromiter(c.values(), float, len(c)) + self.model["prior"]
            best = int(np.argmax(logs))
            out.append((languages[best], float(1.0 / np.exp(logs - logs[best]).sum())))
        return out


_SCORERS: dict[str, Scorer] = {}


def predict(docs: DataFrame, learn: Column, path: str = P.DEFAULT_MODEL) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row of ``docs``: the likeliest language of the whole text and its posterior.

    Learned from rows for which ``learn`` holds and whose text and lang are not
    null. Words are scored whole, however long. ``und`` with score 0 for a null text, one without letters, and where
    nothing could be learned. Of equally likely languages the first by name is
    taken. Repeated rows and null ids are rows like any other; an empty table
    gives an empty table; other columns are left out.
    """
    model = fit(docs.where(learn).where("text is not null and lang is not null").select("text", "lang"), path)
    key = str(hash((path, tuple(model["languages"]), model["probabilities"].tobytes() if model["languages"] else b"")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(model, path)
        found = _SCORERS[key].posterior(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found])],
            names=["doc_id", "lang_pred", "score"])

    return C.map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, lang_pred string, score double")
