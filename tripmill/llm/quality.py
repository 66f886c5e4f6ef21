"""Quality of a text by regularised quadratic discriminant analysis over its statistics."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmill.llm import common as C
from tripmill.session import stage

#: What is taken of a text; shares become log odds, counts and lengths logarithms.
STATISTICS = [
    "words", "word_length", "word_length_spread", "upper", "symbols", "exclamation", "bars", "digits", "full_stops",
    "distinct_words", "repeated_neighbours", "commonest_word", "repeated_lines", "short_words", "not_ascii",
]
SHRINK_TO_POOLED = 0.2  # at least; a class of few rows is shrunk more
SHRINK_TO_DIAGONAL = 0.05
FLOOR = 1e-3  # added to variances


#: The usual share of each kind and how many bytes, words or lines a text is lent at that share. Short
#: texts then lie near the usual, and their chance deviations do not look like junk.
USUAL = {
    "upper": (0.03, 60), "symbols": (0.001, 60), "exclamation": (0.001, 60), "bars": (0.001, 60), "digits": (0.002, 60),
    "full_stops": (0.1, 15), "distinct_words": (0.65, 15), "repeated_neighbours": (0.01, 15), "commonest_word": (0.08, 15),
    "repeated_lines": (0.02, 3), "short_words": (0.35, 15), "not_ascii": (0.03, 60),
}
USUAL_LENGTH, USUAL_SPREAD, LENT = 6.0, 3.5, 15


def _share(kind: str, part: float, whole: float) -> float:
    usual, lent = USUAL[kind]
    p = (part + usual * lent) / (whole + lent)
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1.0 - p)))


def statistics(body: bytes) -> list[float]:
    """The transformed statistics of UTF-8 text, of the whole of it; an empty text has defined ones too."""
    words = body.split()
    n, size = len(words), len(body)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [x for x in body.split(b"\n") if x.strip()]
    codes = np.bincount(np.frombuffer(body, np.uint8), minlength=256) if size else np.zeros(256, np.int64)
    upper, lower = codes[65:91].sum(), codes[97:123].sum()
    symbols = sum(codes[c] for c in b"#$%&*@^~<>=_+\\{}[]")
    mean = (lengths.sum() + USUAL_LENGTH * LENT) / (n + LENT)
    spread = (((lengths - mean) ** 2).sum() + USUAL_SPREAD**2 * LENT) / (n + LENT)
    shares = {
        "upper": (upper, upper + lower), "symbols": (symbols, size), "exclamation": (codes[33], size),
        "bars": (codes[124], size), "digits": (codes[48:58].sum(), size), "full_stops": (codes[46], n),
        "distinct_words": (len(counts), n),
        "repeated_neighbours": (sum(a == b for a, b in zip(words, words[1:])), n),
        "commonest_word": (max(counts.values(), default=0), n),
        "repeated_lines": (len(lines) - len(set(lines)), len(lines)),
        "short_words": (int((lengths <= 3).sum()), n), "not_ascii": (codes[128:].sum(), size),
    }
    return [float(np.log1p(n)), float(np.log(mean)), float(np.log(spread)), *(_share(k, *shares[k]) for k in USUAL)]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, x (array of double)`` for each row of ``docs``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [statistics(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("th"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "th", "x"])

    texts = docs.select("doc_id", F.hash("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    return C.map_batches(texts, run, "doc_id bigint, th int, x array<double>")


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, mean and covariance of ``x`` per ``label`` 0 and 1: partial sums in each task, a few hundred numbers to the driver."""
    d = len(STATISTICS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array(batch.column("x").to_pylist(), float).reshape(-1, d)
        y = batch.column("label").to_numpy()
        full = np.concatenate((np.ones((len(x), 1)), x), axis=1)
        parts = [(label, (full[y == label].T @ full[y == label]).ravel()) for label in (0, 1)]
        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat([p[0] for p in parts], (d + 1) ** 2), pa.int32()),
            pa.array(np.tile(np.arange((d + 1) ** 2), 2), pa.int32()),
            pa.array(np.concatenate([p[1] for p in parts]))], names=["label", "place", "value"])

    sums = C.map_batches(labelled.select("label", "x"), run, "label int, place int, value double")
    found = {0: np.zeros((d + 1) ** 2), 1: np.zeros((d + 1) ** 2)}
    for row in sums.groupBy("label", "place").agg(F.sum("value").alias("value")).collect():
        found[row["label"]][row["place"]] = row["value"]
    out = {}
    for label, flat in found.items():
        m = flat.reshape(d + 1, d + 1)
        if m[0, 0] > 0:
            mean = m[0, 1:] / m[0, 0]
            out[label] = (m[0, 0], mean, m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
    return out


def fit(labelled: DataFrame) -> dict:
    """Prior log odds, and per class mean, inverse Cholesky factor of the shrunk covariance and half its log determinant.

    Each covariance is shrunk to the pooled one and then to its own diagonal.
    With fewer than two rows of a class only the prior is left.
    """
    found = moments(labelled)
    counts = {label: found[label][0] if label in found else 0.0 for label in (0, 1)}
    model: dict = {"prior": float(np.log((counts[1] + 1) / (counts[0] + 1))), "classes": {}}
    if min(counts.values()) < 2:
        return model
    pooled = sum(n * cov for n, _, cov in found.values()) / sum(counts.values())
    for label, (n, mean, cov) in found.items():
        weight = max(SHRINK_TO_POOLED, len(mean) / (len(mean) + n))
        cov = (1 - weight) * cov + weight * pooled
        cov = (1 - SHRINK_TO_DIAGONAL) * cov + SHRINK_TO_DIAGONAL * np.diag(np.diag(cov)) + FLOOR * np.eye(len(mean))
        factor = np.linalg.cholesky(cov)
        model["classes"][label] = (mean, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()))
    return model


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    """Log odds of label 1: half the difference of the squared Mahalanobis distances, of the determinants, and the prior."""
    odds = np.full(len(x), model["prior"])
    for label, (mean, inverse, half) in model["classes"].items():
        distance = (((x - mean) @ inverse.T) ** 2).sum(axis=1)
        odds += (1 if label == 1 else -1) * (-0.5 * distance - half)
    return odds


def scores(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.3) -> DataFrame:
    """``doc_id, th, score, predicted`` for each row of ``docs``; ``th`` is a hash of the text.

    ``labels`` has ``doc_id, quality``; rows for which ``learn`` holds are
    learned from, all of them. Other labels than 0 and 1, and labels of unknown
    ids, are not used; a repeated label counts each time. A null text counts as
    empty. Without two labelled rows of each class the score is the share of
    label 1 (with one row of each class added), one half if there is none. An empty table gives an empty table.
    """
    rows = stage(with_statistics(docs), "statistics")
    known = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("label"))
    model = fit(rows.where(learn).join(known, "doc_id"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
        score = 1.0 / (1.0 + np.exp(-np.clip(log_odds(model, x), -700, 700)))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("th"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
            names=["doc_id", "th", "score", "predicted"])

    return C.map_batches(rows, run, "doc_id bigint, th int, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, all columns kept; repeated rows share their score."""
    good = scores(docs, labels, learn, threshold).where("predicted = 1").select(
        F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    return C.match_rows(docs, good, "left_semi")
