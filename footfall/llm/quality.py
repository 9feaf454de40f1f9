"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows (``most`` of each class).
Fitted trees are complete binary trees of one depth, flattened into arrays; all
documents of a batch walk all trees at once, one numpy step per level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.common import held_out, table, text_batches
from footfall.llm.labelled import sample, sigmoid

STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "longest_word", "digits",
    "upper", "signs", "dots", "exclaims", "blanks", "high_bytes", "entropy", "distinct_words",
    "top_word", "repeated_next", "distinct_pairs", "log_lines", "distinct_lines", "line_length",
    "short_words", "bars")
_DIGITS, _UPPER = np.arange(48, 58), np.arange(65, 91)
_DOTS, _BLANKS = np.array([44, 46, 58, 59, 63]), np.array([9, 10, 11, 12, 13, 32])
_SIGNS = np.array([c for c in range(33, 127) if not chr(c).isalnum() and c not in _DOTS])


def statistics(text: bytes) -> list[float]:
    """The figures named in STATISTICS; an empty text has zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    bytes_, words, lines = len(text), text.split(), text.splitlines()
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = counts / bytes_
    present = share[share > 0]
    n = len(words)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    lengths = np.fromiter(map(len, words), np.int64, n)
    pairs = ids[1:] * (len(seen) + 1) + ids[:-1]
    return [
        np.log1p(bytes_), np.log1p(n), lengths.mean() if n else 0.0, lengths.std() if n else 0.0,
        np.log1p(lengths.max()) if n else 0.0, share[_DIGITS].sum(), share[_UPPER].sum(),
        share[_SIGNS].sum(), share[_DOTS].sum(), share[33], share[_BLANKS].sum(),
        share[128:].sum(), -(present * np.log(present)).sum(), len(seen) / n if n else 0.0,
        np.bincount(ids).max() / n if n else 0.0,
        (ids[1:] == ids[:-1]).mean() if n > 1 else 0.0,
        len(np.unique(pairs)) / len(pairs) if n > 1 else 1.0, np.log1p(len(lines)),
        len(set(lines)) / max(1, len(lines)), bytes_ / max(1, len(lines)),
        (lengths <= 2).mean() if n else 0.0, share[124]]


@dataclass
class Trees:
    """Complete trees of ``depth`` levels as arrays: a row of each for one tree."""

    depth: int
    prior: float
    feature: np.ndarray    # (trees, 2**depth - 1)
    threshold: np.ndarray  # the same; a value above goes right
    value: np.ndarray      # (trees, 2**depth)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        if not len(self.feature):
            return out
        trees, rows = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        return out + self.value[trees, node - (2 ** self.depth - 1)].sum(axis=1)


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64,
              rate: float = 0.15, ridge: float = 1.0, least_rows: float = 8) -> Trees:
    """Boosts logistic loss with trees split at the borders of histogram bins.

    No rows give score 0.5; one class alone gives its (smoothed) share.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(depth, float(np.log(share / (1 - share))), np.zeros((0, 2 ** depth - 1), int),
                  np.zeros((0, 2 ** depth - 1)), np.zeros((0, 2 ** depth)))
    if len(np.unique(y)) < 2:
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], axis=1)
    score = np.full(len(y), model.prior)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = sigmoid(score)
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(2 ** depth - 1, int), np.full(2 ** depth - 1, np.inf)
        for level in range(depth):
            width, first = 2 ** level, 2 ** level - 1
            best, choice = np.full(width, 1e-6), np.full((width, 2), -1)
            for f in range(x.shape[1]):
                at, size = node * bins + binned[:, f], width * bins
                sums = [np.bincount(at, v, size).reshape(width, bins).cumsum(axis=1)
                        for v in (g, h, np.ones(len(y)))]
                (gl, hl, nl), (gt, ht, nt) = sums, [s[:, -1:] for s in sums]
                gain = (gl ** 2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge)
                        - gt ** 2 / (ht + ridge))
                gain[(nl < least_rows) | (nt - nl < least_rows)] = -np.inf
                gain[:, len(edges[f]):] = -np.inf
                top = gain.argmax(axis=1)
                better = gain[np.arange(width), top] > best
                best[better] = gain[np.arange(width), top][better]
                choice[better] = np.stack([np.full(width, f), top], axis=1)[better]
            for i, (f, b) in enumerate(choice):
                if f >= 0:
                    feature[first + i], threshold[first + i] = f, edges[f][b]
            right = x[np.arange(len(y)), feature[first + node]] > threshold[first + node]
            node = 2 * node + right
        leaves = 2 ** depth
        value = -rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + ridge)
        score += value[node]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(depth, model.prior, np.stack(features), np.stack(thresholds), np.stack(values))


def with_statistics(rows: DataFrame) -> DataFrame:
    """(doc_id, label, statistics) of labelled rows (doc_id, text, label)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2),
                 pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))],
                ["doc_id", "label", "x"])

    return rows.select("doc_id", "text", "label").mapInArrow(
        run, "doc_id long, label int, x array<double>")


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = 10_000) -> Trees:
    """Fits on at most ``most`` labelled rows of each class; see labelled.sample."""
    rows = sorted(with_statistics(sample(docs, labels, "quality", most, 3, 1)).collect())
    x = np.array([r.x for r in rows]).reshape(len(rows), len(STATISTICS))
    return fit_trees(x, np.array([r.label for r in rows], float))


def quality_scores(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out, score and predicted of each row, from its whole text alone.

    Null texts count as empty; empty texts get the score of their (zero) statistics; rows
    alike get equal scores.  Only doc_id and text are read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            x = np.array([statistics(t) for t in texts]).reshape(len(texts), len(STATISTICS))
            score = sigmoid(trees.raw(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, predicted int").select(
        "doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
