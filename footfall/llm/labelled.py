"""Labelled rows to learn from, and a small logistic fit; shared by the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import held_out


def _known(labels: DataFrame, label: str, modulus: int, remainder: int) -> DataFrame:
    return (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
            .where(~held_out(modulus, remainder))
            .groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label")))


def class_rows(labels: DataFrame, label: str, modulus: int, remainder: int) -> tuple[int, int]:
    """How many documents that may be learnt from have label 0 and 1."""
    return _known(labels, label, modulus, remainder).agg(
        F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()[:]


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, modulus: int,
           remainder: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled rows of each class, never held out.

    Rows are chosen by a hash of their id, so reruns agree.  A document with conflicting
    labels counts as 1; null labels and ids are left out.  The chosen ids, at most
    2 * ``most``, are the only thing broadcast.
    """
    known = _known(labels, label, modulus, remainder)
    order = F.xxhash64("doc_id", F.lit("sample"))
    chosen = [known.where(F.col("label") == kind).orderBy(order, "doc_id").limit(most)
              for kind in (0, 1)]
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .join(F.broadcast(chosen[0].union(chosen[1])), "doc_id"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0,
             steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights (intercept last) of a ridge logistic regression."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    keep = np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + keep * w
        curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(keep + 1e-9)
        w -= (move := np.linalg.solve(curve, slope))
        if np.abs(move).max() < 1e-8:
            break
    return centre, scale, w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
