import zlib

import numpy as np
import pytest

from footfall.llm import quality, toxicity
from tests.llm.rows import TEXTS, awkward


def outcome(spark, sf_dir, frame, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = frame.collect()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    return rows, [(r, labels[r.doc_id]) for r in rows if r.doc_id in labels]


def test_quality_of_held_out_rows(spark, sf_dir):
    rows, known = outcome(spark, sf_dir, quality.op6_quality(spark, sf_dir), "quality")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r.predicted == y for r, y in known if r.held_out]
    assert np.mean(held) >= 0.85


def test_toxicity_of_held_out_rows(spark):
    """Toxic words mark half of the documents; folds and ids must not matter."""
    rng = np.random.default_rng(0)
    words = np.array([f"w{i}" for i in range(300)])
    texts, toxic = [], []
    for i in range(600):
        text = rng.choice(words, 80).tolist()
        toxic.append(i % 3 == 0)
        if toxic[-1]:
            for bad in rng.choice(["Vile!", "nasty", "awful,"], 3):
                text[rng.integers(80)] = bad
        texts.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)],
                                   "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    rows = toxicity.toxicity_scores(docs, model).collect()
    right = [r.predicted == toxic[r.doc_id] for r in rows if r.held_out]
    assert len(right) > 80 and np.mean(right) >= 0.97
    kept = toxicity.clean_rows(docs, labels)
    assert kept.columns == docs.columns and 380 <= kept.count() <= 420


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (None, 1, 1), (9, None, None), (1, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        trees = quality.fit_quality(docs, known)
        assert quality.quality_scores(docs, trees).count() == len(TEXTS)
        model = toxicity.fit_toxicity(docs, known)
        scores = toxicity.toxicity_scores(docs, model).collect()
        assert len(scores) == len(TEXTS) and all(0 <= r.score <= 1 for r in scores)
        assert toxicity.toxicity_scores(docs.limit(0), model).count() == 0
        assert quality.quality_scores(docs.limit(0), trees).count() == 0
    assert toxicity.fit_toxicity(docs.limit(0), labels).weights is None


def test_flattened_trees_equal_walking():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0.2) & (x[:, 1] < 0.5)).astype(float)
    trees = quality.fit_trees(x, y, trees=20, depth=3)

    def walk(row):
        total = trees.prior
        for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value,
                                             strict=True):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + (row[feature[node]] > threshold[node])
            total += value[node - 7]
        return total

    raw = trees.raw(x)
    assert raw == pytest.approx([walk(r) for r in x])
    assert ((raw > 0) == y).mean() > 0.97
    assert trees.raw(x[:0]).shape == (0,)
