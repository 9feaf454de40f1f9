"""Whitening against numpy's own decompositions and plain whole-number sums."""

import math

import numpy as np
import pytest

from footfall.llm.whitening import (
    bidiagonal, leading, op12_whitening, qd_eigenvalues, twisted_vector, whiten)


def test_bidiagonal_keeps_singular_values():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 64):
        r = np.triu(rng.standard_normal((n, n)))
        d, e, rights = bidiagonal(r)
        b = np.diag(d) + np.diag(e, 1)
        v = np.eye(n)
        for i, (x, s) in enumerate(rights):
            v[:, i + 1:] -= s * np.outer(v[:, i + 1:] @ x, x)
        assert np.allclose(v.T @ v, np.eye(n), atol=1e-13)
        assert np.allclose(v @ b.T @ b @ v.T, r.T @ r, atol=1e-11)


def test_qd_values_are_accurate_at_every_size():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 40, 130):
        for kind in range(4):
            d, e = rng.standard_normal(n), rng.standard_normal(n - 1)
            if kind == 1:
                d *= 10.0 ** rng.integers(-8, 8, n)
            if kind == 2:
                e[rng.random(n - 1) < .4] = 0
            if kind == 3:
                d, e = np.ones(n), np.full(n - 1, 1e-9)
            got = qd_eigenvalues(d, e)
            want = np.linalg.svd(np.diag(d) + np.diag(e, 1), compute_uv=False) ** 2
            assert np.allclose(got, want, rtol=1e-11, atol=1e-13 * want[0])
    assert (qd_eigenvalues(np.zeros(3), np.zeros(2)) == 0).all()
    # singular values of a graded matrix to relative accuracy, known from its determinant
    d, e = np.array([1.0, 1e-10, 1e-20]), np.array([1e-5, 1e-15])
    assert math.isclose(math.prod(qd_eigenvalues(d, e)), 1e-60, rel_tol=1e-12)


def test_twisted_vectors():
    rng = np.random.default_rng(3)
    d, e = rng.standard_normal(50), rng.standard_normal(49)
    b = np.diag(d) + np.diag(e, 1)
    for value in qd_eigenvalues(d, e)[:10]:
        z = twisted_vector(d, e, value)
        assert np.linalg.norm(b.T @ b @ z - value * z) < 1e-12 * value


@pytest.mark.parametrize("spectrum", [
    np.arange(20, 0, -1.0), np.array([5.0] * 4 + [3.0] * 4 + [1.0] * 12),
    np.array([4.0, 2.0] + [0.0] * 18), np.array([1.0, 1.0 - 1e-12, 1.0 - 1e-10] + [.5] * 17),
    10.0 ** -np.arange(20)])
def test_leading_vectors(spectrum):
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((20, 20)))
    r = np.linalg.qr(np.diag(spectrum) @ q.T, mode="r")
    values, vectors = leading(r, 8)
    keep = (spectrum ** 2 > 20 * np.finfo(float).eps * spectrum[0] ** 2).sum()
    assert len(values) == min(8, keep)
    assert np.allclose(values, spectrum[:len(values)] ** 2, rtol=1e-10)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-11)
    assert np.abs(r.T @ r @ vectors - vectors * values).max() < 1e-12 * spectrum[0] ** 2


def plain(rows, most=16):
    """(n, deviations, components, shares) from (id, vector) rows by Python's own integers."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in kept:
        far = [n * a - s for a, s in zip(x, sums)]
        w = np.array(far) / n @ vectors[:, :most] / np.sqrt(values[:most])
        out[i] = sum(a * a for a in far), w
    return n, out, values[:most] / values.sum()


def check(got, rows):
    n, want, shares = plain(rows)
    assert len(got) == 16 * len(want) and {r.n for r in got} == {n}
    signs = {}
    for r in got:
        far, w = want[r.vec_id]
        assert r.deviation == far
        assert math.isclose(r.explained, shares[r.component - 1], rel_tol=1e-9)
        assert r.identity_error < 1e-9
        if abs(w[r.component - 1]) > .1:
            signs.setdefault(r.component, np.sign(w[r.component - 1]) * np.sign(r.whitened))
        assert abs(r.whitened - signs.get(r.component, 1) * w[r.component - 1]) < 1e-8 or (
            r.component not in signs)


def test_given_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(op12_whitening(spark, sf_dir).collect(), [tuple(r) for r in rows])


KIND = "vec_id long, embedding array<double>, x string, width int, label int, sums long"


def test_awkward_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal(20) * 10 ** rng.uniform(-1, 3)).tolist()) for i in range(90)]
    rows += [(100 + i, rows[0][1]) for i in range(50)]
    odd = [(200, None), (201, []), (202, [None] * 20), (203, [1.0] * 19 + [None]),
           (204, [float("nan")] * 20), (205, [float("inf")] + [0.0] * 19), (206, [1.0] * 19),
           (207, [1e300] * 20)]
    df = spark.createDataFrame([(i, v, "x", 1, 2, 3) for i, v in rows + odd], KIND)
    check(whiten(df.repartition(7)).collect(), rows)
    assert whiten(df.limit(0)).count() == 0
    assert whiten(df.where("vec_id in (0, 100, 101)")).count() == 0
    two = whiten(df.where("vec_id in (0, 1, 100)")).collect()
    assert sorted((r.vec_id, r.component) for r in two) == [(0, 1), (1, 1), (100, 1)]
    assert {round(abs(r.whitened), 9) for r in two} == {1.0}
    none = spark.createDataFrame([(None, [float(i), 1.0, 0.0]) for i in range(3)], KIND.split(", x")[0])
    assert [r.vec_id for r in whiten(none).collect()] == [None] * 3


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(i * 2 ** 50), float(-i), 3.0]) for i in range(5)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    _, want, _ = plain(rows, 1)
    assert {r.vec_id: int(r.deviation) for r in got} == {i: far for i, (far, _) in want.items()}
