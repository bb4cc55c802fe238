"""Whitening against a dense eigen-solver and exact integer arithmetic."""

import math

import numpy as np
import pytest

from pharmlake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, component int, n int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "a", 9, 9) for i, v in vectors], SCHEMA)


def check(rows, vectors, components=4):
    """Compares with numpy: returns the columns' common values."""
    kept = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in kept}
    distinct = sorted(set(map(tuple, x.values())))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    v = np.cov(np.array(distinct, float).T, bias=True).reshape(len(sums), -1)
    values, vectors_ = np.linalg.eigh(v)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    assert len(rows) == len(kept) * min(components, len(sums))
    for r in rows:
        k = r.component - 1
        assert r.n == n
        assert r.deviation == sum((n * c - s) ** 2 for c, s in zip(x[r.vec_id], sums)) == int(r.deviation_exact)
        assert r.explained == pytest.approx(values[k] / np.trace(v), rel=1e-9)
        assert r.identity_error < 1e-9
        exact = (np.array(x[r.vec_id]) - np.array(sums) / n) @ vectors_[:, k] / math.sqrt(values[k])
        assert abs(r.whitened) == pytest.approx(abs(exact), abs=1e-8)


def test_against_dense_solver(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(c) for c in rng.normal(size=12) * np.arange(1, 13) / 9]) for i in range(300)]
    vectors += [(7, vectors[7][1]), (900, vectors[3][1]), (901, None), (902, []), (903, [float("nan")] + [0.0] * 11),
                (904, [float("inf")] * 12), (905, [None] + [1.0] * 11), (906, [-0.0] * 12)]
    check(whitening.whiten(frame(spark, vectors)).collect(), vectors)


def test_fewer_dimensions_than_components(spark):
    vectors = [(i, [float(i % 5), float(i % 3)]) for i in range(15)]
    check(whitening.whiten(frame(spark, vectors)).collect(), vectors)


def test_lengths_rank_and_empty(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    rows = whitening.whiten(frame(spark, [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 2.0, 3.0]), (None, [1.0, 0.0])])).collect()
    assert sorted((r.vec_id or 0, r.component) for r in rows) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 2)]
    assert {r.explained for r in rows if r.component == 1} == {1.0}
    assert all(r.whitened is None for r in rows if r.component == 2)
    one = whitening.whiten(frame(spark, [(1, [1.0, 5.0]), (1, [1.0, 5.0])])).collect()
    assert len(one) == 4 and {(r.n, r.deviation, r.whitened, r.explained) for r in one} == {(1, 0, None, None)}


def test_deviation_beyond_a_long(spark):
    rows = whitening.whiten(frame(spark, [(1, [3e12, 0.0]), (2, [-3e12, 1.0]), (3, [0.0, 3.0])])).collect()
    x = {1: [math.floor(256 * float(np.float32(3e12))), 0], 2: [math.floor(-256 * float(np.float32(3e12))), 256], 3: [0, 768]}
    sums = [sum(c) for c in zip(*x.values())]
    for r in rows:
        want = sum((3 * c - s) ** 2 for c, s in zip(x[r.vec_id], sums))
        assert int(r.deviation_exact) == want and r.deviation == (want if want < 2 ** 63 else None)


@pytest.mark.parametrize("spectrum", [[5, 4, 3, 2, 1], [2, 2, 2, 2, 1], [1, 1, 1, 1, 1, 1], [9, 9, 1e-3, 1e-9, 0, 0],
                                      [1, 1 - 1e-13, 1 - 2e-13, 0.5], [3.0], [0.0, 0.0]])
def test_slicing_numbers_and_equal_eigenvalues(spectrum):
    d = len(spectrum)
    q, _ = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))
    v = q @ np.diag(spectrum) @ q.T
    v = (v + v.T) / 2
    values, vectors = whitening.Slicer(v).leading(4)
    k = min(4, d)
    assert np.allclose(values, sorted(spectrum, reverse=True)[:k], atol=1e-12)
    assert np.allclose(vectors @ vectors.T, np.eye(k), atol=1e-10)
    assert np.allclose(v @ vectors.T, vectors.T * values, atol=1e-10)


def test_inertia_counts():
    rng = np.random.default_rng(3)
    for d in (1, 2, 3, 7, 20):
        for _ in range(10):
            a = rng.normal(size=(d, d)) * (rng.random((d, d)) < 0.6)
            a = a + a.T + (0 if d % 2 else np.diag(np.zeros(d)))
            values = np.linalg.eigvalsh(a)
            if np.abs(values).min() > 1e-9:
                assert whitening.negative_pivots(a) == (values < 0).sum()
