"""Whitening against plain NumPy."""

import numpy as np
import pytest

from tidewheel.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, x string, n int, component int, i int"


def frame(spark, vectors):
    rows = [(i, v, "x", 0, 0, 0) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain(vectors, k=4):
    """Exact deviations, whitened values up to their signs, shares."""
    x = np.floor(256 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    z = fit - sums / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviations = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, deviations, (x - sums / n) @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check(spark, vectors, odd=(), k=4):
    found = whitening.whitened_vectors(frame(spark, [*vectors, *odd])).collect()
    n, deviations, whitened, shares = plain(vectors, k)
    assert len(found) == len(vectors) * k
    got = np.zeros_like(whitened)
    for r in found:
        assert r.n == n and r.deviation == deviations[r.vec_id]
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9
        got[r.vec_id, r.component - 1] = r.whitened
    signs = np.sign((got * whitened).sum(axis=0))
    assert np.abs(got * signs - whitened).max() < 1e-8


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 12)) * np.linspace(3, 0.5, 12) + 5
    return [list(map(float, v)) for v in [*base, *[base[0]] * 150, *[base[1]] * 30]]


def test_equals_plain_with_unusable_rows(spark, vectors):
    odd = [None, [], [None] * 12, [1.0] * 11, [1.0] * 13, [float("nan")] * 12]
    odd += [[float("inf")] + [0.0] * 11, [0.0] * 11 + [float("-inf")]]
    check(spark, vectors, odd)


def test_sum_beyond_64_bits_stays_exact(spark):
    rng = np.random.default_rng(2)
    big = [list(map(float, v)) for v in rng.standard_normal((40, 3)) * 1e14]
    found = whitening.whitened_vectors(frame(spark, big)).collect()
    assert len(found) == 120 and all(r.deviation is None for r in found)
    near = [[float(3 + i % 2), 0.5, float(i)] for i in range(9)]
    check(spark, near, k=2)


def test_no_rows_one_row_no_variance(spark):
    for vectors in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, []]):
        result = whitening.whitened_vectors(frame(spark, vectors))
        assert result.collect() == []
        assert result.columns[:3] == ["vec_id", "component", "n"]


def test_few_dimensions(spark):
    check(spark, [[1.0], [2.0], [5.0]], k=1)
    check(spark, [[1.0, 7.0], [2.0, 1.0], [5.0, 0.0]], k=2)


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_spectrum(d):
    rng = np.random.default_rng(d)
    root = rng.standard_normal((2 * d, d)) * np.logspace(0, -4, d)
    a = root.T @ root
    values, vectors = whitening.spectrum(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=0, atol=1e-13 * values[0])
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * values[0]


@pytest.mark.parametrize("diagonal", [[0, 0, 0], [3, 3, 3], [2, 2, 1, 1, 1], [5, 5, 5, 0], [1, 1e-20]])
def test_spectrum_of_ties(diagonal):
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((len(diagonal),) * 2))
    a = (q * np.array(diagonal, float)) @ q.T
    values, vectors = whitening.spectrum((a + a.T) / 2)
    assert np.allclose(values, sorted(diagonal, reverse=True), atol=1e-14)
    assert np.abs(vectors.T @ vectors - np.eye(len(diagonal))).max() < 1e-13


def test_polar_factor():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    u = whitening.polar(a)
    assert np.abs(u @ u - np.eye(30)).max() < 1e-13
    assert np.abs(u @ a - a @ u).max() < 1e-11
    assert np.linalg.eigvalsh(u @ a).min() > 0
