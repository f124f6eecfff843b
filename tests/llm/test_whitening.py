"""FEAST components against a dense eigensolver, whitening against numpy over the distinct list."""

import math

import numpy as np
import pytest

from gaugeframe.llm import whitening


def spectrum(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    m = (q * np.array(values, dtype=float)) @ q.T
    return (m + m.T) / 2


SPECTRA = {
    "spread": np.geomspace(1e6, 1e-3, 40), "flat": np.linspace(10, 11, 64), "equal": np.ones(30), "pairs": np.repeat(np.arange(1, 21.0), 2),
    "low rank": np.r_[np.arange(1, 6.0), np.zeros(20)], "one": np.array([3.0]), "close": np.r_[np.full(14, 5.0) + np.arange(14) * 1e-7, np.arange(1, 20) / 20],
    "zero": np.zeros(5), "tie at the border": np.r_[np.arange(30, 15, -1.0), 4, 4, 4, 1, 1],
}


@pytest.mark.parametrize("name", SPECTRA)
def test_components(name):
    m = spectrum(SPECTRA[name])
    want = np.sort(np.linalg.eigvalsh(m))[::-1]
    positive = int((SPECTRA[name] > 0).sum())
    values, vectors = whitening.components(m)
    k = min(16, positive)
    assert values.shape == (k,) and vectors.shape == (len(m), k)
    top = max(want[0], 1e-300)
    assert np.abs(values - want[:k]).max(initial=0) <= 1e-13 * top * len(m)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max(initial=0) < 1e-13
    assert np.linalg.norm(m @ vectors - vectors * values, axis=0).max(initial=0) <= 1e-13 * top * len(m)


def test_inertia():
    rng = np.random.default_rng(4)
    for d in (1, 2, 7, 33):
        a = rng.standard_normal((d, d))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in (*rng.standard_normal(5) * 3, *(values[:-1] + values[1:]) / 2):
            assert whitening.inertia(a, shift) == (values < shift).sum()
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def test_missed_component_is_an_error():
    with pytest.raises(ArithmeticError):
        whitening.feast(spectrum([1.0, 2.0, 5.0, 9.0]), 4.0, 10.0, 3)


SCHEMA = "vec_id long, embedding array<float>, label int, x string, component string, n string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "a", "b", "c") for i, v in vectors], SCHEMA)


def clean(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def check(df, vectors, d):
    got = {}
    for r in df.collect():
        got.setdefault(r.vec_id, []).append(r)
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in vectors if clean(v) and len(v) == d]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=float)
    n, s = len(fit), [sum(int(v) for v in col) for col in fit.T]
    y = fit - fit.mean(axis=0)
    cov = y.T @ y / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(16, int((values > 1e-12 * values[0]).sum()))
    others = {i for i, v in vectors if clean(v) and len(v) != d}
    assert set(got) == {i for i, _ in kept} | others
    signs = None
    for i, x in kept:
        rows = sorted(got[i], key=lambda r: r.component)[:k]
        assert [r.component for r in rows] == list(range(1, k + 1))
        assert {r.n for r in got[i]} == {n} and {r.deviation for r in got[i]} == {sum((n * a - b) ** 2 for a, b in zip(x, s))}
        want = (np.array(x) - fit.mean(axis=0)) @ axes[:, :k] / np.sqrt(values[:k])
        have = np.array([r.whitened for r in rows])
        if signs is None and np.abs(want).min() > 1e-3:
            signs = np.sign(have * want)
        if signs is not None:
            assert np.abs(have * signs - want).max() < 1e-6
        assert np.allclose([r.explained for r in rows], values[:k] / values.sum(), rtol=1e-9)
        assert all(r.identity_error < 1e-9 for r in rows)
    for i in others:
        assert all(r.deviation is None and r.whitened is None and r.n == n for r in got[i])


def test_op11(spark):
    rng = np.random.default_rng(5)
    scales = np.linspace(3, 0.2, 20)
    vectors = [(i, [float(c) for c in rng.standard_normal(20) * scales]) for i in range(400)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(200)]
    vectors += [(2000, None), (2001, [1.0] * 19 + [None]), (2002, [float("nan")] * 20), (2003, [float("inf")] + [0.0] * 19), (2004, []), (2005, [1.0, 2.0]), (2006, [3.4e38] * 20)]
    check(whitening.op11(frame(spark, vectors)), [v for v in vectors if v[0] != 2006], 20)


def test_op11_few_dimensions_and_constant_ones(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, [float(rng.integers(-5, 5)), 0.5, float(rng.integers(-90, 90))]) for i in range(60)]
    check(whitening.op11(frame(spark, vectors)), vectors, 3)


def test_op11_without_spread(spark):
    for vectors in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None), (2, [])]):
        assert whitening.op11(frame(spark, vectors)).collect() == []


def test_deviation_beyond_a_long_is_null():
    model = whitening.Whitening(1 << 40, (0, 0), np.eye(2), np.ones(2), np.eye(2))
    assert model.deviations(np.array([[1, 1], [10**9, 0]])) == [None, None]
    small = whitening.Whitening(3, (3_000_001, 0), np.eye(2), np.ones(2), np.eye(2))
    assert small.deviations(np.array([[1_000_000, 5], [10**12, 0]])) == [1 + 225, None]
