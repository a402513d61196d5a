"""Whitening against numpy's symmetric eigensolver over the distinct vectors."""

import math

import numpy as np
import pytest

from flowloom.llm.common import read
from flowloom.llm.whitening import Centre, fit_whitening, op12_embedding_whitening, polar_factor, quantise, spectral_components, whiten


def _matrix(values, seed=1):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("values", [[3.0, 1.0], [1.0] * 6, [5, 5, 5, 1, 1], [1e8, 1.0, 1e-8], [7.0, 0, 0, 0, 0], list(np.linspace(1, 2, 64)), [2.0**-k for k in range(40)], [1 + 1e-12 * k for k in range(9)], [4.0], [-3.0, 0.0, 3.0], [0.0] * 5, [1, 1 - 1e-15, 0.5, 0.5 + 1e-15, 0.0]])
def test_components(values):
    v = _matrix(values)
    got, q = spectral_components(v)
    scale = max(np.abs(v).max(), 1e-300)
    assert np.allclose(got, np.sort(np.array(values, float))[::-1], atol=1e-12 * scale * len(values), rtol=0)
    assert np.abs(q.T @ q - np.eye(len(values))).max() < 1e-12
    assert np.abs(v @ q - q * got).max() < 1e-11 * scale * len(values)


def test_polar_factor():
    v = _matrix([5.0, 1e-9, -2.0, -1e-7])
    u = polar_factor(v)
    e, q = np.linalg.eigh(v)
    assert np.abs(u - q @ np.diag(np.sign(e)) @ q.T).max() < 1e-6  # the small ones limit what can be known
    assert np.abs(u.T @ u - np.eye(4)).max() < 1e-12


def brute(rows):
    """Per usable row (key, x), with fit, covariance and eigenpairs by numpy."""
    good = [(k, [math.floor(256.0 * c) + 0 for c in v]) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), float)
    n, s = len(fit), [sum(c) for c in zip(*sorted({tuple(x) for _, x in good}))]
    y = fit - np.array([c / n for c in s])
    e, q = np.linalg.eigh(y.T @ y / n)
    return good, n, s, e[::-1], q[:, ::-1], np.trace(y.T @ y / n)


def check(df, rows, k=4):
    good, n, s, e, q, trace = brute(rows)
    got = df.collect()
    k = min(k, len(s))
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((str(i), c) for i, _ in good for c in range(1, k + 1))
    signs = {}
    by_id = {}
    for i, x in good:
        by_id.setdefault(i, []).append(x)
    for r in got:
        x = by_id[r.vec_id][0] if len(by_id[r.vec_id]) == 1 else None
        assert r.n == n and abs(r.explained - e[r.component - 1] / trace) <= 1e-9
        assert r.identity_error < 1e-9
        if x is None:
            continue
        assert r.deviation == sum((n * a - b) ** 2 for a, b in zip(x, s))
        c = r.component - 1
        w = (np.array(x) - np.array(s) / n) @ q[:, c] / math.sqrt(e[c])
        signs.setdefault(c, np.sign(w * r.whitened) if abs(w) > 1e-6 else None)
        if signs[c] is not None:
            assert abs(r.whitened - signs[c] * w) < 1e-7 * max(1, abs(w))


def test_whole_table(spark):
    vectors = read(spark, "/root/testdata/sf0.01", "embeddings")
    check(op12_embedding_whitening(spark, "/root/testdata/sf0.01"), [(r.vec_id, r.embedding) for r in vectors.collect()])


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.standard_normal(5) * [3, 2, 1, 0.5, 0.2] + 1000).tolist()) for k in range(200)]
    rows += [(500, None), (501, []), (502, [1.0, None, 2.0, 3.0, 4.0]), (503, [1.0, float("nan"), 2.0, 3.0, 4.0]), (504, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (505, [-0.0, 0.001, -0.001, 0.0, 1.0]), (None, rows[7][1])]
    rows += [(600 + k, rows[3][1]) for k in range(300)] + [(9, rows[9][1])]  # a large group of copies counts once
    df = spark.createDataFrame([(i, v, 1.0, "n") for i, v in rows], "vec_id long, embedding array<double>, whitened double, key string").repartition(5)
    check(whiten(df), rows)


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).collect() == []
    assert whiten(spark.createDataFrame([(1, None), (2, [None, 1.0])], schema)).collect() == []
    one = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    two = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, None if r.whitened is None else abs(round(r.whitened, 9))) for r in two) == [(1, 1, 1.0), (1, 2, None), (2, 1, 1.0), (2, 2, None)]
    with pytest.raises(ValueError, match="entries"):
        whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0])], schema))


def test_wide_numbers(spark):
    rows = [(k, [2.0**40 + k, -(2.0**41) - 3 * (k % 5), float(k % 7)]) for k in range(64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whiten(df).collect()
    fit = fit_whitening(quantise(df).select("x"))
    good, n, s, e, q, trace = brute([(k, [c - 2.0**40 * a for c, a in zip(v, (1, -2, 0))]) for k, v in rows])  # shifted by whole numbers: the same covariance
    assert fit.centre.sums == [sum(math.floor(256 * v[j]) for _, v in rows) for j in range(3)]
    assert np.allclose([r.explained for r in got if r.vec_id == 0], e / trace, rtol=1e-9)
    exact = [sum((n * math.floor(256 * c) - t) ** 2 for c, t in zip(v, fit.centre.sums)) for _, v in rows]
    assert [r.deviation for r in sorted(got) if r.component == 1] == exact
    assert Centre(2, [1 << 40, 1]).deviations(np.array([[1 << 62, 0]])) == [None]
