"""Multi-rank selection and exact kernel densities against numpy over all rows."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowloom.operators import kernel_sums, ranks, stats

QS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def groups(seed=3):
    rng = np.random.default_rng(seed)
    out = {
        ("a", 1): rng.standard_normal(4000),
        ("a", None): rng.lognormal(0, 40, 3000),  # many orders of magnitude
        (None, 2): np.repeat([3.0, -1.0, 3.5], [2000, 1, 5]),  # ties
        ("b", 2): -rng.lognormal(0, 60, 2500),
        ("c", 2): np.concatenate([rng.lognormal(0, 50, 900), -rng.lognormal(0, 50, 900), [0.0] * 50, [1e308, -1e308]]),
        ("d", 1): np.nextafter(1.0, 2.0) ** np.arange(4.0) * np.ones(4),
        ("e", 1): np.array([7.0]),
        ("f", 1): np.concatenate([np.full(3000, 5.0), [5.0 + 1e-15 * 8]]),
    }
    return out


def table(spark, data):
    return spark.createDataFrame([(g, k, float(x)) for (g, k), v in data.items() for x in v], "g string, k int, x double").repartition(5)


@pytest.mark.parametrize("small,sent", [(60, 3), (1 << 20, 1 << 16)])
def test_quantiles_of_many_groups(spark, monkeypatch, small, sent):
    monkeypatch.setattr(ranks, "SENT", sent)
    monkeypatch.setattr(ranks, "BINS", 1024)
    data = groups()
    got = {(r.g, r.k): r.q for r in ranks.quantiles(table(spark, data), ["g", "k"], QS, small).collect()}
    assert set(got) == set(data)
    for key, x in data.items():
        assert got[key] == pytest.approx(np.quantile(x, QS), rel=1e-12)


def test_all_ranks(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BINS", 64)
    data = {("a", 1): np.random.default_rng(1).standard_normal(500), ("b", None): np.random.default_rng(2).integers(0, 9, 400).astype(float)}
    values = table(spark, data)
    wanted = values.groupBy("g", "k").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("rows"), F.sequence(F.lit(0), F.count("*") - 1).alias("ranks"))
    got = {}
    for r in ranks.select_ranks(values, ["g", "k"], wanted, small=30).collect():
        got.setdefault((r.g, r.k), {})[r["rank"]] = r.x
    for key, x in data.items():
        assert [got[key][i] for i in range(len(x))] == sorted(x)


def test_no_groups_and_no_rows(spark):
    x = np.random.default_rng(5).exponential(size=3000)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    assert ranks.quantiles(df, [], QS, 100).first().q == pytest.approx(np.quantile(x, QS))
    assert ranks.quantiles(df.where("x < 0"), [], QS).collect() == []
    assert ranks.quantiles(df.where("x < 0").withColumn("g", F.lit(1)), ["g"], QS).collect() == []


def test_describe_beyond_the_bound(spark):
    data = groups()
    df = table(spark, data).withColumn("y", F.when(F.col("k") == 2, F.lit(float("nan"))).otherwise(-F.col("x")))
    for by in (["g"],):
        one = stats.describe(df, ["x", "y", "none"], by=by).collect()
        many = stats.describe(df, ["x", "y", "none"], by=by, exact_rows=5000).collect()
        key = lambda r: str(r[:-1])
        for a, b in zip(sorted(one, key=key), sorted(many, key=key), strict=True):
            assert a[:-1] == b[:-1] and b.value == pytest.approx(a.value, rel=1e-9, nan_ok=True)
    assert stats.mode(df, "x").first() == stats.mode(df, "x", exact_rows=5000).first()


def full_sums(points, targets, white):
    u, t = points @ white.T, targets @ white.T
    return np.array([np.exp(-0.5 * ((p - u) ** 2).sum(1)).sum() for p in t])


@pytest.mark.parametrize("kind", ["gauss", "multivariate"])
def test_density_at_events(spark, kind, monkeypatch):
    monkeypatch.setattr(kernel_sums, "ROWS", 150)  # crowded tiles are salted
    rng = np.random.default_rng(8)
    p = np.concatenate([rng.multivariate_normal([5, 900], [[1, 30], [30, 2000]], 700), [[60.0, -4000.0]], np.tile([4.0, 880.0], (300, 1))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)] + [(9000, float("nan"), 1.0), (9001, 1.0, None), (5, float(p[5, 0]), float(p[5, 1]))], "event_idx long, x double, y double").repartition(4)
    p = np.concatenate([p, p[5:6]])
    good = df.where("event_idx < 9000").select("x", "y")
    white, _, n, norm = kernel_sums.kernel(good, kind)
    assert n == len(p)
    want = full_sums(p, p, white) * norm
    got = sorted(tuple(r) for r in kernel_sums.density_exact(df, "x", "y", kind).collect())
    assert [r[0] for r in got] == sorted([*range(1001), 5, 9000, 9001])
    by_id = dict(enumerate(want[:1001]))
    assert max(abs(v / by_id[i] - 1) for i, v in got if i < 9000) < 1e-6
    assert all(np.isnan(v) for i, v in got if i >= 9000)
    at = np.array([[5.0, 900.0], [30.0, -1000.0], [1e6, 0.0], [60.0, -4000.0]])
    where = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(at)] + [(7, float("inf"), 0.0)], "event_idx long, x double, y double")
    there = {r[0]: r[1] for r in kernel_sums.density_exact(df, "x", "y", kind, positions=where).collect()}
    assert np.isnan(there.pop(7))
    assert np.abs(np.array([there[i] for i in range(4)]) - full_sums(p, at, white) * norm).max() < 1e-6 * norm


def test_density_of_too_little(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 3.0)], "event_idx long, x double, y double")
    assert all(np.isnan(r.density) for r in kernel_sums.density_exact(df, "x", "y").collect())
    assert kernel_sums.density_exact(df.where("x < 0"), "x", "y").collect() == []
    with pytest.raises(ValueError, match="kernel"):
        kernel_sums.density_exact(df, "x", "y", "round")


@pytest.mark.parametrize("n,tol", [(10, 1e-6), (10**6, 1e-6), (10**9, 1e-6), (1000, 1e-3)])
def test_error_bound_of_one_kernel(n, tol):
    """The translated moments of one source, at worst offsets, are within what each event may be off by."""
    o = kernel_sums.orders(n, tol)
    t = kernel_sums.translation(o).reshape(kernel_sums.TILE, o.p, kernel_sums.TILE + 2 * o.reach, o.p)
    h, worst = kernel_sums.STEP, 0.0
    for cell in range(t.shape[2]):
        for a in (-h / 2, 0.1, h / 2):
            for b in (-h / 2, -0.2, h / 2):
                d = -(cell - o.reach) * h  # from the source's centre to that of the first target cell
                got = kernel_sums._powers(np.array([a]), o.p)[0] @ t[0, :, cell, :] @ kernel_sums._powers(np.array([b]), o.p)[0]
                worst = max(worst, abs(got - np.exp(-((d + a - b) ** 2) / 2)))
    assert worst <= tol / n + 1e-15


def test_density_of_sparse_events_sends_little(spark):
    """Where cells hold few events, events travel, not the moments of cells, to few tiles around."""

    def written():
        time.sleep(0.5)  # the store of figures lags behind
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    rng = np.random.default_rng(2)
    p = np.column_stack([rng.uniform(0, 50, 3000), rng.uniform(0, 2000, 3000)])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "event_idx long, x double, y double")
    before = written()
    got = dict(map(tuple, kernel_sums.density_exact(df, "x", "y", "multivariate", bandwidth=(2.0, 2.0)).collect()))
    assert written() - before < 3000 * 500
    want = full_sums(p, p, np.eye(2) / 2) / (3000 * 8 * np.pi)
    assert np.abs(np.array([got[i] for i in range(3000)]) / want - 1).max() < 1e-6
