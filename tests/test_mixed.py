"""Mixed models against published fits and closed forms, and bootstrapped medians against resampling itself."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import mixed, ranks

# The eight small samples, and results of established fits of the same models to them.
SAMPLES = [
    [100, 99, 80, 120, 140, 150, 100, 100, 110, 111, 140, 145],
    [20, 10, 5, 16, 14, 22, 27, 26, 5, 10, 11, 8, 15, 17, 20, 9],
    [115, 110, 90, 110, 145, 155, 110, 120, 115, 120, 120, 150, 100, 90, 100],
    [30, 30, 15, 26, 24, 32, 37, 36, 15, 20, 21, 18, 25, 27, 30, 19],
    [150, 150, 130, 170, 190, 250, 150, 150, 160, 161, 180, 195, 130, 120, 125, 130, 125],
    [2, 1, 5, 6, 4, 2, 7, 6, 5, 10, 1, 8, 5, 7, 2, 9, 11, 8, 13],
    [155, 155, 135, 175, 195, 255, 155, 155, 165, 165, 185, 200, 135, 125, 130, 135, 140, 150, 135, 140],
    [25, 15, 19, 26, 44, 42, 35, 20, 15, 10, 11, 28, 35, 10, 25, 13],
]
LARGER = {"lmer": 0.000331343267412872, "glmer+loglink": 0.00365675950677214}
LARGER_INTERCEPT = {"glmer+loglink": 15.083832084641697}
DIFFERENTIAL = {"lmer": 0.000602622503360039, "glmer+loglink": 0.000556063024310929}
DIFFERENTIAL_INTERCEPT = {"glmer+loglink": 93.55789706339498}


def frames(spark):
    return [spark.createDataFrame([(float(v),) for v in x], "deform double") for x in SAMPLES]


@pytest.mark.parametrize("model", mixed.MODELS)
def test_published_fits(spark, model):
    groups = ["treatment", "control"] * 4
    df = mixed.design([(d, g, k // 2 + 1, "channel") for k, (d, g) in enumerate(zip(frames(spark), groups))], "deform")
    got = mixed.fit(df, "deform", model)
    assert not got["differential"] and got["converged"] and got["model"] == model
    assert got["p_value"] == pytest.approx(LARGER[model], rel=1e-3)
    if model in LARGER_INTERCEPT:
        assert got["intercept"] == pytest.approx(LARGER_INTERCEPT[model], rel=1e-4)
    for k, (a, t) in got["repetitions"].items():  # shrunk means lie near the samples'
        means = [np.mean(SAMPLES[2 * (k - 1) + 1]), np.mean(SAMPLES[2 * (k - 1)])]
        assert a == pytest.approx(means[0], abs=20) and a + t == pytest.approx(means[1], abs=20)


def test_published_differential_fits(spark):
    """Their draws are of another generator, so results agree as far as draws do."""
    regions = ["channel", "reservoir"] * 4
    df = mixed.design([(d, "control" if k < 4 else "treatment", k % 4 // 2 + 1, r) for k, (d, r) in enumerate(zip(frames(spark), regions))], "deform")
    drawn = mixed.differential(df, "deform").withColumnRenamed("x", "deform").cache()
    for model in mixed.MODELS:
        got = mixed.compare(drawn, "deform", model=model)
        assert math.log(got["p_value"]) == pytest.approx(math.log(DIFFERENTIAL[model]), abs=0.4)
        if model in DIFFERENTIAL_INTERCEPT:
            assert got["intercept"] == pytest.approx(DIFFERENTIAL_INTERCEPT[model], rel=0.01)
    drawn.unpersist()
    assert mixed.fit(df.where("repetition = 1"), "deform", iterations=20)["differential"]


def test_gamma_of_one_mean_a_cell(spark):
    """With random effects of no variance the fit is the cells' means: effects are exact for samples scaled alike."""
    base = np.array([1.0, 2.0, 3.0, 4.5, 7.0])
    rows = [(g, k, float(v * m)) for g, m in (("control", 10), ("treatment", 15)) for k in (1, 2, 3) for v in base]
    got = mixed.compare(spark.createDataFrame(rows, "group string, repetition int, x double"), "x", model="glmer+loglink")
    assert got["intercept"] == pytest.approx(10 * base.mean(), rel=1e-4) and got["treatment"] == pytest.approx(5 * base.mean(), rel=1e-3)


def test_refusals(spark):
    df = spark.createDataFrame([("control", 1, 1.0), ("treatment", 1, -1.0)], "group string, repetition int, x double")
    with pytest.raises(ValueError, match="positive"):
        mixed.compare(df, "x", model="glmer+loglink")
    with pytest.raises(ValueError, match="model"):
        mixed.compare(df, "x", model="other")
    with pytest.raises(ValueError, match="two groups"):
        mixed.compare(df.where("x > 0"), "x")
    one = df.select("x")
    with pytest.raises(ValueError, match="twice"):
        mixed.design([(one, "control", 1, "channel")] * 2, "x")
    with pytest.raises(ValueError, match="region"):
        mixed.design([(one, "control", 1, "outside")], "x")


def test_medians_are_distributed_as_resampled_ones(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BINS", 64)
    rng = np.random.default_rng(4)
    data = {("a", 1): rng.exponential(size=201), ("a", None): rng.integers(0, 12, 300).astype(float), ("b", 2): np.array([5.0]), ("b", 3): np.array([1.0, 2.0])}
    df = spark.createDataFrame([(g, k, float(v)) for (g, k), x in data.items() for v in x] + [("b", 3, float("nan")), ("c", 9, None)], "g string, k int, x double")
    n = 1500
    draws = mixed.median_draws(df, "x", ["g", "k"], n).toPandas()
    assert len(draws) == 4 * n
    for (g, k), x in data.items():
        own = draws[(draws.g == g) & (draws.k.isna() if k is None else draws.k == k)]
        assert sorted(own.draw) == list(range(n))
        brute = np.median(rng.choice(x, (20_000, len(x))), axis=1)
        # the largest gap of two distribution functions, at 1 in 10,000 (Smirnov)
        points = np.unique(np.concatenate([brute, own["median"]]))
        gap = np.abs(np.searchsorted(np.sort(own["median"]), points, side="right") / n - np.searchsorted(np.sort(brute), points, side="right") / 20_000).max()
        assert gap < 2.23 * math.sqrt(1 / n + 1 / 20_000)
    again = mixed.median_draws(df.repartition(7), "x", ["g", "k"], n).toPandas()
    key = ["g", "k", "draw"]
    assert draws.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_differential_needs_both_regions(spark):
    rows = [("control", 1, "channel", 5.0), ("control", 1, "channel", 7.0), ("control", 1, "reservoir", 1.0), ("control", 2, "channel", 5.0)]
    got = mixed.differential(spark.createDataFrame(rows, "group string, repetition int, region string, x double"), "x", 40).toPandas()
    assert set(got.repetition) == {1} and len(got) == 40 and set(got.x) <= {4.0, 5.0, 6.0}
