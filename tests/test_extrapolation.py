"""The smoothing surface on known surfaces, and extrapolation of stiffness beyond a table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import lut


def grid(n=25):
    x, y = np.meshgrid(np.linspace(0.1, 1, n), np.linspace(0.2, 1, n), indexing="ij")
    return x.ravel(), y.ravel()


def test_a_polynomial_is_met():
    x, y = grid()
    f = lambda x, y: 1 + 2 * x - y + x * y**2 - 3 * x**3 * y
    s = lut.SmoothSurface(x, y, f(x, y))
    assert s.pieces == 1 and s.residual < 1e-5  # the penalty is not nothing
    a, b = np.random.default_rng(1).uniform([0.1, 0.2], 1, (200, 2)).T
    assert np.abs(s(a, b) - f(a, b)).max() < 1e-3
    assert s(np.array([5.0]), np.array([0.5])) == pytest.approx(s(np.array([1.0]), np.array([0.5])))  # the border's value holds


def test_pieces_are_added_for_a_rough_surface():
    x, y = grid(40)
    f = lambda x, y: 30 * np.sin(9 * x) * np.cos(7 * y)
    s = lut.SmoothSurface(x, y, f(x, y), allowed=1.0)
    assert s.pieces > 1 and s.residual <= 1.0
    assert lut.SmoothSurface(x, y, f(x, y)).residual <= len(x)


def test_extrapolation_is_off_by_default(spark):
    x, d = np.meshgrid(np.linspace(50, 200, 16), np.linspace(0.005, 0.15, 16))
    keep = x.ravel() + 1000 * d.ravel() < 300  # a corner is missing
    e = 1 + 0.02 * x.ravel() + 30 * d.ravel() ** 2
    table = lut.Lut(np.column_stack([x.ravel(), d.ravel(), e])[keep])
    df = spark.createDataFrame([(190.0, 0.14), (120.0, 0.08), (260.0, 0.02), (190.0, float("nan"))], "area_um double, deform double")
    plain = [r[0] for r in df.select(lut.emodulus(table, "area_um", "deform", 20, 0.04, 15.0, 0)).collect()]
    assert np.isnan(plain[0]) and not np.isnan(plain[1]) and np.isnan(plain[2])
    with pytest.warns(lut.ExtrapolationWarning):
        more = [r[0] for r in df.select(lut.emodulus(table, "area_um", "deform", 20, 0.04, 15.0, 0, extrapolate=True)).collect()]
    assert more[0] == pytest.approx(1 + 0.02 * 190 + 30 * 0.14**2, rel=0.02) and more[1] == plain[1]
    assert np.isnan(more[2]) and np.isnan(more[3])  # small deformations and missing ones stay without a value
