"""Queries of derived features, viscosity, pixelation, scaling and look-up tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from flowloom.functions import physics as P
from flowloom.operators import lut as L
from flowloom.plans.registry import query, table


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / 100.0, 6) AS time, round(CASE WHEN l_discount <> 0 THEN l_tax / l_discount END, 6) AS aspect, round(l_quantity * 0.34 * 0.34, 6) AS area_um, round(1 - l_discount, 6) AS deform FROM lineitem")
def derived_basic(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").withColumns({"frame": F.col("l_quantity"), "size_x": F.col("l_tax"), "size_y": F.col("l_discount"), "area_cvx": F.col("l_quantity"), "circ": F.col("l_discount")})
    config = {"frame rate": 100, "pixel size": 0.34}
    value = {n: F.round(F.nanvl(P.derived(n, config), F.lit(None)), 6).alias(n) for n in ("time", "aspect", "area_um", "deform")}
    return x.select("l_orderkey", "l_linenumber", *value.values())


_CT = {"12": 0.1, "13": 0.02, "21": 0.2, "23": 0.05, "31": 0.01, "32": 0.15}
_INV = P.compensation_matrix(_CT)


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({' + '.join(f'({float(_INV[i, j])!r}::DOUBLE) * {c}' for i, c in enumerate(('l_quantity', 'l_discount', 'l_tax')))}, 5) AS fl{j + 1}_max_ctc" for j in range(3)) + " FROM lineitem")
def crosstalk3(spark, sf_dir):
    ch = {1: F.col("l_quantity"), 2: F.col("l_discount"), 3: F.col("l_tax")}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(P.compensated(ch, _CT, j), 5).alias(f"fl{j}_max_ctc") for j in (1, 2, 3)])


@query("SELECT ml_class, count(*) AS n FROM (SELECT CASE WHEN greatest(a, b, c) <= 0 THEN -1 WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS ml_class FROM (SELECT l_discount AS a, l_tax AS b, CASE WHEN l_linenumber = 2 THEN 0.0 ELSE 0.05 END AS c FROM lineitem)) GROUP BY ml_class")
def ml_class(spark, sf_dir):
    c = F.when(F.col("l_linenumber") == 2, F.lit(float("nan"))).otherwise(0.05)
    scored = table(spark, sf_dir, "lineitem").select(P.ml_class({"ml_score_aaa": F.col("l_discount"), "ml_score_bbb": F.col("l_tax"), "ml_score_ccc": c}).alias("ml_class"))
    return scored.groupBy("ml_class").agg(F.count("*").alias("n"))


_T = "(22.0 + l_linenumber)"
_N22 = f"(0.00223 * ({_T} + 273.15) - 0.0056)"


@query(f"SELECT l_linenumber, round(any_value(2.30e-6 * exp(3379.7 / ({_T} + 273.15)) * pow(8 * 0.16 / pow(20e-3, 3) * (0.6671 + 0.2121 / {_N22}), {_N22} - 1) * 1e3), 6) AS new, round(any_value(0.179 * pow(1.1856 * 6 * 0.16 * 1e-9 / pow(20e-6, 3) * 2 / 3 * (0.6771 / 0.5928 + 0.2121 / (0.5928 * 0.677)), 0.677 - 1) * pow({_T} / 23.2, -0.866) * 1e3), 6) AS old, round(any_value(1.002 * pow(10, (20 - {_T}) / ({_T} + 96) * (1.2364 - 1.37e-3 * (20 - {_T}) + 5.7e-6 * pow(20 - {_T}, 2)))), 6) AS water FROM lineitem GROUP BY l_linenumber")
def viscosity_models(spark, sf_dir):
    t = F.lit(22.0) + F.col("l_linenumber")
    x = table(spark, sf_dir, "lineitem").select("l_linenumber").distinct()
    return x.select("l_linenumber", F.round(P.viscosity("0.49% MC-PBS", t), 6).alias("new"), F.round(P.viscosity("0.5% MC-PBS", t, model="herold-2017"), 6).alias("old"), F.round(P.viscosity("water", t), 6).alias("water"))


@query("SELECT l_orderkey, l_linenumber, round(0.0012 + 0.020 * exp(-l_quantity / 7.1) + 0.010 * exp(-l_quantity / 38.6) + 0.005 * exp(-l_quantity / 296), 7) AS by_area, round(-(0.0013 + 0.0172 * exp(-l_quantity * 8 / 40) + 0.0070 * exp(-l_quantity * 8 / 450) + 0.0032 * exp(-l_quantity * 8 / 6040)), 7) AS by_volume FROM lineitem")
def pixelation_delta(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(P.pixelation_delta("area_um", column=q), 7).alias("by_area"), F.round(P.pixelation_delta("volume", "circ", 0.17, q), 7).alias("by_volume"))


@query("SELECT p_partkey, round(p_retailprice * 0.5625, 6) AS area, round(p_retailprice * 0.421875, 6) AS volume, round(p_retailprice * (0.12 / 0.04) * (5.5 / 15) / 0.421875, 3) AS emodulus FROM part")
def scale_features(spark, sf_dir):
    p = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(P.scale_feature("area_um", p, 20, 15), 6).alias("area"), F.round(P.scale_feature("volume", p, 20, 15), 6).alias("volume"), F.round(P.scale_feature("emodulus", p, 20, 15, 0.04, 0.12, 15, 5.5), 3).alias("emodulus"))


def synthetic_lut() -> L.Lut:
    """A small table on a smooth surface; its x runs over l_quantity, its deformation over l_discount."""
    rng = np.random.RandomState(3)
    x = rng.uniform(5, 45, 24)
    d = rng.uniform(0.01, 0.09, 24)
    return L.Lut(np.column_stack([x, d, 1 + x / 40 + 30 * d * d + x * d]), identifier="synthetic")


def _lut_sql() -> str:
    lut = synthetic_lut()
    xy, values, top_x, top_d = L.normalised(lut)
    rows = ", ".join("(" + ", ".join(repr(float(v)) + "::DOUBLE" for v in [*xy[t].ravel(), *values[t]]) + ")" for t in L.triangulate(xy))
    u, v = f"l_quantity * {(20 / 30) ** 2!r} / {top_x!r}::DOUBLE", f"l_discount / {top_d!r}::DOUBLE"
    scale = (0.16 / 0.04) * (5.0 / 15.0) * (20 / 30) ** 3
    bary = "((y2 - y3) * (x1 - x3) + (x3 - x2) * (y1 - y3))"
    return f"""WITH t(x1, y1, x2, y2, x3, y3, fa, fb, fc) AS (VALUES {rows}),
e AS (SELECT row_number() OVER () AS r, l_orderkey, l_quantity, l_discount, {u} AS x, {v} AS y FROM lineitem),
h AS (SELECT r, ((y2 - y3) * (x - x3) + (x3 - x2) * (y - y3)) / {bary} AS p, ((y3 - y1) * (x - x3) + (x1 - x3) * (y - y3)) / {bary} AS q, fa, fb, fc FROM e, t),
i AS (SELECT r, max(p * fa + q * fb + (1 - p - q) * fc) AS f FROM h WHERE p >= -1e-12 AND q >= -1e-12 AND 1 - p - q >= -1e-12 GROUP BY r)
SELECT l_orderkey, l_quantity, l_discount, round(f * {scale!r}, 5) AS emodulus FROM e LEFT JOIN i USING (r)"""


@query(_lut_sql())
def emodulus_lut(spark, sf_dir):
    events = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount")
    value = L.emodulus(synthetic_lut(), "l_quantity", "l_discount", 30.0, 0.16, 5.0, pixel_um=0)
    return events.withColumn("emodulus", value).withColumn("emodulus", F.round(F.nanvl("emodulus", F.lit(None)), 5))


@query("SELECT round(x * 0.5625, 6) AS x, round(deform + 0.0012 + 0.020 * exp(-x * 0.5625 / 7.1) + 0.010 * exp(-x * 0.5625 / 38.6) + 0.005 * exp(-x * 0.5625 / 296), 6) AS deform, round(e * (1 / 0.421875), 6) AS emodulus FROM (SELECT DISTINCT l_quantity AS x, l_discount AS deform, l_linenumber::DOUBLE AS e FROM lineitem)")
def isoelastics_convert(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("deform"), F.col("l_linenumber").cast("double").alias("emodulus")).distinct()
    out = L.convert_isoelastics(points, width_in=20, width_out=15, pixel_um=0.34)
    return out.select(*[F.round(c, 6).alias(c) for c in ("x", "deform", "emodulus")])
