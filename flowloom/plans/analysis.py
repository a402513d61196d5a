"""Queries of densities and of mixed-effects comparisons."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from flowloom.operators import density as D
from flowloom.operators import kernel_sums as K
from flowloom.operators import mixed as M
from flowloom.plans.registry import query, table

_H = (0.0, 50.0, 0.0, 0.1)


@query("SELECT least(floor(l_quantity / (50.0 / 20)), 19)::INTEGER AS bx, least(floor(l_tax / (0.1 / 10)), 9)::INTEGER AS by, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND l_tax BETWEEN 0 AND 0.1 GROUP BY 1, 2")
def hist2d(spark, sf_dir):
    return D.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", "l_tax", (20, 10), _H)


def _nodes():
    return np.linspace(0, 50, 6), np.linspace(0, 0.1, 5)


def _sums_sql(a: float, b: float, norm: str) -> str:
    xs, ys = _nodes()
    nodes = ", ".join(f"({i}, {j}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for i, x in enumerate(xs.tolist()) for j, y in enumerate(ys.tolist()))
    return f"SELECT ix, iy, round(sum(exp(-0.5 * (pow(gx - l_quantity, 2) / {a} + pow(gy - l_tax, 2) / {b}))) * {norm}, 6) AS density FROM lineitem, (VALUES {nodes}) g(ix, iy, gx, gy) GROUP BY ix, iy"


@query(_sums_sql(9.0, 0.0001, "1 / (count(*) * 2 * pi() * 3.0 * 0.01)"))
def kde_multivariate_grid(spark, sf_dir):
    out = D.multivariate(table(spark, sf_dir, "lineitem"), "l_quantity", "l_tax", *_nodes(), bandwidth=(3.0, 0.01))
    return out.withColumn("density", F.round("density", 6))


def _gauss_sql() -> str:
    xs, ys = _nodes()
    nodes = ", ".join(f"({i}, {j}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for i, x in enumerate(xs.tolist()) for j, y in enumerate(ys.tolist()))
    return f"""WITH c AS (SELECT count(*)::DOUBLE AS n, var_samp(l_quantity) * pow(count(*), -1.0/3) AS a, covar_samp(l_quantity, l_tax) * pow(count(*), -1.0/3) AS b, var_samp(l_tax) * pow(count(*), -1.0/3) AS d FROM lineitem)
SELECT ix, iy, round(sum(exp(-0.5 * (d * pow(gx - l_quantity, 2) - 2 * b * (gx - l_quantity) * (gy - l_tax) + a * pow(gy - l_tax, 2)) / (a * d - b * b))) / any_value(n * 2 * pi() * sqrt(a * d - b * b)), 6) AS density
FROM lineitem, c, (VALUES {nodes}) g(ix, iy, gx, gy) GROUP BY ix, iy"""


@query(_gauss_sql())
def kde_gauss_grid(spark, sf_dir):
    return D.gauss(table(spark, sf_dir, "lineitem"), "l_quantity", "l_tax", *_nodes()).withColumn("density", F.round("density", 6))


def _raster() -> D.Raster:
    xs, ys = np.linspace(5, 45, 9), np.linspace(0.01, 0.07, 4)
    return D.Raster(xs, ys, np.add.outer(np.sin(xs / 9) + 1, ys * 10))


def _lookup_sql() -> str:
    r = _raster()
    nodes = ", ".join(f"({i}, {j}, {float(r.z[i, j])!r}::DOUBLE)" for i in range(len(r.xs)) for j in range(len(r.ys)))
    return f"""n(i, j, z) AS (VALUES {nodes}),
p AS (SELECT l_orderkey, l_quantity, l_tax, least(floor((l_quantity - 5) / 5.0), 7)::INTEGER AS i, least(greatest(floor((l_tax - 0.01) / 0.02 + 1e-9), 0), 2)::INTEGER AS j FROM lineitem WHERE l_quantity BETWEEN 5 AND 45 AND l_tax BETWEEN 0.01 AND 0.07),
q AS (SELECT l_orderkey, l_quantity, l_tax, (l_quantity - 5) / 5.0 - i AS u, (l_tax - 0.01) / 0.02 - j AS v, a.z AS za, b.z AS zb, c.z AS zc, d.z AS zd FROM p JOIN n a USING (i, j) JOIN n b ON b.i = p.i + 1 AND b.j = p.j JOIN n c ON c.i = p.i AND c.j = p.j + 1 JOIN n d ON d.i = p.i + 1 AND d.j = p.j + 1),
v AS (SELECT l_orderkey, l_quantity, l_tax, za * (1 - u) * (1 - v) + zb * u * (1 - v) + zc * (1 - u) * v + zd * u * v AS density FROM q)"""


@query(f"WITH {_lookup_sql()} SELECT l_orderkey, l_quantity, l_tax, round(density, 5) AS density FROM v UNION ALL SELECT l_orderkey, l_quantity, l_tax, NULL FROM lineitem WHERE NOT (l_quantity BETWEEN 5 AND 45 AND l_tax BETWEEN 0.01 AND 0.07)")
def density_lookup(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_tax")
    return D.density_at_events(points, "l_quantity", "l_tax", _raster()).withColumn("density", F.round(F.nanvl("density", F.lit(None)), 5))


@query(f"WITH {_lookup_sql()} SELECT round(quantile_cont(coalesce(v.density, 0), 0.25), 4) AS q25, round(quantile_cont(coalesce(v.density, 0), 0.5), 4) AS q50, round(quantile_cont(coalesce(v.density, 0), 0.9), 4) AS q90 FROM (SELECT density FROM v UNION ALL SELECT NULL FROM lineitem WHERE NOT (l_quantity BETWEEN 5 AND 45 AND l_tax BETWEEN 0.01 AND 0.07)) v")
def quantile_levels(spark, sf_dir):
    levels = D.quantile_levels(table(spark, sf_dir, "lineitem"), "l_quantity", "l_tax", _raster(), [0.25, 0.5, 0.9])
    return spark.createDataFrame([tuple(round(v, 4) for v in levels)], "q25 double, q50 double, q90 double")


@query()
def kde_contours(spark, sf_dir):
    lines = D.contour_lines(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", [0.5, 0.9])
    rows = [(q, k, len(c)) for q, ls in zip((0.5, 0.9), lines) for k, c in enumerate(ls)]
    return spark.createDataFrame(rows, "quantile double, line int, vertices int")


_GROUPS = "SELECT CASE WHEN o_orderstatus = 'F' THEN 'treatment' ELSE 'control' END AS grp, (o_orderkey % 4)::INTEGER AS repetition, o_totalprice / 1000 AS x FROM orders"


def _groups(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.when(F.col("o_orderstatus") == "F", "treatment").otherwise("control").alias("group"), (F.col("o_orderkey") % 4).cast("int").alias("repetition"), (F.col("o_totalprice") / 1000).alias("x"))


@query(f'SELECT grp AS "group", repetition, count(*) AS n, round(sum(x), 3) AS sum_x, round(sum(x * x), 2) AS sum_x2 FROM ({_GROUPS}) GROUP BY 1, 2')
def mixed_sums(spark, sf_dir):
    s = M.sufficient_sums(_groups(spark, sf_dir), "x")
    return s.select("group", "repetition", "n", F.round("sum_x", 3).alias("sum_x"), F.round("sum_x2", 2).alias("sum_x2"))


def _numbers(spark, fit):
    return spark.createDataFrame([(k, float(v)) for k, v in fit.items() if k not in ("repetitions", "model")], "name string, value double")


@query()
def lmm_fit(spark, sf_dir):
    return _numbers(spark, M.compare(_groups(spark, sf_dir), "x"))


@query()
def gamma_fit(spark, sf_dir):
    """The log-link Gamma model of the same groups."""
    return _numbers(spark, M.compare(_groups(spark, sf_dir), "x", model="glmer+loglink"))


# A balanced design with effects of each repetition, for which the linear model has a closed form: fixed effects are means of cell
# means, and twice the log likelihood ratio is K ln(1 + K m^2 / ((K - 1) v)) for mean m and variance v of K differences.
_BALANCED = "SELECT (o_orderkey % 2)::INTEGER AS g, ((o_orderkey // 2) % 5)::INTEGER AS k, o_totalprice / 1000 + 300 * ((o_orderkey // 2) % 5) + (o_orderkey % 2) * (50 + 120 * ((o_orderkey // 2) % 5 % 3)) AS x FROM orders WHERE o_orderkey < (SELECT count(*) // 10 * 10 FROM orders)"


@query(
    f"""WITH c AS (SELECT g, k, avg(x) AS m FROM ({_BALANCED}) GROUP BY g, k), d AS (SELECT k, max(CASE WHEN g = 0 THEN m END) AS a, max(CASE WHEN g = 1 THEN m END) AS b FROM c GROUP BY k),
r AS (SELECT avg(a) AS intercept, avg(b - a) AS treatment, count(*) AS n, var_samp(b - a) AS v FROM d)
SELECT round(intercept, 4) AS intercept, round(treatment, 4) AS treatment, round(n * ln(1 + n * treatment * treatment / v / (n - 1)), 3) AS chi_square FROM r"""
)
def lmm_balanced(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, g = F.floor(F.col("o_orderkey") / 2), F.col("o_orderkey") % 2
    x = F.col("o_totalprice") / 1000 + 300 * (k % 5) + g * (50 + 120 * (k % 5 % 3))
    whole = o.where(F.col("o_orderkey") < o.count() // 10 * 10)
    fit = M.compare(whole.select(F.when(g == 1, "treatment").otherwise("control").alias("group"), (k % 5).cast("int").alias("repetition"), x.alias("x")), "x")
    return spark.createDataFrame([(round(float(fit["intercept"]), 4), round(float(fit["treatment"]), 4), round(float(fit["chi_square"]), 3))], "intercept double, treatment double, chi_square double")


@query()
def bootstrap_medians(spark, sf_dir):
    o = _groups(spark, sf_dir).withColumn("region", F.when(F.rint("x") % 2 == 0, "channel").otherwise("reservoir"))
    return M.differential(o, "x")


def _full_sums_sql(widths: str, form: str) -> str:
    """The sum over all orders at each order, every pair computed."""
    return f"""WITH p AS (SELECT o_orderkey AS k, o_totalprice / 1000 AS x, o_custkey::DOUBLE AS y FROM orders), w AS ({widths})
SELECT a.k AS o_orderkey, round(sum(exp(-0.5 * ({form}))) / any_value(n * 2 * pi() * sqrt(det)) * 1e9, 3) AS density FROM p a, p b, w GROUP BY a.k"""


def _orders_xy(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("x"), F.col("o_custkey").cast("double").alias("y"))


@query(
    _full_sums_sql(
        "SELECT n, a, b, d, a * d - b * b AS det FROM (SELECT count(*)::DOUBLE AS n, var_samp(x) * pow(count(*), -1.0/3) AS a, covar_samp(x, y) * pow(count(*), -1.0/3) AS b, var_samp(y) * pow(count(*), -1.0/3) AS d FROM p)",
        "(d * pow(a.x - b.x, 2) - 2 * w.b * (a.x - b.x) * (a.y - b.y) + w.a * pow(a.y - b.y, 2)) / det",
    )
)
def kde_gauss_at_events(spark, sf_dir):
    """The Gaussian density at every order, from all orders (KDE-06), in units of 1e-9."""
    return K.density_exact(_orders_xy(spark, sf_dir), "x", "y", "gauss", "o_orderkey").withColumn("density", F.round(F.col("density") * 1e9, 3))


@query(_full_sums_sql("SELECT count(*)::DOUBLE AS n, 400.0 AS a, 0.0 AS b, 2500.0 AS d, 1000000.0 AS det FROM p", "pow(a.x - b.x, 2) / w.a + pow(a.y - b.y, 2) / d"))
def kde_multivariate_at_events(spark, sf_dir):
    """A product of kernels of given widths at every order."""
    return K.density_exact(_orders_xy(spark, sf_dir), "x", "y", "multivariate", "o_orderkey", bandwidth=(20.0, 50.0)).withColumn("density", F.round(F.col("density") * 1e9, 3))
