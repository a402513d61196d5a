"""Queries of derived features, views of frames, densities at known places and single quality rules."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from flowloom.catalog import Catalog, Metadata, parse_config
from flowloom.frame import EventFrame
from flowloom.functions import geometry as G
from flowloom.operators import density as D
from flowloom.operators import gates, lut, quality, stats
from flowloom.operators.basins import Basin
from flowloom.operators.gates import Box, Polygon, PolygonRegistry
from flowloom.plans.registry import query, table
from flowloom.sources.store import parse_polygons, polygons_text


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("event_idx"), F.col("value").alias("deform"), F.col("user_id").cast("double").alias("area_um"))


# ---- derived features ------------------------------------------------------------------------------------------------

_SPILL = {"21": 0.1, "12": 0.05, "31": 0.02, "13": 0.03, "23": 0.2, "32": 0.07}


def _unmixed() -> str:
    """Signals = spill * emitted, channel a getting the share {ba} of channel b."""
    spill = np.array([[1.0 if a == b else _SPILL[f"{b}{a}"] for b in (1, 2, 3)] for a in (1, 2, 3)])
    inverse = np.linalg.inv(spill)
    return ", ".join(f"round({' + '.join(f'{float(inverse[k, j])!r}::DOUBLE * {c}' for j, c in enumerate(('l_quantity', 'l_discount * 100', 'l_tax * 100')))}, 6) AS fl{k + 1}_max_ctc" for k in range(3))


@query(f"SELECT l_orderkey, l_linenumber, round(l_extendedprice / l_quantity, 6) AS area_ratio, {_unmixed()} FROM lineitem")
def ratio_and_spill(spark, sf_dir):
    """area_ratio and compensated signals, resolved by name."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("area_cvx"), F.col("l_quantity").alias("area_msd"), F.col("l_quantity").alias("fl1_max"), (F.col("l_discount") * 100).alias("fl2_max"), (F.col("l_tax") * 100).alias("fl3_max"))
    meta = Metadata().update({"calculation": {f"crosstalk fl{k}": v for k, v in _SPILL.items()}})
    names = ["area_ratio", "fl1_max_ctc", "fl2_max_ctc", "fl3_max_ctc"]
    out = EventFrame(df, meta).with_features(*names).df
    return out.select("l_orderkey", "l_linenumber", *[F.round(n, 6).alias(n) for n in names])


_FLAT = np.array([[5.0, 0.01, 1.0], [45.0, 0.01, 1.0], [5.0, 0.09, 1.0], [45.0, 0.09, 1.0]])


@query("SELECT l_orderkey, l_quantity, l_discount, CASE WHEN l_quantity BETWEEN 5 AND 45 AND l_discount BETWEEN 0.015 AND 0.085 THEN round(0.08 / 0.04 * 6.5 / 15, 6) WHEN l_quantity NOT BETWEEN 5 AND 45 OR l_discount NOT BETWEEN 0.005 AND 0.095 THEN NULL ELSE -1 END AS emodulus FROM lineitem WHERE l_discount NOT BETWEEN 0.005 AND 0.015 AND l_discount NOT BETWEEN 0.085 AND 0.095")
def emodulus_given_viscosity(spark, sf_dir):
    """Stiffness resolved by name, from a flat table and a stated viscosity; the table's own border is left out."""
    df = table(spark, sf_dir, "lineitem").where("l_discount not between 0.005 and 0.015 and l_discount not between 0.085 and 0.095")
    df = df.select("l_orderkey", "l_quantity", "l_discount", F.col("l_quantity").alias("area_um"), F.col("l_discount").alias("deform"))
    luts = lut.LutRegistry()
    luts.register(lut.Lut(_FLAT, identifier="flat"))
    meta = Metadata().update({"setup": {"channel width": 20, "flow rate": 0.08, "chip region": "channel"}, "calculation": {"emodulus lut": "flat", "emodulus viscosity": 6.5}})
    meta.set("imaging", "pixel size", 0)
    out = EventFrame(df, meta, luts=luts).with_features("emodulus").df
    return out.select("l_orderkey", "l_quantity", "l_discount", F.round(F.nanvl("emodulus", F.lit(None)), 6).alias("emodulus"))


_W, _H = "(2 + vec_id % 5)", "(3 + vec_id % 7)"


@query(f"SELECT vec_id, round({_W} / {_H}::DOUBLE, 6) AS inert_ratio_cvx FROM embeddings")
def hull_of_boxes(spark, sf_dir):
    """Inertia ratios of hulls of boxes with a dent; the dent doesn't count."""
    w, h = 2 + F.col("vec_id") % 5, 3 + F.col("vec_id") % 7
    p = lambda x, y: F.struct(F.lit(x).cast("int").alias("x") if isinstance(x, int) else x.cast("int").alias("x"), F.lit(y).cast("int").alias("y") if isinstance(y, int) else y.cast("int").alias("y"))
    dent = F.array(p(0, 0), p(1, 1), p(w, 0), p(w, h), p(1, h - 1), p(0, h))
    out = EventFrame(table(spark, sf_dir, "embeddings").select("vec_id", dent.alias("contour"))).with_features("inert_ratio_cvx").df
    return out.select("vec_id", F.round("inert_ratio_cvx", 6).alias("inert_ratio_cvx"))


@query(f"SELECT vec_id, {_W}::INTEGER AS width, {_H}::INTEGER AS height, (2 * ({_W} + {_H}) - 4)::INTEGER AS points FROM embeddings")
def outlines_of_boxes(spark, sf_dir):
    """Outlines found in masks that are boxes: their size, and that they have each border pixel once."""
    x, y = F.col("i") % 12, F.floor(F.col("i") / 12)
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(143))).alias("i"))
    inside = (x >= 1) & (x <= 2 + F.col("vec_id") % 5) & (y >= 1) & (y <= 3 + F.col("vec_id") % 7)
    masks = e.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", inside.alias("m")))), lambda s: s["m"]).alias("mask"))
    c = masks.select("vec_id", G.contour_of(F.col("mask"), F.lit(12), F.lit(12)).alias("c"))
    span = lambda v: (F.array_max(v) - F.array_min(v) + 1).cast("int")
    return c.select("vec_id", span(F.col("c.x")).alias("width"), span(F.col("c.y")).alias("height"), F.size(F.array_distinct("c")).alias("points"))


@query("SELECT vec_id, round(avg(v), 5) AS bright_avg, round(stddev_pop(v), 5) AS bright_sd FROM (SELECT vec_id, unnest(embedding) * 100 AS v, unnest(range(64)) AS i FROM embeddings) WHERE i % 2 = 0 GROUP BY vec_id")
def brightness_by_name(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: (v * 100).cast("float")).alias("image"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i % 2 == 0).alias("mask"))
    out = EventFrame(df).with_features("bright_avg", "bright_sd").df
    return out.select("vec_id", F.round("bright_avg", 5).alias("bright_avg"), F.round("bright_sd", 5).alias("bright_sd"))


# ---- frames ----------------------------------------------------------------------------------------------------------


@query("SELECT 'all' AS what, count(*) AS n FROM events UNION ALL SELECT 'gated', count(*) FROM events WHERE value BETWEEN 10 AND 50 AND user_id BETWEEN 20 AND 90 UNION ALL SELECT 'excluded', count(*) FROM events WHERE value BETWEEN 10 AND 50 AND user_id BETWEEN 20 AND 90 AND event_id % 3 <> 0 UNION ALL SELECT 'limited', least(100, count(*)) FROM events WHERE value BETWEEN 10 AND 50 AND user_id BETWEEN 20 AND 90 UNION ALL SELECT 'child', count(*) FROM events WHERE value BETWEEN 10 AND 50 AND user_id BETWEEN 20 AND 90 AND value < 30 UNION ALL SELECT 'reset', count(*) FROM events")
def gate_states(spark, sf_dir):
    """Gates added, rows excluded, a limit, a child and all of it reset."""
    f = EventFrame(_events(spark, sf_dir))
    g = f.gate(Box("deform", 10, 50)).gate(Box("area_um", 20, 90))
    states = {"all": f.df, "gated": g.gated(), "excluded": g.exclude(f.df.where("event_idx % 3 = 0")).gated(), "limited": g.limited(100).gated(), "child": g.child().gate(Box("deform", -1, 29.999999)).gated(), "reset": g.limited(5).without_gates().gated()}
    out = None
    for k, df in states.items():
        one = df.agg(F.lit(k).alias("what"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT event_id AS event_idx, value FROM events WHERE event_id NOT IN (SELECT min(event_id) FROM events UNION ALL SELECT max(event_id) FROM events)")
def empty_images(spark, sf_dir):
    """The first and the last event go, as their images are empty; empty ones between stay."""
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("event_id")).first()[0]
    blank = F.col("event_id").isin(0, 1, 2, last) | (F.col("event_id") % 10 == 5)
    image = F.when(blank, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array("value", F.lit(1.0)))
    return gates.drop_empty_boundary_images(e.select(F.col("event_id").alias("event_idx"), "value", image.alias("image"))).select("event_idx", "value")


@query("SELECT event_id AS event_idx, value * 3 AS tilt FROM events")
def basin_choice(spark, sf_dir):
    """Of basins that offer one feature: those of other measurements are refused, internal ones come before files, and these
    before remote ones."""
    e = _events(spark, sf_dir)
    side = lambda k: e.select("event_idx", (F.col("deform") * k).alias("tilt"))
    basins = (Basin(side(1), kind="internal", identifier="other"), Basin(side(2), kind="remote", identifier="run"), Basin(side(3), kind="file", identifier="run"), Basin(side(4), kind="file", format="rest", identifier="run"))
    f = EventFrame(e, Metadata().set("experiment", "run identifier", "run"), basins=basins)
    return f.with_features("tilt").df.select("event_idx", "tilt")


@query("SELECT 'deform' AS feature, 'Range' AS method, round(max(value) - min(value), 6) AS value FROM events UNION ALL SELECT 'deform', 'Count', count(*)::DOUBLE FROM events UNION ALL SELECT 'tilt', m, NULL FROM (VALUES ('Range'), ('Count')) t(m)")
def own_statistics(spark, sf_dir):
    """Methods that a user adds, for a feature that is there and one that isn't."""
    own = {"Range": lambda x: F.max(x) - F.min(x), "Count": F.count}
    out = stats.describe(_events(spark, sf_dir), ["deform", "tilt"], own)
    return out.select("feature", "method", F.round(F.nanvl("value", F.lit(None)), 6).alias("value"))


@query("SELECT event_id AS event_idx, CASE WHEN event_id % 4 = 0 THEN value / 2 END AS half FROM events")
def temporary_padded(spark, sf_dir):
    """A temporary feature that fewer events have."""
    e = _events(spark, sf_dir)
    f = EventFrame(e).with_temporary("half", e.where("event_idx % 4 = 0").select("event_idx", (F.col("deform") / 2).alias("value")))
    return f.df.select("event_idx", F.nanvl("half", F.lit(None)).alias("half"))


_SQUARE = ((10.0, 20.0), (60.0, 20.0), (60.0, 120.0), (10.0, 120.0))


@query("SELECT count_if(a) AS inside, count_if(NOT a) AS outside FROM (SELECT value >= 10 AND value < 60 AND user_id >= 20 AND user_id < 120 AS a FROM events)")
def polygons_by_text(spark, sf_dir):
    """A polygon and its inverted copy, through a registry and a file's text."""
    r = PolygonRegistry()
    first = r.add(Polygon("deform", "area_um", _SQUARE, name="box"))
    r.copy(first, invert=True)
    back = parse_polygons(polygons_text(r.gates(list(r))))
    e = _events(spark, sf_dir)
    return e.agg(F.count_if(back[0].condition()).alias("inside"), F.count_if(back[1].condition()).alias("outside"))


@query("WITH c AS (SELECT event_id, value, user_id::DOUBLE AS u, floor((ln(value) - lo) / (hi - lo) * 299)::INTEGER AS cx, floor((user_id - ulo) / (uhi - ulo) * 299)::INTEGER AS cy FROM events, (SELECT min(ln(value)) AS lo, max(ln(value)) AS hi, min(user_id)::DOUBLE AS ulo, max(user_id)::DOUBLE AS uhi FROM events)), f AS (SELECT min(event_id) AS event_id FROM c GROUP BY cx, cy) SELECT c.event_id AS event_idx, value AS deform, u AS area_um FROM c LEFT JOIN f USING (event_id) ORDER BY CASE WHEN f.event_id IS NULL THEN 1 ELSE 0 END, md5('47:' || c.event_id), c.event_id LIMIT 400")
def scatter_view(spark, sf_dir):
    """400 events thinned by density on a logarithmic axis."""
    return EventFrame(_events(spark, sf_dir)).scatter("deform", "area_um", 400, ("log", "linear"))


@query("SELECT DISTINCT l_linenumber::DOUBLE AS emodulus, count(*) OVER (PARTITION BY l_linenumber) AS points, min(q) OVER (PARTITION BY l_linenumber) AS first_x, max(q) OVER (PARTITION BY l_linenumber) AS last_x FROM (SELECT DISTINCT l_linenumber, l_quantity AS q, round(l_discount, 2) AS d FROM lineitem WHERE l_quantity <= 10)")
def isoelastics_lines(spark, sf_dir):
    """Lines of equal stiffness, grouped from a table of points."""
    points = table(spark, sf_dir, "lineitem").where("l_quantity <= 10").select(F.col("l_quantity").alias("x"), F.round("l_discount", 2).alias("deform"), F.col("l_linenumber").cast("double").alias("emodulus")).distinct()
    lines = lut.isoelastic_lines(points)
    return lines.select("emodulus", F.size("line").cast("bigint").alias("points"), F.element_at("line", 1)["x"].alias("first_x"), F.element_at("line", -1)["x"].alias("last_x"))


# ---- densities -------------------------------------------------------------------------------------------------------


@query("SELECT ix, iy, round(x0 + (x1 - x0) * ix / (nx - 1), 6) AS x, round(y0 + (y1 - y0) * iy / (ny - 1), 6) AS y, 1.0::DOUBLE AS z FROM (SELECT min(value) AS x0, max(value) AS x1, min(user_id)::DOUBLE AS y0, max(user_id)::DOUBLE AS y1, greatest(2, ceil((max(value) - min(value)) / 20.0))::INTEGER AS nx, greatest(2, ceil((max(user_id) - min(user_id)) / 15.0))::INTEGER AS ny FROM events) r, (SELECT unnest(range(2000))::INTEGER AS ix) a, (SELECT unnest(range(2000))::INTEGER AS iy) b WHERE ix < nx AND iy < ny")
def raster_nodes(spark, sf_dir):
    """Nodes of a raster of given accuracy, without a density; of longer sides the first 2,000 nodes, as the SQL has them."""
    nodes = D.raster_nodes(_events(spark, sf_dir), "deform", "area_um", (20.0, 15.0)).where("ix < 2000 and iy < 2000")
    return nodes.select("ix", "iy", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.lit(1.0).alias("z"))


_M = "(SELECT count(*)::DOUBLE AS n, avg({0}) AS mu, stddev_pop({0}) AS sd, min({0}) AS lo, max({0}) AS hi FROM events)"
_BINS = "(SELECT greatest(5, round_even((any_value(hi) - any_value(lo)) / ((any_value(hi) - any_value(lo)) / (1 + log2(any_value(n)) + log2(1 + abs(avg(pow(({0} - mu) / sd, 3))) / sqrt(6 * (any_value(n) - 2) / ((any_value(n) + 1) * (any_value(n) + 3)))))), 0))::INTEGER AS b, any_value(lo) AS lo, any_value(hi) AS hi, any_value(n) AS n FROM events, " + _M + ")"


@query(
    f"""WITH a AS {_BINS.format('value')}, c AS {_BINS.format('user_id::DOUBLE')},
k AS (SELECT least(floor((value - a.lo) / ((a.hi - a.lo) / a.b)), a.b - 1)::INTEGER AS ix, least(floor((user_id - c.lo) / ((c.hi - c.lo) / c.b)), c.b - 1)::INTEGER AS iy, count(*) AS m FROM events, a, c GROUP BY 1, 2)
SELECT ix, iy, round(m / (a.n * (a.hi - a.lo) / a.b * (c.hi - c.lo) / c.b) * 1e6, 4) AS density FROM k, a, c"""
)
def density_at_bins(spark, sf_dir):
    """The histogram density at the middles of its own bins, where the spline goes through them (in units of 1e-6)."""
    e = _events(spark, sf_dir)
    (x0, x1, y0, y1), (nx, ny) = D.bounds(e, "deform", "area_um")
    at = D.histogram_density(e, "deform", "area_um")
    cells = D.histogram(e, "deform", "area_um", (nx, ny), (x0, x1, y0, y1)).collect()
    px = np.array([x0 + (r.bx + 0.5) * (x1 - x0) / nx for r in cells])
    py = np.array([y0 + (r.by + 0.5) * (y1 - y0) / ny for r in cells])
    z = at(px, py)
    return spark.createDataFrame([(r.bx, r.by, round(float(v) * 1e6, 4)) for r, v in zip(cells, z)], "ix int, iy int, density double")


# ---- quality ---------------------------------------------------------------------------------------------------------


@query(
    """SELECT 'feature data' AS category, 'ml_score_abc' AS key FROM events HAVING count_if(value / 100 > 1 OR value < 0) > 0
UNION ALL SELECT 'feature data', 'fl1_max' FROM events HAVING min(value - 100) <= 0.1
UNION ALL SELECT 'feature data', 'fl2_max_ctc' FROM events HAVING min(value - 200) <= 0.1
UNION ALL SELECT 'feature size', 'area_um' FROM events HAVING count_if(event_id % 50 = 7) > 0
UNION ALL SELECT 'metadata wrong', 'samples per event' FROM events HAVING count_if(event_id % 5 <> 2) > 0
UNION ALL SELECT 'metadata wrong', 'roi size x' FROM events HAVING count_if(user_id <> 12) > 0
UNION ALL SELECT 'metadata wrong', 'event count' FROM events HAVING count(*) <> 3
UNION ALL SELECT 'feature unknown', 'no_feature'"""
)
def quality_data_rules(spark, sf_dir):
    """Which rules on data a table of events breaks."""
    e = table(spark, sf_dir, "events")
    trace = F.create_map(F.lit("fl1_raw"), F.sequence(F.lit(0), F.col("event_id") % 5))
    df = e.select(F.col("event_id").alias("event_idx"), (F.col("value") / 100).alias("ml_score_abc"), (F.col("value") - 100).alias("fl1_max"), (F.col("value") - 200).alias("fl2_max_ctc"), F.when(F.col("event_id") % 50 != 7, F.col("value")).alias("area_um"), trace.alias("trace"), F.array(F.lit(1)).alias("image"), F.col("user_id").alias("img_w"), F.lit(5).alias("img_h"), F.lit(1).alias("no_feature"))
    meta = Metadata().update({"fluorescence": {"samples per event": 3}, "imaging": {"roi size x": 12, "roi size y": 5}, "experiment": {"event count": 3}})
    return spark.createDataFrame([(c[1], c[3]) for c in quality.data_cues(df, meta)], "category string, key string")


@query(
    """SELECT 'flow rate' AS key, 'violation' AS level FROM events HAVING min(value) - max(value) <= 0
UNION ALL SELECT 'flow rate', 'alert' FROM events HAVING abs(count(*) * 0.1 - (min(value) - max(value))) > 1e-9
UNION ALL SELECT 'channel count', 'violation' FROM (SELECT count(DISTINCT event_type) AS n FROM events) WHERE n <> 1
UNION ALL SELECT 'laser count', 'violation' FROM (SELECT count(DISTINCT event_type) AS n FROM events) WHERE n <> 0
UNION ALL SELECT 'chip region', 'violation'
UNION ALL SELECT 'area_um, deform polygon points', 'violation'"""
)
def quality_metadata_rules(spark, sf_dir):
    """Rules on metadata that a table's numbers break; missing keys are left out."""
    r = table(spark, sf_dir, "events").agg((F.min("value") - F.max("value")).alias("flow"), F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds")).first()
    meta = Metadata().update({"setup": {"flow rate": r.flow, "flow rate sample": r.n * 0.04, "flow rate sheath": r.n * 0.06, "chip region": "elsewhere"}, "fluorescence": {"channel count": r.kinds, "laser count": r.kinds, "channel 1 name": "a"}})
    meta.values["online_filter"] = {"area_um, deform polygon points": [[1.0, 2.0], [3.0, 4.0]]}
    cues = quality.metadata_cues(meta, True) + quality.choice_cues(meta, {"setup": {"chip region": ["channel", "reservoir"]}})
    return spark.createDataFrame([(c[3], c[0]) for c in cues if c[1] != "metadata missing"], "key string, level string")


# ---- lines, masks, text ----------------------------------------------------------------------------------------------


@query(
    """WITH k AS (SELECT floor(l_quantity / 5)::INTEGER AS i, round(l_discount * 100)::INTEGER AS j, count(*) AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT i, j, coalesce(n, 0) AS n FROM (SELECT unnest(range(11))::INTEGER AS i) a CROSS JOIN (SELECT unnest(range(11))::INTEGER AS j) b LEFT JOIN k USING (i, j)),
l AS (SELECT unnest([0.25, 0.5, 0.75]) * (SELECT max(n) FROM k) + 0.5 AS level),
e AS (SELECT level, (a.n > level) <> (b.n > level) AS crossed FROM g a JOIN g b ON (b.i = a.i + 1 AND b.j = a.j) OR (b.i = a.i AND b.j = a.j + 1), l)
SELECT level, count_if(crossed) AS vertices FROM e GROUP BY level"""
)
def iso_line_vertices(spark, sf_dir):
    """Vertices of iso-lines over a histogram: one on each edge of the grid whose ends lie on either side of the level."""
    cells = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_quantity") / 5).cast("int").alias("i"), F.rint(F.col("l_discount") * 100).cast("int").alias("j")).count().collect()
    z = np.zeros((11, 11))
    for r in cells:
        z[r.i, r.j] = r["count"]
    rows = []
    for share in (0.25, 0.5, 0.75):
        level = share * z.max() + 0.5
        rows.append((float(level), len({tuple(p) for line in D.iso_lines(z, level) for p in line.tolist()})))
    return spark.createDataFrame(rows, "level double, vertices long")


_TURNS = """WITH p AS (SELECT vec_id, i, (10 + round(embedding[i]::DOUBLE, 4)) * cos((i - 1) * 0.39269908169872414) AS x, (10 + round(embedding[i]::DOUBLE, 4)) * sin((i - 1) * 0.39269908169872414) AS y FROM embeddings, (SELECT unnest(range(1, 17)) AS i) t),
s AS (SELECT vec_id, i, atan2(coalesce(lead(y) OVER w, first_value(y) OVER w) - y, coalesce(lead(x) OVER w, first_value(x) OVER w) - x) AS heading FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
t AS (SELECT vec_id, heading - coalesce(lag(heading) OVER w, last_value(heading) OVER w) AS turn FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query(f"{_TURNS} SELECT vec_id, round(max(abs(degrees(turn - 2 * pi() * floor((turn + pi()) / (2 * pi()))))), 4) AS sharpest FROM t GROUP BY vec_id")
def opening_angles(spark, sf_dir):
    """The sharpest turn of each of many outlines."""
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.transform(F.slice("embedding", 1, 16), lambda x: F.round(x.cast("double"), 4)))
    along = lambda f: F.transform("v", lambda r, i: (r + 10) * f(i * 0.39269908169872414))

    @F.pandas_udf("double")
    def sharpest(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([D.opening_angles(np.column_stack([x, y])).max() for x, y in zip(xs, ys)])

    return e.select("vec_id", F.round(sharpest(along(F.cos), along(F.sin)), 4).alias("sharpest"))


@query(f"SELECT vec_id, (({_W} + 1) * ({_H} + 1))::BIGINT AS pixels FROM embeddings")
def masks_of_boxes(spark, sf_dir):
    """Pixels of masks that are filled from outlines of boxes, borders included."""
    w, h = 2 + F.col("vec_id") % 5, 3 + F.col("vec_id") % 7

    @F.pandas_udf("long")
    def pixels(ws: pd.Series, hs: pd.Series) -> pd.Series:
        def border(a: int, b: int) -> np.ndarray:
            right, up = [(x, 1) for x in range(1, a + 1)], [(1 + a, y) for y in range(1, b + 1)]
            left, down = [(x, 1 + b) for x in range(1 + a, 1, -1)], [(1, y) for y in range(1 + b, 1, -1)]
            return np.array(right + up + left + down)

        return pd.Series([int(G.fill_contour(border(a, b), (14, 14)).sum()) for a, b in zip(ws, hs)])

    return table(spark, sf_dir, "embeddings").select("vec_id", pixels(w, h).alias("pixels"))


@query("SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS value, 'text' AS form FROM nation UNION ALL SELECT n_name, CAST(n_regionkey AS VARCHAR), 'json' FROM nation")
def metadata_forms(spark, sf_dir):
    """A user's metadata through text and through JSON."""
    meta = Metadata()
    for r in table(spark, sf_dir, "nation").collect():  # 25 rows
        meta.set("user", r.n_name, r.n_regionkey)
    text = parse_config(meta.to_text()).values["user"]
    back = json.loads(meta.to_json())["user"]
    return spark.createDataFrame([(k, str(v), form) for form, d in (("text", text), ("json", back)) for k, v in d.items()], "key string, value string, form string")


@query("SELECT event_type AS feature, count(*) AS n, 'Type ' || event_type AS label FROM events GROUP BY event_type")
def registered_features(spark, sf_dir):
    """Features that a session registers, named by data, and their labels."""
    e = table(spark, sf_dir, "events")
    wide = e.groupBy().pivot("event_type").count()
    c = Catalog()
    for name in wide.columns:
        c.register(name, f"Type {name} [a.u.]")
    f = EventFrame(wide.withColumn("event_idx", F.lit(0)), catalog=c)
    long = f.df.unpivot([], f.features("innate"), "feature", "n")
    labels = spark.createDataFrame([(n, c.label(n, unit=False)) for n in f.features("innate")], "feature string, label string")
    return long.join(F.broadcast(labels), "feature").select("feature", "n", "label")


@query("SELECT emodulus, count(*) AS points, min(x) AS first_x FROM (SELECT DISTINCT l_linenumber::DOUBLE AS emodulus, l_quantity AS x FROM lineitem) GROUP BY emodulus")
def isoelastics_text(spark, sf_dir):
    """Lines of equal stiffness through the text format with its header."""
    points = table(spark, sf_dir, "lineitem").select("l_quantity", F.col("l_linenumber").cast("double").alias("e")).distinct().collect()  # 50 quantities, 7 lines
    head = '# BEGIN METADATA\n# {"channel_width": 20, "flow_rate": 0.04, "fluid_viscosity": 15, "lut identifier": "T"}\n# END METADATA\n#\n# area_um [um^2]\tdeform\temodulus [kPa]\n'
    sets = lut.Isoelastics()
    sets.load(spark, head + "\n".join(f"{r.l_quantity}\t{r.l_quantity / 1000}\t{r.e}" for r in points))
    lines = sets.get("deform", "area_um", "T", 20)
    return lines.select("emodulus", F.size("line").cast("bigint").alias("points"), F.array_min(F.transform("line", lambda p: p["area_um"])).alias("first_x"))
