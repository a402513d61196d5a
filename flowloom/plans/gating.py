"""Queries of gates, statistics and sampling."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from flowloom.functions.numeric import finite_or_null, log_or_limit
from flowloom.operators import gates as G
from flowloom.operators import sample, stats
from flowloom.plans.registry import query, table

POLYGON = ((5.0, 0.01), (45.0, 0.02), (40.0, 0.09), (12.0, 0.07))


def _edges(x: str, y: str, points=POLYGON) -> str:
    """The polygon rule in SQL: parity of the edges crossed to the right of a point."""
    parts = []
    for (xa, ya), (xb, yb) in zip(points, points[-1:] + points[:-1]):
        if ya != yb:
            parts.append(f"CASE WHEN {y} >= {min(ya, yb)!r}::DOUBLE AND {y} < {max(ya, yb)!r}::DOUBLE AND {x} < {(xb - xa) / (yb - ya)!r}::DOUBLE * ({y} - {ya!r}::DOUBLE) + {xa!r}::DOUBLE THEN 1 ELSE 0 END")
    return "(" + " + ".join(parts) + ") % 2 = 1"


_COUNT = "count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, round(sum(l_extendedprice), 2) AS price"


def _totals(df):
    return df.agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query(f"SELECT {_COUNT} FROM lineitem WHERE l_quantity BETWEEN 10 AND 30")
def box_gate(spark, sf_dir):
    return _totals(table(spark, sf_dir, "lineitem").where(G.Box("l_quantity", 10, 30).condition()))


@query(f"SELECT {_COUNT} FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.05")
def box_gate_swapped(spark, sf_dir):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", G.GateWarning)
        gate = G.Box("l_discount", 0.05, 0.02)
    return _totals(table(spark, sf_dir, "lineitem").where(gate.condition()))


@query(f"SELECT {_COUNT} FROM lineitem")
def box_gate_noop(spark, sf_dir):
    return _totals(table(spark, sf_dir, "lineitem").where(G.Box("l_quantity", 7, 7).condition()))


@query(f"SELECT {_COUNT} FROM lineitem WHERE {_edges('l_quantity', 'l_discount')}")
def polygon_gate(spark, sf_dir):
    return _totals(table(spark, sf_dir, "lineitem").where(G.Polygon("l_quantity", "l_discount", POLYGON).condition()))


@query(f"SELECT {_COUNT} FROM lineitem WHERE NOT ({_edges('l_quantity', 'l_discount')})")
def polygon_gate_inverted(spark, sf_dir):
    return _totals(table(spark, sf_dir, "lineitem").where(G.Polygon("l_quantity", "l_discount", POLYGON, inverted=True).condition()))


_CELLS_OF = ((1.0, 1.0), (8.0, 2.0), (6.0, 9.0), (2.0, 7.0))


@query(f"SELECT l_linenumber AS r, floor(l_quantity / 5)::INTEGER AS c, count(*) AS n, any_value({_edges('c0', 'r0', _CELLS_OF)}) AS inside FROM (SELECT *, l_linenumber::DOUBLE AS r0, floor(l_quantity / 5) AS c0 FROM lineitem) GROUP BY l_linenumber, floor(l_quantity / 5)")
def grid_mask(spark, sf_dir):
    """Events counted by the cells of a raster, with the raster's polygon mask."""
    mask = G.grid_in_polygon(spark, (12, 12), [(y, x) for x, y in _CELLS_OF])
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("r"), F.floor(F.col("l_quantity") / 5).cast("int").alias("c")).agg(F.count("*").alias("n"))
    return cells.join(F.broadcast(mask), ["r", "c"])  # 144 cells


_ODD = "CASE WHEN l_linenumber = 3 THEN 'NaN'::DOUBLE WHEN l_linenumber = 5 THEN 'Infinity'::DOUBLE ELSE l_quantity END"


def _with_odd(df):
    return df.withColumn("odd", F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).when(F.col("l_linenumber") == 5, F.lit(float("inf"))).otherwise(F.col("l_quantity")))


@query(f"SELECT {_COUNT} FROM (SELECT *, {_ODD} AS odd FROM lineitem) WHERE NOT isnan(odd) AND NOT isinf(odd) AND NOT isnan(l_tax)")
def finite_gate(spark, sf_dir):
    return _totals(_with_odd(table(spark, sf_dir, "lineitem")).where(G.Finite(("odd", "l_tax")).condition()))


@query(f"SELECT {_COUNT} FROM (SELECT *, {_ODD} AS odd FROM lineitem) WHERE NOT isnan(odd) AND odd BETWEEN 5 AND 20")
def box_gate_nan(spark, sf_dir):
    return _totals(_with_odd(table(spark, sf_dir, "lineitem")).where(G.Box("odd", 5, 20).condition()))


@query("SELECT event_id, value FROM events WHERE event_id NOT IN (0, 8, 471) AND event_id % 10 <> 7")
def manual_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = e.where("event_id % 10 = 7").select("event_id").unionByName(spark.createDataFrame([(0,), (8,), (471,)], "event_id long"))
    return G.exclude(e, out, "event_id").select("event_id", "value")


@query(f"SELECT count(*) AS n, round(100.0 * avg(CASE WHEN l_extendedprice BETWEEN 1000 AND 60000 AND {_edges('l_quantity', 'l_discount')} THEN 1 ELSE 0 END), 9) AS gated_percent, CAST(sum(CASE WHEN l_extendedprice BETWEEN 1000 AND 60000 AND {_edges('l_quantity', 'l_discount')} THEN 1 ELSE 0 END) AS BIGINT) AS gated FROM lineitem")
def combined_gate_summary(spark, sf_dir):
    gate = G.combine([G.Box("l_extendedprice", 1000, 60000), G.Polygon("l_quantity", "l_discount", POLYGON), G.Finite(("l_tax",))])
    counted = table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), *stats.event_counts(gate))
    return counted.select("n", F.round("%-gated", 9).alias("gated_percent"), F.col("Events").alias("gated"))


@query(f"SELECT gate_box, gate_polygon, gate_all, count(*) AS n FROM (SELECT l_quantity BETWEEN 10 AND 30 AS gate_box, {_edges('l_quantity', 'l_discount')} AS gate_polygon, (l_quantity BETWEEN 10 AND 30 AND {_edges('l_quantity', 'l_discount')}) AS gate_all FROM lineitem) GROUP BY ALL")
def gate_masks(spark, sf_dir):
    masked = G.with_masks(table(spark, sf_dir, "lineitem"), {"box": G.Box("l_quantity", 10, 30), "polygon": G.Polygon("l_quantity", "l_discount", POLYGON)})
    return masked.groupBy("gate_box", "gate_polygon", "gate_all").agg(F.count("*").alias("n"))


@query("SELECT event_id, value FROM events WHERE value < 60 ORDER BY md5('47:' || event_id), event_id LIMIT 500")
def limit_events(spark, sf_dir):
    return sample.take_hashed(table(spark, sf_dir, "events").where("value < 60"), 500, "event_id").select("event_id", "value")


_STATS = [("Mean", "avg({})"), ("Median", "quantile_cont({}, 0.5)"), ("SD", "stddev_pop({})"), ("10th Percentile", "quantile_cont({}, 0.1)"), ("25th Percentile", "quantile_cont({}, 0.25)"), ("75th Percentile", "quantile_cont({}, 0.75)"), ("90th Percentile", "quantile_cont({}, 0.9)"), ("Min", "min({})"), ("Max", "max({})")]


def _stats_sql(features, source, by=""):
    cells = ", ".join(f"{{'feature': '{f}', 'method': '{m}', 'value': round(CAST({a.format(f)} AS DOUBLE), 5)}}" for f in features for m, a in _STATS)
    keys, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"SELECT {keys}s.feature AS feature, s.method AS method, s.value AS value FROM (SELECT {keys}unnest([{cells}]) AS s FROM {source}{group})"


@query(_stats_sql(["l_quantity", "l_extendedprice"], "lineitem WHERE l_discount BETWEEN 0.02 AND 0.08"))
def stats_long(spark, sf_dir):
    out = stats.describe(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], gate=G.Box("l_discount", 0.02, 0.08).condition())
    return out.withColumn("value", F.round("value", 5))


@query(_stats_sql(["l_extendedprice", "l_tax"], "lineitem", "l_returnflag"))
def stats_grouped(spark, sf_dir):
    return stats.describe(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_tax"], by=["l_returnflag"]).withColumn("value", F.round("value", 5))


@query(_stats_sql(["l_extendedprice", "l_tax", "l_quantity"], "lineitem", "l_returnflag, l_linestatus"))
def stats_selected(spark, sf_dir):
    """The same statistics with all quantiles of all groups and features found by narrowing, as above EXACT_ROWS rows."""
    out = stats.describe(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_tax", "l_quantity"], by=["l_returnflag", "l_linestatus"], exact_rows=1000)
    return out.withColumn("value", F.round("value", 5))


@query("WITH s AS (SELECT 2 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / pow(count(value), 1.0/3) AS w FROM events), b AS (SELECT round_even(value / w, 0) * w + w / 2 AS mode, count(*) AS n FROM events, s GROUP BY 1) SELECT round(mode, 5) AS mode, n FROM b ORDER BY n DESC, b.mode LIMIT 1")
def stats_mode(spark, sf_dir):
    return stats.mode(table(spark, sf_dir, "events"), "value").select(F.round("mode", 5).alias("mode"), "n")


_DOANE = """WITH m AS (SELECT count(*)::DOUBLE AS n, avg({0}) AS mu, stddev_pop({0}) AS sd, min({0}) AS lo, max({0}) AS hi FROM {1}),
g AS (SELECT abs(avg(pow({0} - mu, 3))) / any_value(pow(sd, 3)) AS g1 FROM {1}, m),
w AS (SELECT (hi - lo) / (1 + log2(n) + log2(1 + g1 / sqrt(6 * (n - 2) / ((n + 1) * (n + 3))))) AS w, hi - lo AS span FROM m, g)
SELECT round(w, 6) AS width, round_even(span / w, 0)::INTEGER AS bins FROM w"""


@query(_DOANE.format("value", "events"))
def doane_width(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.round(stats.doane_width("value"), 6).alias("width"), stats.doane_bins("value").alias("bins"))


@query("SELECT round((quantile_cont(value, 0.9) - quantile_cont(value, 0.1)) / 23, 6) AS width FROM events")
def percentile_width(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.round(stats.percentile_width("value"), 6).alias("width"))


@query("SELECT min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, count(value) AS n FROM (SELECT CASE WHEN event_id % 9 = 4 THEN NULL ELSE value END AS value FROM events)")
def nan_aware_range(spark, sf_dir):
    x = finite_or_null(F.when(F.col("event_id") % 9 == 4, F.lit(float("nan"))).otherwise(F.col("value")))
    return table(spark, sf_dir, "events").agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.round(F.avg(x), 6).alias("mean"), F.count(x).alias("n"))


@query("SELECT event_id, CASE WHEN v < 0 THEN 'nan' WHEN v = 0 THEN '-inf' ELSE CAST(round(ln(CASE WHEN v > 0 THEN v ELSE 1 END), 6) AS VARCHAR) END AS scaled FROM (SELECT event_id, (event_id % 5) - 1 AS v FROM events)")
def log_scale(spark, sf_dir):
    x = log_or_limit((F.col("event_id") % 5 - 1).cast("double"))
    text = F.when(F.isnan(x), "nan").when(x == float("-inf"), "-inf").otherwise(F.round(x, 6).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("scaled"))


_CELLS = "SELECT event_id, value, floor((value - lo) / (hi - lo) * 299)::INTEGER AS cx, floor((user_id - ulo) / (uhi - ulo) * 299)::INTEGER AS cy FROM (SELECT *, user_id::DOUBLE AS u FROM events), (SELECT min(value) AS lo, max(value) AS hi, min(user_id)::DOUBLE AS ulo, max(user_id)::DOUBLE AS uhi FROM events)"


@query(f"SELECT cx, cy, min(event_id) AS event_id FROM ({_CELLS}) GROUP BY cx, cy")
def grid_first(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("u", F.col("user_id").cast("double"))
    return sample.first_per_cell(e, "value", "u", "event_id")


@query(f"WITH c AS ({_CELLS}), f AS (SELECT min(event_id) AS event_id FROM c GROUP BY cx, cy) SELECT c.event_id, c.value FROM c LEFT JOIN f ON c.event_id = f.event_id ORDER BY CASE WHEN f.event_id IS NULL THEN 1 ELSE 0 END, md5('47:' || c.event_id), c.event_id LIMIT 700")
def grid_thin(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("u", F.col("user_id").cast("double"))
    return sample.thin(e, "value", "u", 700, "event_id").select("event_id", "value")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS rank FROM events WHERE value > 20")
def row_ranks(spark, sf_dir):
    return sample.with_rank(table(spark, sf_dir, "events").where("value > 20"), "event_id", "rank").select("event_id", "rank")


@query("SELECT feature, method, round(CASE method WHEN 'Mean' THEN avg(value) WHEN 'Min' THEN min(value) ELSE max(value) END, 6) AS value FROM events, (VALUES ('value', 'Mean'), ('value', 'Min'), ('value', 'Max')) m(feature, method) GROUP BY feature, method")
def stats_approximate(spark, sf_dir):
    out = stats.describe(table(spark, sf_dir, "events"), ["value"], stats.APPROXIMATE)
    return out.where(F.col("method").isin("Mean", "Min", "Max")).withColumn("value", F.round("value", 6))


@query("SELECT method, true AS within FROM (VALUES ('10th Percentile'), ('25th Percentile'), ('Median'), ('75th Percentile'), ('90th Percentile')) m(method) WHERE EXISTS (SELECT 1 FROM events)")
def sketched_quantile_ranks(spark, sf_dir):
    """Whether sketched quantiles stand where they should in the order of all values, to a thousandth."""
    e = table(spark, sf_dir, "events")
    named = stats.describe(e, ["value"], stats.APPROXIMATE).where("method like '%Percentile' or method = 'Median'").select("method", F.col("value").alias("at"))
    q = F.when(F.col("method") == "Median", 0.5).otherwise(F.regexp_extract("method", "([0-9]+)", 1).try_cast("double") / 100)
    placed = e.select("value").crossJoin(F.broadcast(named))  # five rows
    ranks = placed.groupBy("method").agg(F.avg((F.col("value") < F.col("at")).cast("int")).alias("less"), F.avg((F.col("value") <= F.col("at")).cast("int")).alias("upto"))
    return ranks.select("method", ((F.col("less") - 0.001 <= q) & (q <= F.col("upto") + 0.001)).alias("within"))


@query()
def limit_events_exact(spark, sf_dir):
    return sample.take_exact(table(spark, sf_dir, "events"), 300, "event_id").select("event_id", "value")


@query("SELECT event_type, count_if(value BETWEEN 20 AND 80) AS events, round(100.0 * avg(CASE WHEN value BETWEEN 20 AND 80 THEN 1 ELSE 0 END), 6) AS gated_percent, round(avg(CASE WHEN value BETWEEN 20 AND 80 THEN value END), 6) AS mean, round(stddev_pop(CASE WHEN value BETWEEN 20 AND 80 THEN value END), 5) AS sd FROM events GROUP BY event_type")
def live_statistics(spark, sf_dir):
    """A stream over the table's files, run until nothing new is there."""
    import uuid

    from flowloom.streaming import live

    name = f"live_{uuid.uuid4().hex}"
    stream = live.watch(spark, f"{sf_dir}/event[s].parquet", table(spark, sf_dir, "events").schema)  # a pattern, since a stream's path must not be a file
    sums = live.running_statistics(stream, ["value"], G.Box("value", 20, 80).condition(), ["event_type"])
    out = sums.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True)
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        out = out.option("checkpointLocation", f"{folder}/{name}")
    out.start().awaitTermination()
    r = spark.table(name)
    return r.select("event_type", F.col("Events").alias("events"), F.round("%-gated", 6).alias("gated_percent"), F.round("Mean value", 6).alias("mean"), F.round("SD value", 5).alias("sd"))
