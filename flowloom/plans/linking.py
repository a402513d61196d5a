"""Queries of hierarchies, index maps and basins."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.operators import basins as B
from flowloom.operators import hierarchy as H
from flowloom.plans.registry import query, table

_CHILD = "SELECT event_id AS root_idx, value, row_number() OVER (ORDER BY event_id) - 1 AS event_idx FROM events WHERE value > 30"
_GRAND = f"SELECT root_idx, value, event_idx AS parent_idx, row_number() OVER (ORDER BY event_idx) - 1 AS event_idx FROM ({_CHILD}) WHERE root_idx % 3 = 0"


def _root(spark, sf_dir):
    return H.as_root(table(spark, sf_dir, "events").select(F.col("event_id").alias("event_idx"), "value"))


def _grandchild(spark, sf_dir):
    return H.child(H.child(_root(spark, sf_dir), F.col("value") > 30), F.col("root_idx") % 3 == 0)


@query(f"SELECT root_idx, parent_idx, event_idx, event_idx + 1 AS index, value FROM ({_GRAND})")
def child_reindex(spark, sf_dir):
    return _grandchild(spark, sf_dir).select("root_idx", "parent_idx", "event_idx", "index", "value")


@query(f"SELECT event_idx AS child_idx, root_idx FROM ({_GRAND})")
def child_to_root(spark, sf_dir):
    c = _grandchild(spark, sf_dir)
    return H.child_to(c, c.select(F.col("event_idx").alias("child_idx")), "root")


@query(f"SELECT parent_idx, event_idx AS child_idx FROM ({_GRAND})")
def parent_to_child(spark, sf_dir):
    every = H.child(_root(spark, sf_dir), F.col("value") > 30).select(F.col("event_idx").alias("parent_idx"))
    return H.to_child(_grandchild(spark, sf_dir), every)


@query("SELECT event_id AS event_idx, CASE WHEN value > 30 AND event_id % 2 = 0 THEN value * 2 END AS doubled FROM events")
def temp_feature_scatter(spark, sf_dir):
    root = _root(spark, sf_dir)
    values = H.child(root, (F.col("value") > 30) & (F.col("root_idx") % 2 == 0)).select("root_idx", (F.col("value") * 2).alias("value"))
    out = H.scatter_to_root(root.select("event_idx"), values, "doubled")
    return out.withColumn("doubled", F.nanvl("doubled", F.lit(None)))


@query("SELECT event_id AS root_idx, row_number() OVER (ORDER BY event_id) - 1 AS event_idx FROM events WHERE value > 30 AND event_id NOT IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)")
def hidden_exclusions(spark, sf_dir):
    hidden = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)], "root_idx long")
    return H.child(_root(spark, sf_dir), F.col("value") > 30, hidden).select("root_idx", "event_idx")


@query("SELECT event_id FROM events WHERE value > 30 AND event_id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)")
def visible_exclusions(spark, sf_dir):
    hidden = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)], "root_idx long")
    return H.visible(H.child(_root(spark, sf_dir), F.col("value") > 30), hidden).select(F.col("root_idx").alias("event_id"))


@query("SELECT a.event_id, a.value, b.user_id FROM events a JOIN events b USING (event_id)")
def basin_same(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return B.resolve(e.select("event_id", "value"), ["user_id"], [B.Basin(e.select("event_id", "user_id", "ts"), "event_id")], "event_id")


@query("SELECT e.event_id, e.user_id, c.c_acctbal, c.c_mktsegment FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey")
def basin_mapped(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    c = B.Basin(table(spark, sf_dir, "customer"), "c_custkey", "user_id", "file")
    return B.resolve(e, ["c_acctbal", "c_mktsegment"], [c], "event_id")


@query("SELECT e.event_id, c.c_name, n.n_name FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
def basin_chain(spark, sf_dir):
    nation = B.Basin(table(spark, sf_dir, "nation"), "n_nationkey", "c_nationkey", "internal")
    customer = B.Basin(table(spark, sf_dir, "customer"), "c_custkey", "user_id", "remote", "s3", basins=(nation,))
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    return B.resolve(e, ["c_name", "n_name"], [customer], "event_id").select("event_id", "c_name", "n_name")


_SIDE = "SELECT event_id AS place, user_id % 5 AS frame, value FROM events WHERE event_id % 4 <> 1"


@query(f"WITH l AS (SELECT event_id AS place, user_id % 5 AS frame FROM events), r AS ({_SIDE}), m AS (SELECT l.place, r.place AS matched, r.value AS matched_value, row_number() OVER (PARTITION BY l.place ORDER BY abs(r.place - l.place), r.place) AS k FROM l JOIN r ON r.frame = l.frame AND abs(r.place - l.place) <= 2) SELECT l.place, l.frame, m.matched, m.matched_value FROM l LEFT JOIN m ON m.place = l.place AND m.k = 1")
def asof_frame_match(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("place"), (F.col("user_id") % 5).alias("frame"), "value")
    return B.frame_match(e.drop("value"), e.where("place % 4 <> 1"), "place", "frame", "value")


@query(f"SELECT g.event_idx, (g.root_idx * 7) % 1000 AS basin_idx FROM ({_GRAND}) g")
def basin_map_composed(spark, sf_dir):
    c = _grandchild(spark, sf_dir)
    mapped = _root(spark, sf_dir).select("root_idx", (F.col("root_idx") * 7 % 1000).alias("basin_idx"))
    return B.compose_map(c.select("event_idx", "root_idx"), mapped)
