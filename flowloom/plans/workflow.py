"""Queries of concatenation, splitting, condensing, exports, identifiers and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.catalog import Catalog, Metadata
from flowloom.frame import EventFrame
from flowloom.operators import basins, etl, quality
from flowloom.operators.derive import Recipe, Resolver
from flowloom.plans.registry import query, table


def _run(spark, sf_dir, part: int, date: str, time: str) -> EventFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_id") % 2 == part)
    df = e.select(F.col("event_id").alias("event_idx"), (F.col("event_id") * 0.5).alias("time"), F.col("event_id").alias("frame"), (F.col("event_id") + 1).alias("index_online"), F.col("value").alias("deform"))
    return EventFrame(df, Metadata().update({"experiment": {"date": date, "time": time, "run index": 1 + part}, "imaging": {"frame rate": 100}}))


def _part_sql(part: int, shift: float, frames: int, online: str, at: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY event_id) - 1 + {at} AS event_idx, event_id * 0.5::DOUBLE + {shift} AS time, event_id + {frames} AS frame, event_id + 1 + {online} AS index_online, value AS deform FROM events WHERE event_id % 2 = {part}"


@query("SELECT event_idx, event_idx + 1 AS index, round(time, 3) AS time, frame, index_online, deform FROM (" + _part_sql(1, 0.0, 0, "0", "0") + " UNION ALL " + _part_sql(0, 60.5, 6050, "(SELECT max(event_id) FROM events WHERE event_id % 2 = 1) + 2", "(SELECT count(*) FROM events WHERE event_id % 2 = 1)") + ")")
def concat_runs(spark, sf_dir):
    late, early = _run(spark, sf_dir, 0, "2019-11-04", "15:01:00.500"), _run(spark, sf_dir, 1, "2019-11-04", "15:00:00")
    out = etl.concatenate([late, early]).df
    return out.withColumn("time", F.round("time", 3)).select("event_idx", "index", "time", "frame", "index_online", "deform")


@query("SELECT event_id, (r // 300)::INTEGER AS part, r % 300 AS part_idx FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS r FROM events WHERE value > 10)")
def split_chunks(spark, sf_dir):
    return etl.split(table(spark, sf_dir, "events").where("value > 10").select("event_id"), 300, "event_id").select("event_id", "part", "part_idx")


@query("SELECT event_id AS event_idx, value AS circ, round(1 - value, 9) AS deform, event_id AS frame, event_id + 1 AS index, event_id / 50.0 AS time FROM events")
def condense(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("event_idx"), F.col("value").alias("circ"), F.col("event_id").alias("frame"), F.array("value").alias("image"))
    out = etl.condense(EventFrame(df, Metadata().update({"imaging": {"frame rate": 50}}))).df
    return out.withColumn("deform", F.round("deform", 9))


@query("SELECT event_id AS event_idx, printf('%.10e', user_id::DOUBLE) || chr(9) || printf('%.10e', value) AS line FROM events WHERE value > 50")
def export_tsv(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value > 50").select(F.col("event_id").alias("event_idx"), "user_id", "value")
    return etl.tsv_lines(e, ["value", "USER_ID", "value"])


@query("SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id FROM (SELECT event_id, md5(user_id || '_' || event_type || '_' || event_id) AS h FROM events)")
def measurement_id(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", EventFrame.identifiers(F.col("user_id"), F.col("event_type"), F.col("event_id")).alias("id"))


@query("SELECT count_if(event_id % 100 = 99) AS wrong, count(*) AS n FROM events")
def index_check(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 100 == 99, 0).otherwise(F.col("event_id") + 1).alias("index"))
    return e.agg(quality.wrong_index("index", "event_id").alias("wrong"), F.count("*").alias("n"))


_CUES = """SELECT 'info' AS level UNION ALL SELECT 'info'
UNION ALL SELECT 'violation' WHERE '0' = '0' -- the pixel size isn't positive
UNION ALL SELECT 'violation' FROM events HAVING count_if(1 <> event_id + 1) > 0
UNION ALL SELECT 'violation' FROM events HAVING count_if(user_id * 0 <> 0) = 0 AND count(*) > 0
UNION ALL SELECT 'alert' FROM events HAVING min(value * 0) <= 0.1"""


@query(f"SELECT level, count(*) AS n FROM ({_CUES}) GROUP BY level")
def quality_report(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("event_idx"), F.lit(1).cast("long").alias("index"), (F.col("value") * 0).alias("fl1_max"), (F.col("user_id") * 0.0).alias("temp"))
    complete = {s: {k: "1" for k in keys} for s, keys in quality.REQUIRED.items()}
    complete["fluorescence"] = {k: "1" for k in quality.REQUIRED_FLUORESCENCE} | {"channel 1 name": "a", "laser 1 lambda": 488}
    complete["imaging"] |= {"pixel size": "0"}
    complete["experiment"].pop("event count")
    meta = Metadata().update(complete).set("experiment", "event count", df.count())
    return quality.summary(quality.check(df, meta))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / l_extendedprice, 9) AS per_area, round(l_quantity * l_extendedprice, 2) AS times_area FROM lineitem")
def plugin_features(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumns({"circ": F.col("l_quantity"), "area_um": F.col("l_extendedprice")})
    both = Recipe(("per_area", "times_area"), lambda c: {"per_area": F.col("circ") / F.col("area_um"), "times_area": F.col("circ") * F.col("area_um")}, ("circ", "area_um"))
    out = Resolver([both]).add(df, ["per_area"], Metadata())
    return out.select("l_orderkey", "l_linenumber", F.round("per_area", 9).alias("per_area"), F.round("times_area", 2).alias("times_area"))


@query("SELECT event_id, 'run' || user_id AS name, 'basinmap' || (event_id % 10) AS mapping, [event_type, 'deform'] AS features FROM events")
def json_properties(spark, sf_dir):
    text = F.to_json(F.struct(F.concat(F.lit("run"), F.col("user_id")).alias("name"), F.concat(F.lit("basinmap"), F.col("event_id") % 10).alias("mapping"), F.array("event_type", F.lit("deform")).alias("features")))
    return basins.definitions(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "text").select("event_id", "name", "mapping", "features")


# Names and labels of features, as the catalogue has them.
_LABELS = {"area_um": "Area", "deform": "Deformation", "bright_avg": "Brightness average", "ml_score_abc": "ML score ABC"}


@query(f"SELECT event_id, m[(event_id % 4)::INTEGER + 1].f AS feature, m[(event_id % 4)::INTEGER + 1].l AS label FROM events, (SELECT [{', '.join(f'{{f: $${f}$$, l: $${v}$$}}' for f, v in _LABELS.items())}] AS m)")
def feature_labels(spark, sf_dir):
    """Rows that name features, with the features' labels."""
    c = Catalog()
    names = spark.createDataFrame([(i, f, c.label(f, unit=False)) for i, f in enumerate(_LABELS)], "i long, feature string, label string")
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4).alias("i"))
    return e.join(F.broadcast(names), "i").select("event_id", "feature", "label")  # four rows
