"""Cues of stored files and of a measurement's history."""

import json

import pytest
from pyspark.sql import functions as F

from flowloom.catalog import Metadata
from flowloom.operators import quality
from flowloom.sources import defects
from flowloom.sources.footers import check_store, compression, column_cues, footers
from flowloom.sources.groups import GroupStore


def events(spark, n=40):
    return spark.range(n).select(F.col("id").alias("event_idx"), (F.col("id") * 0.5).alias("deform"), F.col("id").alias("frame"), F.array(F.col("id")).alias("image"))


def test_footers(spark, tmp_path):
    events(spark).repartition(3).write.option("compression", "zstd").parquet(str(tmp_path / "a"))
    events(spark).coalesce(1).write.option("compression", "uncompressed").parquet(str(tmp_path / "b"))
    a = footers(spark.read.parquet(str(tmp_path / "a")))
    got = {r.feature: (r.n, r.files) for r in a.groupBy("feature").agg(F.sum("rows").alias("n"), F.countDistinct("file").alias("files")).collect()}
    assert got["deform"] == (40, 3) and set(got) == {"event_idx", "deform", "frame", "image.list.element"}
    b = footers(spark.read.parquet(str(tmp_path / "b")))
    assert compression(a) == ("All", 4, 4) and compression(b) == ("None", 0, 4)
    assert compression(a.where("feature = 'deform'").union(b.where("feature <> 'deform'"))) == ("Partial (1 of 4)", 1, 4)
    assert column_cues(a) == []
    events(spark).withColumn("deform", F.col("deform").cast("string")).withColumn("frame", F.col("frame").cast("double")).write.parquet(str(tmp_path / "c"))
    assert [c[3] for c in column_cues(footers(spark.read.parquet(str(tmp_path / "c"))))] == ["deform", "frame"]


def test_store_cues(spark, tmp_path):
    store = GroupStore(spark, str(tmp_path / "s")).append(events(spark))
    mapping = events(spark).select("event_idx", F.col("frame").alias("basin_idx"))
    store.store_basin("b", ["x.parquet"], mapping=mapping)
    assert [r.msg for r in check_store(spark, store.path).collect()] == ["Compression: All"]
    broken = json.loads(json.dumps(store.manifest))
    for g in broken["groups"]:
        g["features"] = [f for f in g["features"] if f != "basinmap0"]
    broken["groups"] = [g for g in broken["groups"] if g["features"]]
    broken["groups"][0]["features"].append("tilt")
    broken["events"] = 41
    broken["meta"] = {"imaging": {"frame rate": "2000", "pixel size": 0.34}, "setup": {"flow rate": "fast", "unheard": 3}}
    store._commit(broken)
    cues = check_store(spark, store.path).collect()
    assert [(r.level, r.key) for r in cues] == [("info", None), ("violation", "tilt"), ("violation", "basinmap0"), ("violation", None), ("alert", "frame rate"), ("alert", "flow rate")]


def test_choices(spark):
    meta = Metadata().update({"setup": {"chip region": "channel", "medium": "water"}})
    assert quality.choice_cues(meta, {"setup": {"chip region": ["channel", "reservoir"], "medium": ["CMC"], "channel width": [20]}})[0][3] == "medium"


HISTORY = defects.history("Rec", "Ana", "rec-log", "volumes-done")


@pytest.mark.parametrize(
    "chain,meta,logs,gone",
    [
        ("Rec 2.0.6", {}, (), {"aspect"}),
        ("Rec 2.0.7", {}, (), {"aspect"}),
        ("Rec 2.0.8", {}, (), set()),
        ("Rec 2.0.6 | Ana 1.0", {}, (), set()),
        ("Rec 3 | Ana 0.36.1", {"frame rate": 100}, (), {"time", "volume"}),
        ("Rec 3 | Ana 0.36.1", {}, ("volumes-done",), set()),
        ("Other 3 | Ana 0.47.5", {"frame rate": 100}, (), set()),
        ("Rec 3 | Ana 0.47.6", {"frame rate": 100}, (), set()),
        ("Rec 2.0.5 | Ana 0.48.2", {"roi size x": 501}, (), {"inert_ratio_prnc", "tilt"}),
        ("Rec 2.0.4 | Ana 0.48.2", {"roi size x": 501}, (), {"inert_ratio_prnc", "tilt", "inert_ratio_raw", "inert_ratio_cvx"}),
        ("2.1.0 | Ana 0.48.2", {"roi size x": 501}, ("rec-log",), {"inert_ratio_prnc", "tilt"}),
        ("2.1.0 | Ana 0.48.2", {"roi size x": 501}, (), {"inert_ratio_prnc", "tilt", "inert_ratio_raw", "inert_ratio_cvx"}),
        ("Rec 2.0.4 | Ana 0.48.3", {"roi size x": 501}, (), set()),
        ("Rec 2.0.4 | Ana 0.48.2", {"roi size x": 500}, (), set()),
        ("", {"roi size x": 900, "frame rate": 1}, (), set()),
    ],
)
def test_history(spark, chain, meta, logs, gone):
    names = ["aspect", "time", "volume", "inert_ratio_prnc", "tilt", "inert_ratio_raw", "inert_ratio_cvx", "frame"]
    df = spark.range(1).select(*[F.lit(1.0).alias(n) for n in names])
    m = Metadata().update({"imaging": meta} if meta else {})
    if chain:
        m.set("setup", "software version", chain)
    assert set(names) - set(defects.hide(df, m, HISTORY, logs).columns) == gone
