"""Polygon registry, feature origins, FCS files written by tasks, and runs joined by scans."""

import os

import pytest
from pyspark.sql import functions as F

from flowloom.catalog import Metadata
from flowloom.frame import EventFrame
from flowloom.operators import etl
from flowloom.operators.basins import Basin
from flowloom.operators.gates import Box, Polygon, PolygonIdWarning, PolygonRegistry


def test_polygon_registry():
    r = PolygonRegistry()
    square = Polygon("area_um", "deform", ((0, 0), (1, 0), (1, 1)), name="a")
    assert [r.add(square), r.add(square, 7), r.add(square)] == [0, 7, 8]
    with pytest.warns(PolygonIdWarning):
        assert r.add(square, 7) == 9
    new = r.copy(7, invert=True)
    assert new == 10 and r[new].inverted and r[new].digest != square.digest and len(r) == 5 and 7 in r
    r.remove(7)
    with pytest.raises(KeyError, match="polygon 7"):
        r[7]
    with pytest.raises(KeyError):
        r.remove(7)
    other = PolygonRegistry()
    other.add(Polygon("x", "y", ((0, 0), (1, 0), (5, 1))), 8)
    with pytest.warns(PolygonIdWarning):
        got = other.import_text(r.export_text())
    assert got == [0, 9, 10, 11] and [p.inverted for p in other.gates([0, 9, 10, 11])] == [False, False, False, True]
    r.clear()
    assert list(r) == [] and r.add(square) == 0


def test_origins(spark):
    df = spark.range(5).select(F.col("id").alias("event_idx"), F.col("id").alias("frame"), F.lit(0.5).alias("circ"), F.lit(1.0).alias("size_x"))
    side = lambda name: spark.range(5).select(F.col("id").alias("event_idx"), F.lit(2.0).alias(name))
    f = EventFrame(df, Metadata().set("imaging", "frame rate", 100), basins=(Basin(side("tilt"), kind="internal"), Basin(side("size_y"), kind="file"), Basin(side("volume"), kind="remote")))
    f = f.with_temporary("pos_x", spark.createDataFrame([(1, 3.0)], "event_idx long, value double"))
    assert f.features("innate") == ["circ", "frame", "size_x", "tilt"]
    assert f.features("basin") == ["size_y", "tilt", "volume"]
    assert f.features("temporary") == ["pos_x"]
    assert f.features("local") == ["circ", "frame", "pos_x", "size_x", "size_y", "tilt"]
    assert {"deform", "index", "time"} <= set(f.features("loaded")) and "volume" not in f.features("loaded")
    assert "deform" in f.features("ancillary") and "tilt" not in f.features("ancillary")
    assert "volume" in f.features() and f.features("scalar") == f.features()
    with pytest.raises(KeyError):
        f.features("elsewhere")


def test_fcs_files(spark, tmp_path):
    df = spark.range(25).repartition(4).select(F.col("id").alias("event_idx"), (F.col("id") * 1.5).alias("deform"), F.when(F.col("id") == 3, F.lit(float("nan"))).otherwise(F.col("id") * 2.0).alias("area_um"))
    done = etl.write_fcs_files(EventFrame(df).gate(Box("deform", 1, 100)), str(tmp_path / "f"), ["area_um", "deform"], rows=10).collect()
    want = [(2.0 * i, 1.5 * i) for i in range(25) if i not in (0, 3)]
    assert [r.events for r in done] == [10, 10, 3] and sorted(os.listdir(tmp_path / "f")) == ["part-000000.fcs", "part-000001.fcs", "part-000002.fcs"]
    got = []
    for r in done:
        names, rows = etl.read_fcs(open(r.path, "rb").read())
        assert names == ["area_um", "deform"]
        got += rows
    assert [tuple(x) for x in got] == want


def test_density_of_a_frame(spark):
    df = spark.range(40).select(F.col("id").alias("event_idx"), F.sin("id").alias("deform"), F.cos(F.col("id") * 2).alias("tilt"))
    f = EventFrame(df).gate(Box("deform", -0.9, 2))
    got = f.density_exact("deform", "tilt")
    assert got.count() == f.gated().count() and got.where("density > 0").count() == got.count()


def test_stores_of_equal_columns_are_one_scan(spark, tmp_path):
    from flowloom.sources import store

    frames, paths = [], []
    for k in range(5):
        df = spark.range(4 + k).select(F.col("id").alias("event_idx"), (F.col("id") * 0.5).alias("time"), F.col("id").alias("frame"), (F.col("id") + 1).alias("index_online"), (F.col("id") * k).cast("double").alias("deform"))
        df = df.withColumn("tilt", F.lit(1.0)) if k == 2 else df
        meta = Metadata().update({"experiment": {"date": "2020-01-01", "time": f"10:0{(3 * k) % 5}:00", "run index": 1}, "imaging": {"frame rate": 10}})
        frames.append(EventFrame(df, meta))
        paths.append(str(tmp_path / f"r{k}"))
        store.write_store(frames[-1], paths[-1], gated=False)
    one, many = etl.concatenate_stores(spark, paths), etl.concatenate(frames)
    assert one.count() == many.count() == 30 and set(one.df.columns) == set(many.df.columns)
    columns = sorted(many.df.columns)
    assert sorted(map(tuple, one.df.select(columns).collect())) == sorted(map(tuple, many.df.select(columns).collect()))
    scans = lambda f: f.df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert 5 * scans(one) == 2 * scans(etl.concatenate([store.read_store(spark, p) for p in paths]))  # two kinds of columns, five runs
    with pytest.raises(ValueError, match="twice"):
        etl.concatenate_stores(spark, paths + paths[:1])
