"""The store of feature groups: versions, replacing, appending, statistics, shared maps."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.catalog import Metadata
from flowloom.sources import groups
from flowloom.sources.groups import GroupStore, StoreConflict, column_digest


def events(spark, n, start=0):
    return spark.range(start, start + n).select(F.col("id").alias("event_idx"), (F.col("id") * 0.5).alias("deform"), F.when(F.col("id") % 7 == 3, F.lit(float("nan"))).otherwise(-F.col("id").cast("double")).alias("area_um"), F.array(F.col("id")).alias("image"))


def rows(df):
    return sorted(map(str, df.collect()))


def test_replace_touches_one_feature_and_readers_keep_their_version(spark, tmp_path):
    path = str(tmp_path / "s")
    store = GroupStore(spark, path).append(events(spark, 100))
    before = GroupStore(spark, path)
    parts = list(before.manifest["groups"][0]["parts"])
    old = rows(before.read("deform", "area_um"))
    store.replace(events(spark, 100).select("event_idx", (F.col("deform") * 10).alias("deform")))
    assert rows(before.read("deform", "area_um")) == old  # the old version, opened before
    assert before.manifest["version"] == 1 and store.manifest["version"] == 2 and store.versions() == [1, 2]
    assert store.features["area_um"]["parts"] == parts and store.features["deform"]["parts"] != parts
    assert rows(store.read("deform")) == rows(events(spark, 100).select("event_idx", (F.col("deform") * 10).alias("deform")))
    assert rows(store.read("area_um")) == rows(events(spark, 100).select("event_idx", "area_um"))
    assert "Join" not in store.read("area_um")._jdf.queryExecution().toString()
    f = store.set_metadata(Metadata().set("experiment", "sample", "x")).frame()
    assert f.count() == 100 and f.meta.get("experiment", "sample") == "x" and "deform" in f
    assert f.with_features("deform").df.agg(F.sum("deform")).first()[0] == 10 * 0.5 * 4950
    with pytest.raises(ValueError, match="store has 100"):
        store.replace(events(spark, 99).select("event_idx", "deform"))
    with pytest.raises(ValueError, match="store has 100"):
        store.replace(events(spark, 99).union(events(spark, 1)).select("event_idx", "deform"))
    with pytest.raises(KeyError, match="tilt"):
        store.read("tilt")
    store.append(events(spark, 5, 900).drop("event_idx").withColumn("event_idx", -F.col("deform")), key="event_idx")  # any order key
    assert store.count() == 105 and store.read("deform", "area_um").where("event_idx >= 100").count() == 5
    with pytest.raises(ValueError, match="the store has"):
        store.append(events(spark, 5).drop("image"))
    assert store.expire() >= 1 and store.versions() == [store.manifest["version"]]
    assert store.read().count() == 105


def test_statistics_equal_a_scan_after_ten_appends(spark, tmp_path):
    store = GroupStore(spark, str(tmp_path / "s"))
    for k in range(10):
        store.append(events(spark, 3 + k, 100 * k).drop("image"))
    r = {x.feature: x for x in store.statistics().collect()}
    for f in ("deform", "area_um"):
        x = np.array([v[0] for v in store.read(f).select(f).collect()])
        x = x[np.isfinite(x)]
        assert (r[f].n, r[f].min, r[f].max) == (len(x), x.min(), x.max())
        assert r[f].mean == pytest.approx(x.mean(), rel=1e-14) and r[f].total == pytest.approx(x.sum(), rel=1e-14)
    assert store.count() == store.read("deform").count() == 75
    assert sorted(r[0] for r in store.read("deform").select("event_idx").collect()) == list(range(75))
    kept = store.manifest["groups"][0]["statistics"]["deform"]
    assert kept["size"] == 75 and kept["mean"] == pytest.approx(r["deform"].mean)


def test_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    GroupStore(spark, path).append(events(spark, 4))
    one, two = GroupStore(spark, path), GroupStore(spark, path)
    one._commit(one.manifest | {"meta": {"a": {}}})
    with pytest.raises(StoreConflict):
        two._commit(two.manifest | {"meta": {"b": {}}})
    assert GroupStore(spark, path).manifest["meta"] == {"a": {}}
    # an append that meets another one begins anew, and numbers on from it
    first, real = [True], GroupStore._part

    def part(self, *a):
        out = real(self, *a)
        if first.pop() if first else False:
            GroupStore(spark, path).append(events(spark, 3))
        return out

    monkeypatch.setattr(GroupStore, "_part", part)
    two.append(events(spark, 2))
    assert two.count() == 9 and sorted(r[0] for r in two.read("deform").select("event_idx").collect()) == list(range(9))


def test_maps_are_shared(spark, tmp_path):
    store = GroupStore(spark, str(tmp_path / "s")).append(events(spark, 50).drop("image"))
    at = lambda k: spark.range(50).repartition(k % 5 + 1).select(F.col("id").alias("event_idx"), (F.col("id") * k % 50).alias("basin_idx"))
    assert [store.store_map(at(k)) for k in (1, 3, 1, 3, 7)] == ["basinmap0", "basinmap1", "basinmap0", "basinmap1", "basinmap2"]
    assert store.store_map(at(3), "basinmap1") == "basinmap1"
    with pytest.raises(ValueError, match="another map"):
        store.store_map(at(9), "basinmap1")
    for k in (9, 11, 13, 17, 19, 21, 23):
        store.store_map(at(k))
    assert sorted(store.manifest["maps"]) == [f"basinmap{k}" for k in range(10)]
    with pytest.raises(ValueError, match="in use"):
        store.store_map(at(27))
    assert store.store_map(at(7)) == "basinmap2"
    assert rows(store.read("basinmap1").select("event_idx", F.col("basinmap1").alias("basin_idx"))) == rows(at(3))


def test_two_writers_of_maps(spark, tmp_path, monkeypatch):
    store = GroupStore(spark, str(tmp_path / "s")).append(events(spark, 20).drop("image"))
    at = lambda k: spark.range(20).select(F.col("id").alias("event_idx"), (F.col("id") * k % 20).alias("basin_idx"))
    first, real = [True], GroupStore._part

    def part(self, *a):
        out = real(self, *a)
        if first.pop() if first else False:
            GroupStore(spark, store.path).store_map(at(3))
        return out

    monkeypatch.setattr(GroupStore, "_part", part)
    assert store.store_map(at(7)) == "basinmap1" and sorted(store.manifest["maps"]) == ["basinmap0", "basinmap1"]
    got = store.read("basinmap0", "basinmap1")
    assert sorted(tuple(r) for r in got.collect()) == [(i, 3 * i % 20, 7 * i % 20) for i in range(20)]


def test_basins(spark, tmp_path):
    other = GroupStore(spark, str(tmp_path / "o")).append(spark.range(10).select(F.col("id").alias("event_idx"), (F.col("id") * 1.5).alias("tilt")))
    store = GroupStore(spark, str(tmp_path / "s")).append(events(spark, 6).drop("image"))
    store.set_metadata(Metadata().set("experiment", "run identifier", "abc-1"))
    mapping = spark.range(6).select(F.col("id").alias("event_idx"), (9 - F.col("id")).alias("basin_idx"))
    key = store.store_basin("other", [other.path], features=["tilt"], mapping=mapping, identifier="abc")
    assert store.store_basin("other", [other.path], features=["tilt"], mapping=mapping, identifier="abc") == key and len(store.manifest["basins"]) == 1
    assert json.loads(json.dumps(store.manifest))["basins"][key]["mapping"] == "basinmap0"
    got = GroupStore(spark, store.path).frame().with_features("basinmap0", "tilt").df
    assert sorted((r.event_idx, r.tilt) for r in got.collect()) == [(i, 1.5 * (9 - i)) for i in range(6)]
    with pytest.raises(ValueError, match="measurement is"):
        store.store_basin("other", [other.path], identifier="abc")
    with pytest.raises(ValueError, match="invalid feature"):
        store.store_basin("other", [other.path], features=["no such"])


def test_digest_depends_on_order_only(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").alias("event_idx"), (F.col("id") % 13).alias("v"))
    want = column_digest(df, "v", bits=5)
    assert column_digest(df.repartition(9), "v", bits=5) == want
    swapped = df.withColumn("v", F.when(F.col("event_idx") == 7, 8).when(F.col("event_idx") == 8, 7).otherwise(F.col("v")))
    assert column_digest(swapped, "v", bits=5) != want and column_digest(df.limit(0), "v") == column_digest(df.limit(0), "v")


def test_large_maps_are_not_gathered_on_the_driver(spark, tmp_path):
    n = 70_000  # compressed to a few bytes a row, far below Spark's threshold of 10 MB
    other = GroupStore(spark, str(tmp_path / "o")).append(spark.range(7).select(F.col("id").alias("event_idx"), (F.col("id") * 10.0).alias("tilt")))
    store = GroupStore(spark, str(tmp_path / "s")).append(events(spark, n).drop("image"))
    store.store_basin("one", [other.path], features=["tilt"], mapping=spark.range(n).select(F.col("id").alias("event_idx"), (F.col("id") % 7).alias("basin_idx")))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    got = store.frame().with_features("basinmap0").df
    assert "SortMergeJoin" in plan(got) and "Broadcast" not in plan(got)
    assert "SortMergeJoin" in plan(store.read("deform", "basinmap0")) and "Broadcast" not in plan(store.read("deform", "basinmap0"))
    both = store.frame().with_features("basinmap0", "tilt").df
    assert plan(both).count("SortMergeJoin") == 1 and plan(both).count("BroadcastExchange") == 1  # seven rows are sent
    assert both.where("deform = event_idx * 0.5 and basinmap0 = event_idx % 7 and tilt = event_idx % 7 * 10").count() == both.count() == n
