"""Queries of stores, files and exports: what is written to the shared folder is read back."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from flowloom.catalog import Metadata
from flowloom.frame import EventFrame
from flowloom.operators import etl
from flowloom.operators.gates import Box
from flowloom.plans.registry import query, table
from flowloom.sources import store
from flowloom.sources.contour_files import match_contours, read_contours
from flowloom.sources.footers import footers
from flowloom.sources.groups import GroupStore
from flowloom.sources.scratch import shared_folder


def _new(spark) -> GroupStore:
    return GroupStore(spark, f"{shared_folder(spark)}/flowloom-{uuid.uuid4().hex}")


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("event_idx"), F.col("value").alias("deform"), F.col("user_id").cast("double").alias("area_um"))


@query("SELECT row_number() OVER (ORDER BY event_id % 3, event_id) - 1 AS event_idx, value * 2 AS deform, user_id::DOUBLE AS area_um FROM events")
def group_replace(spark, sf_dir):
    """Three appends, then one feature replaced."""
    store, e = _new(spark), _events(spark, sf_dir)
    for k in range(3):
        store.append(e.where(F.col("event_idx") % 3 == k))
    return store.replace(store.read("deform").withColumn("deform", F.col("deform") * 2)).read("deform", "area_um")


@query("SELECT 'deform' AS feature, count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean FROM events UNION ALL SELECT 'area_um', count(user_id), min(user_id)::DOUBLE, max(user_id)::DOUBLE, round(avg(user_id), 6) FROM events")
def stored_statistics(spark, sf_dir):
    """Statistics kept with four commits, without a scan."""
    store, e = _new(spark), _events(spark, sf_dir)
    for k in range(4):
        store.append(e.where(F.col("event_idx") % 4 == k))
    return store.statistics().select("feature", "n", "min", "max", F.round("mean", 6).alias("mean"))


@query("SELECT event_id AS event_idx, event_id % 7 AS basinmap0, event_id % 5 AS basinmap1, (event_id % 7)::DOUBLE * 10 AS tilt FROM events")
def basin_maps_shared(spark, sf_dir):
    """Three basins of two maps; equal maps are stored once."""
    store, e = _new(spark), _events(spark, sf_dir)
    store.append(e)
    other = _new(spark).append(spark.range(7).select(F.col("id").alias("event_idx"), (F.col("id") * 10.0).alias("tilt")))
    for n, name in ((7, "one"), (5, "two"), (7, "three")):
        rows = e.select("event_idx", (F.col("event_idx") % n).alias("basin_idx"))
        store.store_basin(name, [other.path], features=["tilt"], mapping=rows)
    if sorted(store.manifest["maps"]) != ["basinmap0", "basinmap1"]:
        raise AssertionError("two maps were expected")
    return store.frame().with_features("basinmap0", "basinmap1", "tilt").df.select("event_idx", "basinmap0", "basinmap1", "tilt")


@query("SELECT feature, sum(n)::BIGINT AS rows FROM (SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS feature, 1 AS n FROM events) GROUP BY feature")
def footer_rows(spark, sf_dir):
    """Rows of each column by the footers of the events' files."""
    return footers(table(spark, sf_dir, "events")).groupBy("feature").agg(F.sum("rows").alias("rows"))


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/flowloom-{uuid.uuid4().hex}"


def _frame(spark, sf_dir) -> EventFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("event_idx"), F.col("value").alias("deform"), F.col("user_id").cast("double").alias("area_um"), F.array("value", F.col("user_id").cast("double")).alias("image"))
    return EventFrame(e, Metadata().set("experiment", "run identifier", "run-1"))


_KEPT = "SELECT event_id, value, user_id::DOUBLE AS area_um, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events WHERE value BETWEEN 20 AND 60"


@query(f"SELECT i AS event_idx, i + 1 AS index, event_id AS root_idx, value AS deform, area_um FROM ({_KEPT})")
def store_gated(spark, sf_dir):
    """Gated events written to a store and opened again."""
    path = _folder(spark)
    store.write_store(_frame(spark, sf_dir).gate(Box("deform", 20, 60)), path, ["deform", "area_um"])
    return store.open_dataset(spark, path).df.select("event_idx", "index", "root_idx", "deform", "area_um")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type UNION ALL SELECT 'log ' || event_type, count(*), NULL FROM events WHERE event_type = 'error' GROUP BY event_type")
def store_tables(spark, sf_dir):
    """A table and a log that travel with a store."""
    e = table(spark, sf_dir, "events")
    sums = e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    errors = e.where("event_type = 'error'").count()
    path = _folder(spark)
    store.write_store(replace(_frame(spark, sf_dir), tables={"sums": sums}, logs={"error": ["line"] * errors}), path, ["deform"], gated=False)
    back = store.open_dataset(spark, path)
    logs = spark.createDataFrame([(f"log {k}", len(v)) for k, v in back.logs.items()], "event_type string, n long").withColumn("total", F.lit(None).cast("double"))
    return back.tables["sums"].select("event_type", "n", F.round("total", 4).alias("total")).unionByName(logs)


@query("SELECT kind, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, round(sum(value), 4) AS total FROM events, (VALUES ('csv'), ('json'), ('parquet')) k(kind) GROUP BY kind")
def open_formats(spark, sf_dir):
    """The same events by each kind of file that can be opened."""
    out = None
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("event_idx"), F.col("value").alias("deform"))
    for kind in ("csv", "json", "parquet"):
        path = f"{_folder(spark)}.{kind}"
        writer = e.write.option("header", True) if kind == "csv" else e.write
        getattr(writer, kind)(path)
        f = store.open_dataset(spark, path)
        one = f.df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum("event_idx").alias("ids"), F.round(F.sum("deform"), 4).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT event_idx, event_idx + 1 AS index, deform FROM (SELECT row_number() OVER (ORDER BY event_id % 2, event_id) - 1 AS event_idx, value AS deform FROM events)")
def store_append(spark, sf_dir):
    """Two runs in one store; numbers go on."""
    path = _folder(spark)
    f = _frame(spark, sf_dir)
    for k, mode in ((0, "overwrite"), (1, "append")):
        store.write_store(replace(f, df=f.df.where(F.col("event_idx") % 2 == k)), path, ["deform"], gated=False, mode=mode)
    return store.open_dataset(spark, path).df.select("event_idx", "index", "deform")


@query("SELECT event_id AS event_idx, event_id + 1 AS index, value AS deform, user_id::DOUBLE AS area_um FROM events")
def store_copied(spark, sf_dir):
    """The scalar features of a store, copied to another; arrays stay behind."""
    first, second = _folder(spark), _folder(spark)
    store.write_store(_frame(spark, sf_dir), first, ["deform", "area_um", "image"], gated=False)
    store.copy_store(spark, first, second, "scalar")
    df = store.open_dataset(spark, second).df
    return df.select("event_idx", *sorted(c for c in df.columns if c not in ("event_idx", "root_idx")))


@query("SELECT DISTINCT event_type AS name FROM events")
def stores_found(spark, sf_dir):
    """A store for each type of event, found again under their folder."""
    folder, f = _folder(spark), _frame(spark, sf_dir)
    kinds = [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().collect()]  # a handful
    for k in kinds:
        store.write_store(replace(f, df=f.df.limit(1)), f"{folder}/{k}", ["deform"], gated=False)
    return spark.createDataFrame([(p.rsplit("/", 1)[1],) for p in store.find_measurements(spark, folder)], "name string")


@query("SELECT event_id AS event_idx, value::FLOAT::DOUBLE AS deform, user_id::FLOAT::DOUBLE AS area_um FROM events WHERE value > 5")
def fcs_files(spark, sf_dir):
    """Events written to FCS files by tasks, and read back from their bytes."""
    f = _frame(spark, sf_dir)
    folder = _folder(spark)
    f = replace(f, df=f.df.withColumn("frame", F.col("event_idx").cast("double")))
    etl.write_fcs_files(f.gate(Box("deform", 5.000001, 1e9)), folder, ["area_um", "deform", "frame"], rows=3000)

    def read(tables):
        import pandas as pd

        for t in tables:
            for data in t.content:
                _, rows = etl.read_fcs(data)
                yield pd.DataFrame(rows, columns=["area_um", "deform", "frame"])

    rows = spark.read.format("binaryFile").load(folder).select("content").mapInPandas(read, "area_um double, deform double, frame double")
    return rows.select(F.col("frame").cast("bigint").alias("event_idx"), "deform", "area_um")


_LOST = "(SELECT max(event_id) // 3 FROM events), (SELECT max(event_id) // 2 FROM events)"


@query(f"SELECT event_id AS event_idx, CASE WHEN event_id IN ({_LOST}) THEN 'guess' ELSE 'frame' END AS status, 3 * event_id + 7 AS frame, CASE WHEN event_id NOT IN ({_LOST}) THEN 3 * event_id + 7 END AS contour_frame FROM events")
def contour_files(spark, sf_dir):
    """A file of contours, two of which are missing, matched with the events by frame."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("event_idx"), (F.col("event_id") * 3 + 7).alias("frame"))
    last = e.agg(F.max("event_idx")).first()[0]
    kept = e.where(~F.col("event_idx").isin(last // 3, last // 2))
    text = F.concat(F.lit("Contour in frame "), F.col("frame"), F.lit("\n(1, "), F.col("event_idx") % 50, F.lit(")\n(9, 4)\n"))
    path = _folder(spark)
    kept.orderBy("event_idx").select(text.alias("value")).write.text(path)
    got = match_contours(e, read_contours(spark, path))
    found = F.when(F.col("status") == "frame", F.col("contour_frame"))
    return e.join(got.select("event_idx", "status", found.alias("contour_frame")), "event_idx").select("event_idx", "status", "frame", "contour_frame")
