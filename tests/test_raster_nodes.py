"""Rasters of more nodes than the driver may hold."""

import duckdb

from flowloom.operators import density
from flowloom.plans.registry import ORACLES, QUERIES


def _rows(spark, folder, rows):
    spark.createDataFrame(rows, "event_id long, value double, user_id long, event_type string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    df = QUERIES["raster_nodes"](spark, str(folder))
    r = duckdb.sql(ORACLES["raster_nodes"].replace("FROM events", f"FROM read_parquet('{folder}/events.parquet/*.parquet')"))
    return sorted(map(tuple, df.collect()), key=str), sorted(r.select(*df.columns).fetchall(), key=str)


def test_equals_sql_on_wide_ranges(spark, tmp_path):
    rows = [(1, 0.25, 3, "view"), (2, 1234.5, 700_000, "view"), (3, 55.0, 40_000, "error")]
    got, want = _rows(spark, tmp_path / "wide", rows)
    assert got == want and len(got) == 62 * 2000
    df = spark.createDataFrame([r[:3] for r in rows], "event_idx long, deform double, area_um long")
    nodes = density.raster_nodes(df, "deform", "area_um", (20.0, 15.0))
    assert nodes.count() == 62 * 46667 > density.MAX_NODES
    assert tuple(nodes.agg({"x": "max", "y": "max"}).first()) == (1234.5, 700_000.0)


def test_equals_sql_without_events(spark, tmp_path):
    got, want = _rows(spark, tmp_path / "none", [])
    assert got == want and len(got) == 4
