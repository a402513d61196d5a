"""Names, labels, converters and the store's numbering."""

from __future__ import annotations

import pytest

from flowloom.catalog import SCALAR_LABELS, Catalog, parse_bool_or_float, parse_int
from flowloom.operators import basins as B
from flowloom.operators import etl
from flowloom.frame import EventFrame
from flowloom.catalog import Metadata
from flowloom.sources.store import open_dataset, read_store, write_store

# Labels as users know them, one or more of each kind.
LABELS = {
    "area_um": "Area [µm²]", "area_um_raw": "Area [µm²] of raw contour", "fl2_max_ctc": "FL-2 maximum, crosstalk-corrected [a.u.]",
    "fl3_dist": "FL-3 distance between two first peaks [µs]", "flow_rate": "Flow rate [µLs⁻¹]", "index": "Index (Dataset)",
    "bright_perc_10": "10th Percentile of brightness (bgc)", "per_ratio": "Inverse Convexity (raw to convex perimeter ratio)",
    "tex_f12_ptp": "Texture First measure of correlation (ptp)", "qpi_ri_sd": "DEPRECATED Refractive index (SD)", "ml_score_a1b": "ML score A1B",
    "mask": "Binary mask labeling the event in the image", "userdef3": "User-defined 3", "basinmap9": "Basin mapping 9",
}


def test_labels():
    c = Catalog()
    assert {n: c.label(n) for n in LABELS} == LABELS
    assert c.label("area_um", unit=False) == "Area" and c.label("area_um_raw", unit=False) == "Area [µm²] of raw contour"
    assert len(SCALAR_LABELS) == 96 and len(c.scalar) == 116 and len(c.other) == 9


def test_converters():
    assert [parse_int(v) for v in ("true", "False", "3.7", 2.9, True)] == [1, 0, 3, 2, 1]
    assert parse_bool_or_float(0) is False and parse_bool_or_float("true") is True and parse_bool_or_float(0.5) == 0.5
    assert Metadata().set("pipeline", "dcnum yield", "12").get("pipeline", "dcnum yield") == 12


def test_append_continues_after_one_event(spark, tmp_path):
    one = open_dataset(spark, {"deform": [0.25]})
    for mode in ("overwrite", "append", "append"):
        write_store(one, str(tmp_path / "s"), mode=mode)
    rows = read_store(spark, str(tmp_path / "s")).df.orderBy("event_idx").collect()
    assert [(r.event_idx, r["index"]) for r in rows] == [(0, 1), (1, 2), (2, 3)]


def test_features_of_one_basin_are_joined_once(spark):
    side = spark.createDataFrame([(0, 1.0, 2.0, 3.0)], "event_idx long, area_um double, volume double, tilt double")
    f = EventFrame(spark.createDataFrame([(0, 0.5)], "event_idx long, deform double"), basins=(B.Basin(side),))
    out = f.with_features("area_um", "volume", "tilt").df
    assert out.select("area_um", "volume", "tilt").first() == (1.0, 2.0, 3.0)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_ranks_of_sparse_keys(spark):
    from flowloom.operators.sample import with_rank

    keys = [-(1 << 62), -5, 0, 3, 1 << 20, 1 << 40, (1 << 40) + 1, (1 << 62) + 7]
    df = spark.createDataFrame([(g, k) for k in keys for g in ("a", "b")], "g string, k long")
    got = sorted((r.g, r["_rank"], r.k) for r in with_rank(df, "k", by=("g",)).collect())
    assert got == sorted((g, i, k) for i, k in enumerate(keys) for g in ("a", "b"))


@pytest.mark.parametrize("n", [1, 3])
def test_concatenate_is_one_plan(spark, n):
    runs = [EventFrame(spark.createDataFrame([(0, 0.0, 1), (1, 0.5, 4)], "event_idx long, time double, index_online long"), Metadata().update({"experiment": {"date": "2020-01-01", "time": f"10:00:0{k}", "run index": 1}})) for k in range(n)]
    rows = etl.concatenate(runs).df.orderBy("event_idx").collect()
    assert [(r.event_idx, r.time, r.index_online) for r in rows] == [(2 * k + i, k + 0.5 * i, 5 * k + 1 + 3 * i) for k in range(n) for i in range(2)]


def test_exact_quantiles_take_over_in_large_tables(spark):
    from flowloom.operators import stats

    df = spark.range(1000).selectExpr("cast(id as double) as tilt")
    a, b = ({(r.method): r.value for r in stats.describe(df, ["tilt"], exact_rows=k).collect()} for k in (10, 5000))
    assert a == b and a["25th Percentile"] == 249.75
