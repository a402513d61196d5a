import numpy as np
import pandas as pd
import pytest

from flowloom import cli
from flowloom.catalog import Metadata
from flowloom.frame import EventFrame
from flowloom.sources import store


@pytest.fixture
def stores(spark, tmp_path):
    paths = []
    for k, time in enumerate(("10:00:05", "10:00:00")):
        df = spark.createDataFrame(pd.DataFrame({"event_idx": np.arange(50), "frame": np.arange(50) * 10, "time": np.arange(50) / 10, "circ": np.linspace(0.5, 1, 50), "size_x": 2.0, "size_y": 1.0, "image": [[1, 2]] * 50}))
        meta = Metadata().update({"experiment": {"date": "2020-02-02", "time": time, "sample": f"s{k}", "run index": k}, "imaging": {"frame rate": 100}})
        store.write_store(EventFrame(df, meta, logs={"l": ["x"]}), str(tmp_path / f"in{k}"), gated=False)
        paths.append(str(tmp_path / f"in{k}"))
    return paths


def test_tasks(spark, stores, tmp_path):
    out = lambda n: str(tmp_path / n)
    assert cli.run(spark, ["join", *stores, "-o", out("joined")]) == 0
    j = store.read_store(spark, out("joined"))
    assert j.df.count() == 100 and j.meta.get("experiment", "sample") == "s1" and "src-#1_l" in j.logs
    assert j.df.where("event_idx = 50").first().time == pytest.approx(5.0) and j.df.where("event_idx = 50").first().frame == 500
    assert cli.run(spark, ["split", out("joined"), "--split-events", "40", "--path_out", out("parts")]) == 0
    assert [store.read_store(spark, out(f"parts/000{k}")).df.count() for k in (1, 2, 3)] == [40, 40, 20]
    assert store.read_store(spark, out("parts/0003")).meta.get("experiment", "sample") == "s1 3/3"
    assert cli.run(spark, ["condense", stores[0], out("small")]) == 0
    small = store.read_store(spark, out("small"))
    assert {"deform", "aspect"} <= set(small.df.columns) and "image" not in small.df.columns
    assert cli.run(spark, ["repack", stores[0], out("bare"), "--strip-logs"]) == 0 and not store.read_store(spark, out("bare")).logs
    assert cli.run(spark, ["compress", stores[0], out("again")]) == 0
    assert cli.run(spark, ["verify", stores[0]]) == 2 and cli.run(spark, ["verify", out("none")]) == 4
