"""Queries whose SQL computes in single precision, on values where that decides."""

import duckdb
import numpy as np
import pytest

from flowloom.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def thousandths(spark, tmp_path_factory):
    """Vectors of multiples of 1/1000, of which single precision holds many a little less, and multiples of 1/3000."""
    folder = tmp_path_factory.mktemp("thousandths")
    values = lambda k: [np.float32((i * 7 + k * 13) % 400 / (1000 if k % 2 else 3000)).item() for i in range(64)]
    spark.createDataFrame([(k, values(k)) for k in range(300)], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["brightness_by_name", "masked_brightness", "masked_percentiles"])
def test_equals_sql(spark, thousandths, name):
    df = QUERIES[name](spark, thousandths)
    r = duckdb.sql(ORACLES[name].replace("FROM embeddings", f"FROM read_parquet('{thousandths}/embeddings.parquet/*.parquet')"))
    assert sorted(map(tuple, df.collect())) == sorted(r.select(*df.columns).fetchall())
