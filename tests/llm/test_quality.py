import zlib

import pytest

from flowloom.llm.quality import classify, keep_good, op5_quality_classifier, train


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = op5_quality_classifier(spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    for r in got.limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5)


def test_odd_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (None, "a b", None), (3, "the cat. " * 5000, 1.0), (3, "the cat", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(2, None), (None, 1)], "doc_id long, quality int")
    model = train(docs, labels, buckets=1 << 10)
    rows = classify(docs, model).collect()
    assert len(rows) == 5 and all(r.score == pytest.approx(0.5) for r in rows)
    kept = keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == 5
    assert classify(docs.limit(0), model).count() == 0


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "### ### $$$") for i in range(300)], "doc_id long, text string")
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    true = [(i, i % 2) for i in range(300) if i not in held]
    a = train(docs, spark.createDataFrame(true, "doc_id long, quality int"), buckets=1 << 10)
    b = train(docs, spark.createDataFrame(true + [(i, 1 - i % 2) for i in held], "doc_id long, quality int"), buckets=1 << 10)
    assert (a[0] == b[0]).all() and a[1] == b[1]
    assert all(r.predicted == r.doc_id % 2 for r in classify(docs, a).collect())
