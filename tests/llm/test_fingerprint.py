import hashlib
import random
import re

from pyspark.sql import functions as F

from flowloom.llm.fingerprint import as_string, fingerprint_documents, following, likeness, merge_sketches, op4_document_fingerprints, sketch


def _words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))


def _shingles(t, n=5):
    w = _words(t)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def _edited(rows):
    texts = [t or "" for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0]))]
    ids = [i for i, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0]))]
    out = {}
    for k, (i, t) in enumerate(zip(ids, texts)):
        h = len(t) // 2
        out[i] = t[: len(t) - h] + texts[(k + 1) % len(texts)][:h]
    return out


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    edited, text = _edited(rows), dict(rows)
    got = op4_document_fingerprints(spark, sf).collect()
    assert len(got) == len(rows)
    off, prints = [], {}
    for r in got:
        assert r.n_chars == len(text[r.doc_id]) and r.edited_sha256 == hashlib.sha256(edited[r.doc_id].encode()).hexdigest()
        assert prints.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
        a, b = _shingles(text[r.doc_id]), _shingles(edited[r.doc_id])
        off.append(r.near_edited - len(a & b) / len(a | b))
    assert abs(sum(off)) / len(off) < 0.02 and sum(x * x for x in off) / len(off) < 0.02


def test_odd_rows(spark):
    rows = [(5, None), (None, "née Ab cd"), (-3, ""), (9, "one two three four five six " * 500), (7, "💡" * 7), (1 << 40, "one two"), (-(1 << 50), "x y z w v u")]
    df = spark.createDataFrame([(i, t, "k", 1.0) for i, t in rows], "doc_id long, text string, key string, near_next double")
    edited = _edited(rows)
    got = {r.doc_id: r for r in fingerprint_documents(df).collect()}
    assert {i: r.edited_sha256 for i, r in got.items()} == {i: hashlib.sha256(e.encode()).hexdigest() for i, e in edited.items()}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    assert got[5].fingerprint == got[-3].fingerprint == ""
    assert fingerprint_documents(df.limit(0)).count() == 0
    again = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "a b"), (2, "zz yy")], "doc_id long, text string")
    assert sorted(r.edited_sha256 for r in fingerprint_documents(again).where("doc_id = 2").collect()) == [hashlib.sha256(b"zz a ").hexdigest()]
    assert fingerprint_documents(again).count() == 4


def test_merge_and_likeness(spark):
    rnd = random.Random(2)
    w = [f"w{rnd.randint(0, 10**6)}" for _ in range(4000)]
    df = spark.createDataFrame([(" ".join(w[:3000]), " ".join(w[1000:]), " ".join(w))], "a string, b string, c string")
    a, b, c = (sketch(F.col(k)) for k in "abc")
    r = df.select(likeness(a, b).alias("j"), as_string(merge_sketches(a, b)).alias("m"), as_string(c).alias("all")).first()
    assert abs(r.j - 0.5) < 0.08 and r.m == r.all


def test_order_over_all_ids(spark):
    rnd = random.Random(4)
    ids = sorted({rnd.randint(-(1 << 63), (1 << 63) - 1) for _ in range(300)} | set(range(-5, 3000)))
    df = spark.createDataFrame([(i, i) for i in ids], "cell long, first long")
    assert dict(map(tuple, following(df).collect())) == dict(zip(ids, ids[1:] + ids[:1]))
