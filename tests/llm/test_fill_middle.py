"""Fill-in-middle against a plain brute force, and the learned index against the offsets themselves."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowloom.llm.fill_middle import RankIndex, fill_in_middle, restored
from pyspark.sql import functions as F


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300), st.sampled_from([1, 16, 1024]))
def test_index_is_exact(steps, error):
    y = np.cumsum(np.array(steps, np.int64))
    index = RankIndex(y, error)
    ranks = np.arange(len(y))
    assert (index[ranks] == y).all()
    assert len(y) == 0 or np.abs(index.residuals).max() <= error + 1


def test_index_is_small_and_piecewise():
    y = np.cumsum(np.random.default_rng(5).integers(20, 140, 200_000))
    index = RankIndex(y, 1024)
    assert 1 < len(index.starts) < len(y) / 100
    assert (index[np.arange(len(y))] == y).all()
    assert len(RankIndex(np.arange(0, 10**6, 7)).starts) == 1  # one line, one segment


def brute(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", "\n", "\n\n\n", "a", "a\nb", "a\nb\n", "é\nü<\n𝄞 x\r\ny\n", "x <P> y\nz", "<M>", "<\nP>\n<S\n>M>", "tab\tß\n" * 3000, "no end " * 9000, "z\n" * 40_000]


@pytest.mark.parametrize("seed,rate,spm", [(7, 100, 50), (1, 60, 10)])
def test_against_brute_force(spark, seed, rate, spm):
    rows = [(k if k % 9 else None, TEXTS[k % len(TEXTS)], "o") for k in range(140)] + [(3, "a\nb", "o")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string").repartition(3)  # a clashing name
    done = fill_in_middle(docs, seed, rate, spm)
    got = sorted((tuple(r) for r in done.withColumn("back", restored(F.col("output"), F.col("form"))).collect()), key=str)
    want = sorted(((i, *brute(i, t, seed, rate, spm), t or "") for i, t, _ in rows), key=str)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_slices_of_a_batch(spark, monkeypatch):
    import pyarrow as pa

    from flowloom.llm import fill_middle

    monkeypatch.setattr(fill_middle, "_SLICE", 40)
    ids, texts = list(range(30)), [("ab\n" * (k % 7) + "c" * (k % 3)) * (1 + 20 * (k == 11)) for k in range(30)]
    array = pa.array(["skipped", *texts])[1:]
    assert list(fill_middle.rearrange(array, ids)) == [brute(i, t) for i, t in zip(ids, texts)]


def test_empty_table_and_text_ids(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert fill_in_middle(docs).collect() == []
    assert tuple(fill_in_middle(spark.createDataFrame([("a/1", "x\ny\n")], "doc_id string, text string")).first()) == ("a/1", *brute("a/1", "x\ny\n"))
