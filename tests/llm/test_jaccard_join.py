import random

from flowloom.llm.graph import components
from flowloom.llm.jaccard_join import brute_force, keep_one_of_each, link_documents, op7_ngram_jaccard_join


def _rows():
    rnd = random.Random(6)
    word = lambda: f"w{rnd.randint(0, 4000)}"
    rows = []
    for g in range(12):
        base = [word() for _ in range(rnd.choice([3, 30, 200]))]
        for _ in range(rnd.choice([1, 2, 9])):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, len(base) // 30 + 1])):
                own[rnd.randrange(len(own))] = word()
            rows.append((len(rows) * 3, " ".join(own)))
    rows += [(1, None), (2, ""), (4, " -- "), (5, "one"), (7, "One."), (None, rows[0][1]), (rows[1][0], rows[1][1])]
    return rows


def test_equals_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame([(i, t, b"x", 1) for i, t in rows], "doc_id long, text string, sig binary, n long")
    want = sorted(brute_force(rows), key=str)
    for limit, block, sent in ((256, 512, 10**6), (2, 2, 0)):  # small buckets only; split ones, blocks, joined sets
        got = link_documents(df, recall=0.9999, limit=limit, block=block, max_sent=sent)
        assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got.collect()), key=str) == want


def test_keep_one(spark):
    rows = _rows()[:-1]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, rep string")
    kept = keep_one_of_each(df, recall=0.9999)
    assert kept.columns == df.columns
    wordless = {1, 2, 4}
    want = sorted((str(i) for i, c, _ in brute_force(rows) if i == c or i in wordless))
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_keep_one_with_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, a), (1, b), (2, a), (3, None), (3, None)]
    kept = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), recall=0.9999)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, a), (1, b), (3, None), (3, None)], key=str)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {(r.doc_id, r.class_id, r.n_links) for r in op7_ngram_jaccard_join(spark, sf).collect()}
    assert got == set(brute_force(rows))


def test_empty_and_components(spark):
    assert link_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rnd = random.Random(1)
    chain = list(range(200))
    rnd.shuffle(chain)
    edges = list(zip(chain[:-1], chain[1:])) + [(1000, 1001), (1001, 1000), (5000, 5000)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(200)}, 1000: 1000, 1001: 1000}


def test_recall_near_the_threshold(spark):
    """Pairs with similarities from 0.80 to 0.85 are linked, at the default options; those a little below are not."""
    import random

    rnd = random.Random(4)
    rows, near, below = [], 0, 0
    for k in range(400):
        words = [f"w{k}x{i}" for i in range(rnd.randint(120, 400))]
        # a cut of s words at the end leaves n - 4 - s of n - 4 shingles
        n = len(words) - 4
        share = rnd.uniform(0.80, 0.85) if k % 4 else rnd.uniform(0.70, 0.79)
        keep = -(-int(share * n * 10**6) // 10**6) if k % 4 == 0 else min(n, int(share * n) + 1)
        near, below = near + (k % 4 > 0), below + (k % 4 == 0)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: keep + 4]))]
    got = {r.doc_id: r.class_id for r in link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [got[2 * k + 1] == 2 * k for k in range(400)]
    assert sum(x for k, x in enumerate(linked) if k % 4) >= 0.9 * near
    assert not any(x for k, x in enumerate(linked) if k % 4 == 0)


def test_columns_with_the_names_of_helpers_stay(spark):
    from flowloom.llm.jaccard_join import keep_one_of_each

    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text, 99, 7), (2, text, 98, 6)], "doc_id long, text string, _doc int, _row int")
    assert [tuple(r) for r in keep_one_of_each(df).collect()] == [(1, text, 99, 7)]
    twice = spark.createDataFrame([(1, text, 99, 7), (1, text, 99, 7)], df.schema)
    assert [tuple(r) for r in keep_one_of_each(twice).collect()] == [(1, text, 99, 7)]
