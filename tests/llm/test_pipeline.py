import corpus_pipeline
from flowloom.llm.decontaminate import brute_force as contaminated
from flowloom.llm.jaccard_join import brute_force as linked
from flowloom.llm.line_dedup import parse
from tokenizers import Tokenizer

from flowloom.llm.bpe import default_vocabulary

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes
        steps[name] = (docs.collect(), out.collect())
        docs = out

    before, after = steps["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    known = [r.doc_id for r in before if r.doc_id in labels]
    assert sum((i in kept) == bool(labels[i]) for i in known) >= 0.95 * len(known)

    before, after = steps["line_dedup"]
    old = {r.doc_id: r.text for r in before}
    assert len(after) == len(before) and all(r.n_chars == len(r.text) for r in after)
    for r in after:
        gone = [x for x in old[r.doc_id].split("\n") if x not in r.text.split("\n")]
        assert all(parse(x, 3) for x in gone)

    before, after = steps["near_duplicates"]
    assert sorted(r.doc_id for r in after) == sorted(i for i, c, _ in linked([(r.doc_id, r.text) for r in before]) if i == c)

    before, after = steps["decontamination"]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not contaminated(r.text, items)[-1])

    before, after = steps["bpe_encode"]
    lib = Tokenizer.from_file(default_vocabulary())
    want = {r.doc_id: lib.encode(r.text, add_special_tokens=False).ids for r in before}
    assert {r.doc_id: list(r.ids) for r in after} == want
    assert corpus_pipeline.run(spark, SF).count() == len(after)


def test_shared_passages_go_from_all_but_true_copies(spark):
    def lines(who, n):
        return [f"{who}{k} opens " + " ".join(f"{who}{k}word{chr(97 + j)}" for j in range(10)).replace("0", "x").replace("1", "y") for k in (chr(97 + i) for i in range(n))]

    a, b, own, more = lines("a", 8), lines("b", 8), lines("c", 2), lines("d", 3)
    texts = {1: a, 2: b, 3: a[:4] + b[:4] + own, 4: a, 5: a[:4] + b[:4] + own, 6: a[:7] + [a[7][:-1] + "z"], 7: a[:5] + more, 8: a[4:] + b[4:]}
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in texts.items()], "doc_id long, text string")
    cut = corpus_pipeline.line_dedup(spark, docs, SF)
    got = {r.doc_id: r.text for r in cut.collect()}
    whole = {i: "\n".join(texts[i]) for i in (1, 2, 4, 6)}
    assert got == whole | {3: "\n".join(own), 5: "", 7: "\n".join(more), 8: ""}
    # Brute force: what near-duplicate removal leaves holds each line once.
    rows = [(i, t) for i, t in got.items()]
    kept = [i for i, c, _ in linked(rows) if i == c or not got[i]]
    assert kept == [1, 2, 3, 5, 7, 8]
    left = [x for i in kept for x in got[i].split("\n") if parse(x, 3)]
    assert len(left) == len(set(left)) == len(a + b + own + more)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, cut, SF).collect()) == kept


def test_clashing_names_and_nulls(spark):
    line = "the same passage of many words stands in every one of these documents today"
    rows = [(1, f"{line}\nalpha opens here", 5, "a", 0.5), (2, f"{line}\nbeta goes on there", None, None, 0.25), (3, None, 0, "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `_whole` int, rest string, `_lost` double")
    got = sorted(map(tuple, corpus_pipeline.line_dedup(spark, docs, SF).collect()))
    assert got == [rows[0], (2, "beta goes on there", None, None, 0.25), rows[2]]


def test_a_repeated_id_changes_no_other_document(spark, sf):
    """Documents 1 and 4 are copies and 9 has nothing to do with them, whether it is there once or twice."""
    lines = [f"line number {i} of the copied document says {w} things about {v}" for i, (w, v) in enumerate(zip("many few odd new old good".split(), "cats dogs birds fish trees stones".split()))]
    rows = [(1, "\n".join(lines)), (4, "\n".join(lines)), (9, "quite another text\nwith two lines")]

    def cut(table):
        got = corpus_pipeline.line_dedup(spark, spark.createDataFrame(table, "doc_id long, text string"), sf).collect()
        return sorted((r.doc_id, r.text) for r in got)

    once, twice = cut(rows), cut([*rows, rows[2]])
    assert [r for r in twice if r[0] != 9] == [r for r in once if r[0] != 9] == rows[:2]
    assert [i for i, _ in cut([*rows, rows[1]])] == [1, 4, 4, 9]
