import random

from flowloom.llm.decontaminate import brute_force, contamination_report, drop_contaminated

DOCS = "doc_id long, text string, source string, item_id long, n_words long"


def _case():
    rnd = random.Random(3)
    word = lambda: rnd.choice(["Ab", "c1", "é", "Ü", "zz", "q", "don't"])
    items = [(i, " ".join(word() for _ in range(rnd.choice([0, 1, 3, 12, 13, 14, 30])))) for i in range(12)] + [(99, None), (7, "only here now"), (None, "nameless item words")]
    docs = []
    for k in range(60):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 40)))]
        if k % 2:
            t = rnd.choice(items)[1] or ""
            parts.insert(rnd.randint(0, 1), t.upper() if k % 3 else t.replace(" ", " -- "))
        docs.append((k, " , ".join(parts), "s", 1, 2))
    return docs + [(60, None, None, None, None), (None, "", None, None, None), (3, docs[3][1], "again", 1, 2), (61, "nameless ITEM words", "s", 1, 2)], items


def test_report_equals_brute_force(spark):
    docs, items = _case()
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    named = [("" if i is None else str(i), t) for i, t in items]
    want = sorted((str(r[0]), *brute_force(r[1], named)) for r in docs)
    for block in (10**6, 40):  # one automaton, several automata
        got = contamination_report(d, b, block_words=block).collect()
        assert sorted((str(r[0]), *r[1:6]) for r in got) == want


def test_spans_lie_in_the_original(spark):
    d = spark.createDataFrame([(1, "Ünï! The CAT, sat. on the mat; today", "", 0, 0)], DOCS)
    b = spark.createDataFrame([(5, "cat sat on THE mat")], "item_id long, text string")
    (row,) = contamination_report(d, b).collect()
    assert [d.first().text[a:z] for a, z in row.spans] == ["CAT, sat. on the mat"] and row.n_hit == 5


def test_drop_keeps_columns_and_clean_rows(spark):
    docs, items = _case()
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    named = [("" if i is None else str(i), t) for i, t in items]
    want = sorted((r for r in docs if not brute_force(r[1], named)[-1]), key=str)
    for block in (10**6, 40):
        kept = drop_contaminated(d, b, block_words=block)
        assert kept.columns == d.columns and sorted(map(tuple, kept.collect()), key=str) == want


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert contamination_report(d, b).count() == 0
    one = spark.createDataFrame([(1, "a b", "", 0, 0)], DOCS)
    assert contamination_report(one, b).first().n_hit == 0 and drop_contaminated(one, b).count() == 1


def test_long_items_are_cut_into_parts(spark):
    rnd = random.Random(8)
    words = [f"w{rnd.randint(0, 300)}" for _ in range(900)]
    items = [(1, " ".join(words)), (2, "w1 w2")]
    docs = [(k, " ".join(words[a : a + n])) for k, (a, n) in enumerate([(0, 13), (5, 12), (90, 40), (880, 20), (0, 900), (95, 13)])] + [(9, "w1 w2 w3")]
    got = contamination_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=100).collect()
    assert sorted((r.doc_id, *r[1:6]) for r in got) == sorted((i, *brute_force(t, [(str(a), b) for a, b in items])) for i, t in docs)


def test_memory_of_an_automaton_is_bounded():
    """A block of BLOCK_WORDS words that share no window, in a process of its own."""
    import subprocess
    import sys

    code = """
import random, resource
from flowloom.llm.decontaminate import BLOCK_WORDS, WindowAutomaton
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rnd = random.Random(1)
WindowAutomaton([(str(i), " ".join(f"w{rnd.randint(0, 30000)}" for _ in range(BLOCK_WORDS // 300))) for i in range(300)], 13)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    kb = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert kb < 300_000
