import hashlib
import random
from collections import defaultdict

import xxhash

from flowloom.llm import line_dedup
from flowloom.llm.line_dedup import drop_recurring_lines, op9_line_dedup

LONG = "All rights reserved by the maker number {} of this fine page"


def _parse(line):
    tokens = ["<*>" if any(c.isdecimal() for c in t) else t for t in line.split()]
    return tuple(tokens) if set(tokens) - {"<*>"} else None


def _order(tokens):
    h = xxhash.xxh3_64_intdigest(" ".join(tokens).encode())
    return h - (1 << 64) if h >> 63 else h


def _brute(rows, similarity=0.7, min_docs=2, leaf=2048):
    """The rule written out anew, for every document."""
    leaves = defaultdict(set)
    for _, t in rows:
        for x in (t or "").split("\n"):
            if p := _parse(x):
                leaves[len(p), p[:3]].add(p)
    depth = 3
    while any(len(v) > leaf for v in leaves.values()):
        now = defaultdict(set)
        for k, v in leaves.items():
            for p in v:
                now[(*k, p[depth : 2 * depth]) if len(v) > leaf else k].add(p)
        leaves, depth = now, 2 * depth
    template, kinds = {}, 0
    for v in leaves.values():
        found = []
        for p in sorted(v, key=_order):
            best = max(found, key=lambda t: sum(a == b != "<*>" for a, b in zip(t[1], p)), default=None)
            if best and sum(a == b != "<*>" for a, b in zip(best[1], p)) >= (similarity if len(p) >= 5 else 1) * len(p):
                best[1][:] = [a if a == b else "<*>" for a, b in zip(best[1], p)]
            else:
                kinds += 1
                found.append(best := (kinds, list(p)))
            template[p] = best[0]
    where = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if p := _parse(x):
                where[template[p]].add(-(1 << 63) if i is None else i)
    out = []
    for i, t in rows:
        own = -(1 << 63) if i is None else i
        kept = [x for x in (t or "").split("\n") if not (p := _parse(x)) or len(w := where[template[p]]) < min_docs or min(w) == own]
        out.append((i, None if t is None else "\n".join(kept)))
    return sorted(out, key=str)


def _rows():
    rows = [(i, f"{chr(97 + i)} starts off its own line of words\n{LONG.format(i * 7)}\nshort line\n\nsame words in every single document") for i in range(12)]
    rows += [(20, None), (21, ""), (22, "same words in every single document\n" * 3), (None, "same words in every single document\nx"), (3, rows[3][1])]
    return rows + [(30, "the quick brown fox jumps over a lazy dog today"), (31, "the quick brown fox jumps over a sleepy dog today"), (32, "the quick brown cat sits under no sleepy dog now")]


def test_equals_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame([(i, t, "k", 5) for i, t in rows], "doc_id long, text string, line string, final int")
    want = _brute(rows)
    for sent in (10**6, 0):  # leaves sent to the tasks, leaves joined
        got = drop_recurring_lines(df, max_sent=sent)
        assert got.columns == df.columns
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == want
    texts = dict(want)
    assert texts[5] == "f starts off its own line of words\n" and "maker" not in texts[1] and texts[31] == ""
    assert drop_recurring_lines(df.limit(0)).count() == 0


def test_short_lines_go_and_numbers_stay(spark):
    rows = [(1, "Accept all cookies\nShare on X\n12\nPage 3 of 9\nown one"), (2, "Accept all cookies\nShare on Y\n12\nPage 4 of 9\nown two")]
    df = spark.createDataFrame([(*r, 99, 7) for r in rows], "doc_id long, text string, _doc int, _gone int")
    out = drop_recurring_lines(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text, r._doc, r._gone) for r in out.collect()) == [(1, rows[0][1], 99, 7), (2, "Share on Y\n12\nown two", 99, 7)]


def test_large_leaves_are_split(spark):
    """Results follow from the lines alone, in large leaves as in small ones."""
    tail = lambda k: " ".join(f"{chr(97 + k % 5)}{chr(97 + k // 5 % 7)}" for _ in range(2)) + f" {chr(97 + k % 11)} {chr(97 + k % 3)} end"
    rows = [(k, f"one two three {tail(k)}\none two three {tail(k + 3)}") for k in range(80)] + [(90, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for leaf in (2048, 8, 1):
        got = sorted(((r.doc_id, r.text) for r in drop_recurring_lines(df.repartition(3), leaf=leaf).collect()), key=str)
        assert got == _brute(rows, leaf=leaf)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in _brute(rows)}
    got = op9_line_dedup(spark, d).collect()
    assert {r.doc_id: r.kept_sha256 for r in got} == want and len(got) == len(rows)


def test_other_lines_of_a_leaf_change_nothing(spark):
    """Two lines of one template stay that, however many other lines have their leading tokens."""
    pair = [(1, "error reading file alpha from the main disk of this host"), (2, "error reading file beta from the main disk of this host")]
    others = [f"error reading file {' '.join(hashlib.sha256(f'{k} {j}'.encode()).hexdigest()[:6].translate(str.maketrans('0123456789', 'ghijklmnop')) for j in range(8))}" for k in range(2100)]
    rows = [*pair, (3, "\n".join(others[:1050])), (4, "\n".join(others[1050:]))]
    for some in (pair, rows):
        got = {r.doc_id: r.text for r in drop_recurring_lines(spark.createDataFrame(some, "doc_id long, text string")).collect()}
        assert got[1] == pair[0][1] and got[2] == ""
    assert sorted(got.items()) == _brute(rows, leaf=10**9)


def test_indexed_templates_equal_all_compared(monkeypatch):
    """In leaves of many templates, of few different tokens and with fields, each line joins the same one."""
    rng = random.Random(4)
    for n, words in ((4, 8), (6, 6), (9, 3), (14, 2)):
        lines = list(dict.fromkeys(" ".join(rng.choice(["<*>", *"abcdefghij"[:words]]) for _ in range(n)) for _ in range(900)))
        made = []
        for few in (10**9, 5):
            monkeypatch.setattr(line_dedup, "FEW", few)
            leaf = line_dedup.Leaf(0.7)
            made.append([leaf.add(k, x) for k, x in enumerate(lines)])
        assert made[0] == made[1] and 5 < len(set(made[0]))
