import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from flowloom.llm import lm_score
from flowloom.llm.lm_score import END, EXPLICIT, TAIL_CLASSES, Batch, Lexicon, Model, _add_rows, _bases, _ending, class_part, op8_lm_scores, score_texts, weigh


def _words(t):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [" "]


def _base(rows):
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode())
    c = Counter(w for i, t in rows if crc(i) % 7 != 2 for w in _words(t))
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in rows:
        w = _words(t)
        out.setdefault(i, []).append((crc(i) % 7 == 2, len(w), sum(x in c for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    return out


def _check(got, rows):
    want = _base(rows)
    assert len(got) == len(rows)
    for r in got:
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and r.base_score == pytest.approx(w[4], rel=1e-9) for w in want[r.doc_id])
        assert r.score < 0 and math.isfinite(r.score)


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = op8_lm_scores(spark, d).collect()
    _check(got, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("head", [1 << 18, 3, 0])
def test_odd_rows_and_small_heads(spark, head):
    rows = [(i, t) for i, t in enumerate(["A b\x1cc b", None, "", "é É\x0bz　z", "word " * 3000, "b a", "new\nwords", "b b c", "Ünder the"] * 3)] + [(None, "a b"), (0, "A b\x1cc b")]
    df = spark.createDataFrame([(i, t, 1.0, "r") for i, t in rows], "doc_id long, text string, score double, rare string")
    _check(score_texts(df, head=head).collect(), rows)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert score_texts(df).count() == 0
    only = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = score_texts(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and math.isfinite(row.score)


@pytest.mark.parametrize("before", ["w5 w9", "w900 w5", "w5 w900", "w5 w2100"])
def test_probabilities_sum_to_one(before):
    """Over all words and one unknown word of each tail class, after hot, explicit and other tokens."""
    rnd = np.random.RandomState(1)
    words = [END] + [f"w{k}".encode() for k in range(EXPLICIT + 300)]
    counts = sorted(rnd.randint(1, 500, len(words)).tolist(), reverse=True)
    tail = [0] * TAIL_CLASSES
    for w, c in zip(words[EXPLICIT:], counts[EXPLICIT:]):
        tail[_ending(w)] += c + 1
    lex = Lexicon(words, counts, sum(counts), len(words), tail, [0] * TAIL_CLASSES, [0] * TAIL_CLASSES).ready()
    model = Model(lex, 1 << 8)
    model.table[:] = rnd.normal(size=model.table.shape)
    unknown, k = {}, 0
    while len(unknown) < TAIL_CLASSES:
        unknown.setdefault(_ending(f"u{k}".encode()), f"u{k}")
        k += 1
    learned = [f"{before} w{k}" for k in (1, 1, 1, 7, 100, 1500, 2200, 2200)] + [f"{before.split()[1]} w{k} w3" for k in (2, 150, 2250)]
    asked = [f"{before} {w}" for w in [*[w.decode() for w in words[1:]], *unknown.values()]] + [before]
    for t in learned:
        for a, b in zip(["", *t.split()], t.split()):
            if a and (i := lex.codes.get(a.encode(), 1 << 40)) < lex.hot and (j := lex.codes.get(b.encode(), 1 << 40)) < lex.hot:
                model.pairs[i, j] += 1
    model.settle_pairs(lex)
    b = Batch(lex, learned + asked)
    known, rest, context, word, skipped, after = class_part(lex, model, b)
    which = np.repeat(np.arange(len(b.sizes)), b.sizes)[rest]
    known[rest] += weigh(context.astype(np.uint32), word, skipped, _bases(lex, model, word, skipped, after), which < len(learned))
    last = (np.cumsum(b.sizes) - b.sizes)[len(learned) :] + 2
    assert np.exp(known[last]).sum() == pytest.approx(1, abs=1e-4)
    assert known[last[lex.codes[b"w1"] - 1]] > known[last[lex.codes[b"w20"] - 1]] + 1


def test_gradient_sums_above_65536_rows():
    rnd = np.random.RandomState(3)
    table, want = np.zeros((1 << 18, 3), np.float32), np.zeros((1 << 18, 3), np.float32)
    at, rows = np.concatenate([rnd.randint(0, 1 << 18, 5000), [0, 1 << 16, 0, 1 << 16, 0], np.full(40, 7)]), rnd.rand(5045, 3).astype(np.float32)
    _add_rows(table, at, rows)
    np.add.at(want, at, rows)
    assert table == pytest.approx(want, rel=1e-5)


def test_better_than_a_bigram(spark):
    """Held-out log probability a token, against a 2-gram with absolute discounting on the unigram base."""
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    one, two, m, k = Counter(), Counter(), Counter(), Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            w = _words(t)
            one.update(w)
            two.update(zip([" ", *w], w))
    for (a, _), n in two.items():
        m[a] += n
        k[a] += 1
    total, v, rival, tokens = sum(one.values()), len(one), 0.0, 0
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 == 2:
            w = _words(t)
            tokens += len(w)
            for a, b in zip([" ", *w], w):
                base = (one[b] + 1) / (total + v + 1)
                rival += math.log10(max(two[a, b] - 0.75, 0) / m[a] + 0.75 * k[a] / m[a] * base if m[a] else base)
    held = op8_lm_scores(spark, d).where("held_out").collect()
    assert sum(r.n_tokens for r in held) == tokens
    assert sum(r.score for r in held) / tokens > rival / tokens + 0.05


def test_dealing_does_not_change_scores(spark):
    """Small parts and small deals give the scores that one part gives."""
    rows = [(i, f"a{i % 7} b{i % 3} the the cat a{i % 5} x{i}") for i in range(120)] + [(500, "word " * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    a, b = ({r.doc_id: r.score for r in score_texts(df, dealt=n, part_tokens=p).collect()} for n, p in ((1 << 19, 1 << 20), (100, 50)))
    assert a == pytest.approx(b, rel=1e-5) and len(a) == 121


def test_tokens_of_many_texts_are_cut_together():
    """The tokens of each text, as cut alone, and pieces that have every text once."""
    texts = ["", " \t", "A b c \x0b d\n", "Äb äB A", " a a  A\x1cb\x85", "x" * 50, "\x00 \x7f"] * 3
    sizes, which, words = lm_score._cut(pa.array(texts))
    flat = [words[i].as_py().encode() for i in which.tolist()]
    want = [lm_score.tokens_of(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and flat == [t for w in want for t in w]
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, "y" * (1 << 22), "z", *["q" * 1000] * 5000, *["q"] * 600])], ["text"])
    pieces = [p.column("text").to_pylist() for p in lm_score._pieces(batch)]
    assert [t for p in pieces for t in p] == batch.column("text").to_pylist()
    assert all(len(p) == 1 or len(p) <= lm_score._ROWS and sum(map(len, p)) <= lm_score._BYTES for p in pieces) and max(map(len, pieces)) == lm_score._ROWS
