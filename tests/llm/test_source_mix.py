"""The mix against a sequential brute force: highest quotients one by one, and words laid out one after another."""

import hashlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from flowloom.llm.source_mix import apportion, mix


def h(seed, key):
    return int(hashlib.md5(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:15], 16)


def targets_of(sizes, weights, total, most):
    """The contract's rule, step by step, in fractions."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    stopped = {}
    while True:
        free = [s for s in order if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: Fraction(left * weight[s], sum(weight[x] for x in free)) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return order, stopped | share
        stopped |= {s: most * sizes[s] for s in above}


def brute(rows, weights=(5, 2, 1), most=3, block=16, shard_words=1 << 18, seed=13):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    total = sum(sizes.values())
    order, targets = targets_of(sizes, weights, total, most)
    rank = {s: k for k, s in enumerate(order)}
    shards = defaultdict(list)
    for i, text, source in rows:
        if n := len((text or "").split()):
            shards[rank[source], h(seed, i) % -(-sizes[source] // shard_words)].append((h(seed, i), i is not None, i or 0, n, source))
    words = {c: sum(d[3] for d in docs) for c, docs in shards.items()}
    vote = {c: targets[order[c[0]]] * n / sizes[order[c[0]]] for c, n in words.items()}
    quota = Counter()
    for _ in range(round(total / block)):
        open_cells = [c for c in sorted(words) if quota[c] < -(-most * words[c] // block)]
        best = max(open_cells, key=lambda c: (vote[c] / (2 * quota[c] + 1), [-x for x in c]), default=None)
        if best is None:
            break
        quota[best] += 1
    taken = Counter()
    for c, docs in shards.items():
        n, take = words[c], min(quota[c] * block, most * words[c])
        owner = [k for k, d in enumerate(sorted(docs)) for _ in range(d[3])]
        start = h(seed, f"{c[0]}/{c[1]}") % max(1, n // block) * block
        per = Counter(owner[(start + k) % n] for k in range(take % n))
        for k, d in enumerate(sorted(docs)):
            taken[d[4], d[2] if d[1] else None, d[3]] += take // n * d[3] + per[k]
    return sizes, targets, taken


def check(spark, rows, **options):
    kinds = "doc_id long, text string, source string, size int, target string"
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], kinds).repartition(3)
    got = mix(df, **options).collect()
    sizes, targets, want = brute(rows, **options)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").split())) for i, t, _ in rows)
    source = defaultdict(set)
    for i, t, s in rows:
        source[i, len((t or "").split())].add(s)
    sums, by_source = Counter(), Counter()
    for r in got:
        (s,) = source[r.doc_id, r.size]  # ids of these rows tell their source
        assert r.source_size == sizes[s] and abs(r.target - float(targets[s])) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= options.get("most", 3) * r.size
        sums[s, r.doc_id, r.size] += r.taken
        by_source[s] += r.taken
    assert +sums == +want
    for s in sizes:
        n_shards = max(1, -(-sizes[s] // options.get("shard_words", 1 << 18)))
        assert abs(by_source[s] - targets[s]) <= options.get("block", 16) * n_shards
    assert sorted(map(str, got)) == sorted(map(str, mix(df.repartition(7), **options).collect()))
    return got


def corpus(n=300):
    return [(k, " ".join(f"w{j}" for j in range((k * 37) % 90)), f"s{k % 3 if k % 2 else (k // 2) % 7}") for k in range(n)]


def test_mix(spark):
    check(spark, corpus())


def test_small_shards_and_other_options(spark):
    check(spark, corpus(), shard_words=500)
    check(spark, corpus(), shard_words=900, block=50, most=2, weights=(1, 9), seed=4)


def test_odd_rows(spark):
    rows = corpus(60) + [(1000, None, "s1"), (1001, "", None), (1002, "a b c d\te\x0bf", None), (None, "x y z", "s2"), (1003, " \n\t ", "only blanks"), (1004, "é", ""), (1005, "tiny words", "Zz"), (1006, "w " * 20_000, "big"), (1007, "𝄞 x", "\U0001d11e"), (1008, "x y", "￮")]
    check(spark, [(i, t, s) for i, t, s in rows if t is None or " " not in t])
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id = 1002").first()
    assert got.size == 4  # only blanks of ASCII part words: a<nbsp>b<em space>c, d, e, f


def test_copies_share_evenly(spark):
    rows = [(5, "a b c d e f g", "s0")] * 9001 + corpus(40)
    got = check(spark, rows)
    copies = [r.taken for r in got if r.doc_id == 5 and r.size == 7]
    assert len(copies) == 9001 and max(copies) - min(copies) <= 1


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(empty).collect() == []
    no_words = spark.createDataFrame([(1, None, "a"), (1, "", None)], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in mix(no_words).collect()) == [(1, 0, 0, 0.0, 0, 0), (1, 0, 0, 0.0, 0, 0)]


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1000])
def test_apportion(spark, seats):
    """Against seats given one by one, with limits that bind and equal votes."""
    cells = [(k, float(v), limit) for k, (v, limit) in enumerate([(100, 1000), (100, 1000), (53.5, 1000), (53.5, 3), (7, 1000), (0, 10), (0.3, 50), (1000, 1000), (20, 0)])]
    got = {r.k: r.quota for r in apportion(spark.createDataFrame(cells, "k long, vote double, seat_limit long"), ["k"], seats).collect()}
    want = Counter()
    for _ in range(seats):
        k = max((k for k, v, limit in cells if v and want[k] < limit), key=lambda k: (cells[k][1] / (2 * want[k] + 1), -k))
        want[k] += 1
    short = seats - sum(got.values())
    assert got == {k: want[k] for k, _, _ in cells} or (0 < short and all(got[k] <= want[k] for k in got))
    assert short == 0 or any(got[k] == limit for k, v, limit in cells if v)
