"""Memory of op8's tasks that weigh tokens."""

import tracemalloc

import numpy as np

from flowloom.llm import lm_score


def test_a_part_is_weighed_strip_by_strip():
    """As weighed at once, but in a fraction of the memory."""
    lex = lm_score.Lexicon([b"w%d" % i for i in range(5000)], list(range(6000, 1000, -1)), 10**7, 6000, [10**4] * 32, [10] * 32, [5] * 32).ready()
    model = lm_score.Model(lex)
    model.settle_pairs(lex)
    r, n = np.random.default_rng(1), 1 << 16
    pieces = [[np.sort((r.integers(0, 50_000, n) * 85_899).astype(np.uint32)), r.integers(0, 5000, n).astype(np.uint32), r.integers(lm_score.HOT, 8000, n).astype(np.uint32), r.integers(0, 8000, n).astype(np.uint16)] for _ in range(8)]

    def at_once():
        context, word, skipped, own = (np.concatenate(x) for x in zip(*pieces))
        return lm_score.weigh(context, word, skipped, lm_score._bases(lex, model, word, skipped, own & 1), own >> 1 & 1)

    def measured(f):
        tracemalloc.start()
        out = f()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, peak

    want, most = measured(at_once)
    got, peak = measured(lambda: np.concatenate(lm_score.weigh_strips(lex, model, pieces, 1 << 16)))
    assert 5 * peak < 2 * most
    assert (np.abs(got - want) > 1e-9).mean() < 1e-4  # 3-grams' hashes of 38 bits may meet in the whole part only
    for strip in (1, 1 << 30):
        small = [[c[:300] for c in p] for p in pieces]
        assert np.allclose(np.concatenate(lm_score.weigh_strips(lex, model, small, strip)), np.concatenate(lm_score.weigh_strips(lex, model, small)), atol=1e-9)
