import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowloom.llm.bpe import default_vocabulary, vocabulary
from flowloom.llm.bpe_codec import Encoder, decode, digest_round_trip, encode
from flowloom.llm.token_count import count_texts, count_tokens

LIB = Tokenizer.from_file(default_vocabulary())


def _texts():
    rnd = random.Random(1)
    out = ["", " \n", "don't I'LL ''s", "<|endoftext|>a<|startoftext|> <|endoftex", "İ ΑΣ. ǅ ﬁ é", "中文字符" * 40, "\x1c\x85a\xa0b", "a" * 3000, "abcab" * 700]
    out += ["".join(rnd.choice(["th", "e", "in", "g", " ", "É", "1", "'s", "ß", "\n", "qu", "中"]) for _ in range(rnd.randint(0, 200))) for _ in range(200)]
    return out + ["".join(rnd.choice("thengriausao") for _ in range(rnd.randint(0, 4000))) for _ in range(20)]


def test_encoder_and_counts_equal_the_library():
    texts = _texts()
    want = LIB.encode_batch(texts, add_special_tokens=False)
    for leaf, long in ((16, 16), (7, 1000), (1024, 256)):
        enc = Encoder(default_vocabulary(), leaf, long)
        got = enc.encode(texts)
        assert got == [w.ids for w in want]
        assert [enc.decode(g) for g in got] == [LIB.decode(w.ids, skip_special_tokens=False) for w in want]
    assert count_texts(texts, default_vocabulary()) == [len(w.ids) for w in want]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aehinorst", min_size=1, max_size=400), st.integers(2, 40))
def test_tree_equals_plain_merging(text, leaf):
    v = vocabulary(default_vocabulary())
    s = v.symbols(text)
    assert v.encode_by_tree(s, leaf).tolist() == v.merge([s])[0].tolist()


def test_byte_level_file():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, enc = Tokenizer.from_file(path), Encoder(path, 32)
    for t in ["hello  world\n\n x", "a" * 500, "  ", "é中 x<|endoftext|>y", ""]:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert enc.encode([t])[0] == ids and enc.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_operators_on_odd_rows(spark):
    rows = [(1, "The  cat", "x", 1), (2, None, "y", 2), (None, "", None, None), (1, "The  cat", "x", 1), (3, "b" * 5000, "z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens long")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, *_ in rows:
        ids = LIB.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), sha(" ".join(map(str, ids))), sha(LIB.decode(ids, skip_special_tokens=False))))
    assert sorted((str(r[0]), *r[1:]) for r in digest_round_trip(df).collect()) == sorted(want)
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in count_tokens(df, limit=3).collect()) == sorted((str(i), len((t or "").encode()), w[1], w[1] > 3) for (i, t, *_), w in zip(rows, want))
    back = decode(encode(df))
    assert sorted(sha(r.text) for r in back.collect()) == sorted(w[3] for w in want)
    assert digest_round_trip(df.limit(0)).count() == 0 and count_tokens(df.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab'sI \n1é\u0301中.\u0130<|endofxt>", min_size=0, max_size=300), st.integers(1, 30))
def test_leaves_join_to_the_whole(text, leaf):
    assert Encoder(default_vocabulary(), leaf).encode([text])[0] == LIB.encode(text, add_special_tokens=False).ids


def test_queries_equal_the_library(spark):
    """Every row of op1 and op10, and that texts do go through joins."""
    from flowloom.llm.bpe_codec import op1_bpe_codec
    from flowloom.llm.token_count import op10_token_counts

    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [w.ids for w in LIB.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    want = {i: (len(n), sha(" ".join(map(str, n))), sha(LIB.decode(n, skip_special_tokens=False))) for (i, _), n in zip(rows, ids)}
    got = op1_bpe_codec(spark, d).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(rows)
    counted = op10_token_counts(spark, d).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in counted} == {i: (len(t.encode()), want[i][0], want[i][0] > 2048) for i, t in rows}
    enc = Encoder(default_vocabulary())
    enc.encode([t for _, t in rows])
    assert enc.joins > len(rows)


@pytest.mark.parametrize("kind", ["letters", "cjk", "base64", "same"])
def test_long_runs_take_linear_time(kind):
    import base64
    import time

    rnd, n = random.Random(5), 300_000
    text = {"letters": lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=n)), "cjk": lambda: "".join(map(chr, rnd.choices(range(0x4E00, 0x5E00), k=n // 3))), "base64": lambda: base64.b64encode(rnd.randbytes(n // 4 * 3)).decode(), "same": lambda: "a" * n}[kind]()
    want, start = LIB.encode(text, add_special_tokens=False).ids, time.process_time()
    assert count_texts([text], default_vocabulary()) == [len(want)]
    assert Encoder(default_vocabulary()).encode([text])[0] == want
    assert time.process_time() - start < 20


def test_special_tokens_without_angle_brackets(tmp_path):
    import json

    spec = json.load(open(default_vocabulary(), encoding="utf-8"))
    spec["added_tokens"].append({"id": 49408, "content": "[SEP]", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    path = str(tmp_path / "v.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    text = "one[SEP]two [SEP] [sep]" + " more words" * 300
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert 49408 in ids and Encoder(path).encode([text])[0] == ids and count_texts([text], path) == [len(ids)]
    spec["added_tokens"][-1]["lstrip"] = True
    json.dump(spec, open(path := str(tmp_path / "w.json"), "w", encoding="utf-8"))
    with pytest.raises(ValueError, match="added tokens"):
        Encoder(path)
