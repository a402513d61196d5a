import hashlib
from collections import defaultdict

from flowloom.llm.chat_format import digest_formatted, format_conversations, op3_chat_format, read_turns

SCHEMA = "conv_id long, turn long, role string, text string, part int, formatted string"


def _brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        convs[c].append((-1 if turn is None else turn, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out.append((str(c), len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss)))
    return sorted(out)


def _rows():
    odd = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s> \\", "[\\INST]\n[", " [/INST]</s>\n<s>[INST] user\nhi", "é" * 9, None, "", "<<s>s>", "x" * 3000]
    rows = [(1, i, r, t, 0, "") for i, t in enumerate(odd) for r in ("user", "assistant")]
    rows += [(2, 5, "a\\0\nb<s>[", "t", None, None), (2, None, None, "first", 0, ""), (None, 1, "assistant", "nameless", 0, ""), (2, 5, "a\\0\nb<s>[", "t", None, None)]
    return rows + [(3, i, "assistant" if i % 2 else "user", f"turn {i}", 0, "") for i in range(500)]


def test_round_trip_and_masks(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    for size in (8_000_000, 500):  # one part each, many parts
        made = format_conversations(df, size)
        got = digest_formatted(made).collect()
        assert sorted((str(r[0]), *r[1:5]) for r in got) == _brute(_rows())
        parts = made.orderBy("conv_id", "part").collect()
        assert [p.part for p in parts if p.conv_id == 3] == list(range(sum(p.conv_id == 3 for p in parts)))
        assert (len(parts) == 4) == (size == 8_000_000)
        assert sum(r.formatted_chars for r in got) == sum(len(p.formatted) for p in parts)
        for p in parts:
            assert len(read_turns(p.formatted)) == p.n_turns


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    assert sorted((str(r[0]), *r[1:5]) for r in op3_chat_format(spark, sf).collect()) == _brute(rows)


def test_empty(spark):
    assert digest_formatted(format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0
