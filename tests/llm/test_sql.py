"""The text queries that have SQL, against DuckDB on whole tables and on odd rows."""

import duckdb
import pytest

from flowloom.llm.queries import oracle_sql, queries

DOCUMENTS = [(1, "a b c d e f g h i j k l m n o"), (1, "x A,b C d e f g h i j k l m\nn"), (2, None), (3, ""), (4, "ONE two. one"), (None, "é—one two one two"), (5, "one "), (6, "ünder " * 400 + "One Two"), (7, "a\nb\n\nc"), (8, "\n<\nP>\n"), (9, "x <M>\ny"), (10, "lines of text\n" * 300)]
BENCHMARK = [(10, "A b c d e f g h i j k l m n"), (9, "one two"), (9, "one two"), (11, None), (12, "..."), (13, "ünder ünder")]
CONVERSATIONS = [(1, 0, "user", "[/INST] <\\s> </s>"), (1, 1, "assistant", "é [INST\\] <\\\\/s> [\\INST]"), (1, 1, "assistant", None), (2, 0, None, "x"), (3, 5, "to<o[l\\\n", "<s>"), (None, 0, "assistant", "lone"), (2, 0, "assistant", "")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    documents = [(i, t, [None, "b", "", "a", "ü"][k % 5]) for k, (i, t) in enumerate(DOCUMENTS)]
    for name, rows, schema in (("documents", documents, "doc_id long, text string, source string"), ("benchmark", BENCHMARK, "item_id long, text string"), ("conversations", CONVERSATIONS, "conv_id long, turn long, role string, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.mark.parametrize("where", ["odd", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, odd, name, where):
    d = odd if where == "odd" else where
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet{'/*.parquet' if where == 'odd' else ''}')")
    want = duck.execute(oracle_sql()[name])
    columns = [x[0] for x in want.description]
    df = queries()[name](spark, d)
    assert sorted(df.columns) == sorted(columns)
    rows = [tuple(r) for r in df.select(columns).collect()]
    assert sorted(rows, key=str) == sorted(want.fetchall(), key=str)
    assert rows
