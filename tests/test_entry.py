from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_contract(spark):
    import __spark_entry__ as e

    (row,) = e.entry(spark).collect()
    assert row.n > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_but_the_entry_imports_the_text_subpackage():
    for p in ROOT.glob("flowloom/**/*.py"):
        if "llm" not in p.parts:
            assert "flowloom.llm" not in p.read_text(), p
