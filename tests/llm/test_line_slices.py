"""Texts that op9's tasks hold as Python objects at once."""

import pyarrow as pa

from flowloom.llm import line_dedup


def test_batches_are_cut_and_nothing_is_lost():
    b = pa.RecordBatch.from_arrays([pa.array(range(1300))], ["doc"])
    parts = list(line_dedup._slices(b))
    assert max(p.num_rows for p in parts) <= line_dedup.ROWS < 1000
    assert [x for p in parts for x in p.column("doc").to_pylist()] == list(range(1300))
    assert not list(line_dedup._slices(b.slice(0, 0)))
