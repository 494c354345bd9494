import pyarrow as pa

from gleanery.functions.stemmer import stem
from gleanery.operators.blocks import row_blocks


def test_blocks_are_bounded_by_rows_times_queries():
    batch = pa.RecordBatch.from_pydict({"a": list(range(5000))})
    for queries in (1, 100, 500, 1 << 20):
        blocks = list(row_blocks([batch], queries))
        assert [v for b in blocks for v in b["a"].to_pylist()] == list(range(5000))
        assert max(b.num_rows for b in blocks) * queries <= max(1 << 17, queries)


def test_remembered_stems_are_bounded():
    assert stem.cache_info().maxsize <= 100_000
