"""How often the text of a document crosses an exchange, where joins cannot broadcast."""

import re

import pytest

import __spark_entry__ as entry
from gleanery.plans import sample_corpus as corpus
from gleanery.session import materialize, new_scratch
from gleanery.sources.chunk_table import ChunkTable
from tests.conftest import SMALL


def _text_moves(frame) -> int:
    """Exchanges of the plan that carry text or content."""
    plan = frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    steps = re.findall(r"\n\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert steps
    # Small inputs are spread over the cores first, by number.
    spreads = len(re.findall(r"Arguments: RoundRobinPartitioning", plan))
    return sum(bool(re.search(r"\b(text|content|input)#", s)) for s in steps) - spreads


@pytest.mark.parametrize(
    ("name", "most"),
    [("index_delta", 0), ("meta_lookup", 0), ("upsert_chunks", 0),
     ("summarize", 1), ("embed", 1), ("provider", 1)],
)
def test_text_moves_only_where_content_is_wanted(spark, name, most):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _text_moves(entry.queries()[name](spark, SMALL)) <= most
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_new_chunks_move_no_text(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _text_moves(corpus.new_chunks(spark, SMALL)) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stored_texts_are_packed(spark):
    table = ChunkTable(spark, new_scratch(spark, "chunks"), corpus.DIM)
    table.save(corpus.chunks(spark, SMALL).limit(20))
    between = materialize(table.load(), "between")
    names = [*table.load().inputFiles(), *between.inputFiles()]
    assert names and all(".zstd." in n for n in names)
