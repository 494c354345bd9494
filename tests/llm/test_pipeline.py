"""The pipeline stage by stage against what each stage must keep."""

from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gleanery.llm import decontaminate, mixing, quality, token_output
from gleanery.llm.common import job_folder, save
from tests.llm.conftest import ODD
from tests.llm.test_near_duplicates import _brute


@pytest.fixture(scope="module")
def steps(spark, small):
    """Input and output of every stage on the small tables."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    folder, found = job_folder(spark, "test"), []
    for name, stage in corpus_pipeline.STAGES:
        result = save(stage(spark, docs, small), folder, name)
        found.append((docs, result))
        docs = result
    return dict(zip([name for name, _ in corpus_pipeline.STAGES], found, strict=True))


def test_columns(steps):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(out.columns == columns for name, (_, out) in steps.items() if name != "tokens")


def test_quality_stage(spark, small, steps):
    before, after = steps["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = {r.doc_id for r in after.collect()}
    good = [r.doc_id in kept for r in before.collect() if labels.get(r.doc_id) == 1]
    bad = [r.doc_id in kept for r in before.collect() if labels.get(r.doc_id) == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.3


def test_near_duplicate_stage(steps):
    before, after = steps["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    expected = {doc_id for doc_id, _, least in _brute(rows, 80) if doc_id == least}
    assert sorted(r.doc_id for r in after.collect()) == sorted(expected)


def test_decontamination_stage(spark, small, steps):
    before, after = steps["decontamination"]
    kept = {r.doc_id for r in after.collect()}
    items = [decontaminate.normal(r.text) for r in
             spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    for r in before.collect():
        leaks = any(item in decontaminate.normal(r.text) for item in items)
        assert not leaks or r.doc_id not in kept
    assert len(kept) > 0.9 * before.count()


def test_mixing_stage(steps):
    before, after = steps["mixing"]
    expected = {r.doc_id: r.copies for r in mixing.mix_plan(before).collect() if r.copies}
    assert Counter(r.doc_id for r in after.collect()) == expected


def test_token_stage(steps):
    before, after = steps["tokens"]
    tokenizer = Tokenizer.from_file(token_output.default_tokenizer())
    counts = [
        (r.doc_id, len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1)
        for r in before.collect()
    ]
    found = sorted(after.collect(), key=lambda r: r.start)
    assert sorted((r.doc_id, r.n_tokens) for r in found) == sorted(counts)
    assert [r.doc_id for r in found] == sorted(r.doc_id for r in found)
    assert found[-1].start + found[-1].n_tokens == sum(n for _, n in counts)


def test_awkward_rows(spark, odd, tmp_path):
    """Every stage takes awkward rows and hands on their columns."""
    folder = str(tmp_path)
    labels = [(1, 1, 0), (8, 0, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet"
    )
    spark.createDataFrame([(1, "not there at all")], "item_id bigint, text string").write.parquet(
        f"{folder}/benchmark.parquet"
    )
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, folder)
        assert kept.columns == odd.columns
        extra = odd.columns[5:]
        assert all(row[name] == "extra" for row in kept.collect() for name in extra)
    assert corpus_pipeline.decontamination_stage(spark, odd, folder).count() == len(ODD)
    odd.limit(0).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_classifier_never_trains_on_held_out_rows(spark):
    frame = spark.range(60).withColumnRenamed("id", "doc_id")
    held = frame.where(quality.held_out(frame.doc_id)).count()
    assert 10 <= held <= 30
