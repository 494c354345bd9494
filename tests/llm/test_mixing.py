import math
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gleanery.llm import mixing
from gleanery.llm.common import job_folder
from tests.llm.conftest import ODD


def _targets(sizes):
    """Water filling by repeated sharing, in exact numbers."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] if None in sizes else []
    weight = {name: i % 3 + 1 for i, name in enumerate(names)}
    total, full = Fraction(sum(sizes.values())), set()
    while True:
        open_ = [n for n in names if n not in full]
        left = total - sum(3 * sizes[n] for n in full)
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = {n for n in open_ if share[n] > 3 * sizes[n]}
        if not over:
            return {n: share.get(n, Fraction(3 * sizes[n])) for n in names}
        full |= over


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 10, "b": 1000, "c": 5},
        {"a": 1, "b": 1, "c": 1, "d": 100_000, None: 7},
        {"z": 0, "y": 50, None: 0},
        {"only": 12},
    ],
)
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, words long")
    found = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    assert found == pytest.approx({k: float(v) for k, v in _targets(sizes).items()})


def _check(rows, tolerance):
    sources = defaultdict(lambda: [0, 0, None])
    for r in rows:
        assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        of = sources[r.source_size, r.target]
        of[0] += r.taken
        of[1] += r.size
    for (size, target), (taken, sizes, _) in sources.items():
        assert sizes % size == 0 if size else sizes == 0
        assert abs(taken - target) <= tolerance


def test_query(spark, small, small_texts):
    frame = spark.read.parquet(f"{small}/documents.parquet")
    rows = mixing.op8_mixing(frame).collect()
    assert {r.doc_id: r.size for r in rows} == {i: len(t.split()) for i, t in small_texts}
    longest = max(r.size for r in rows)
    _check(rows, longest / 2)
    sizes = defaultdict(int)
    for r in frame.collect():
        sizes[r.source] += len(r.text.split())
    expected = {round(float(t), 6) for t in _targets(sizes).values()}
    assert {round(r.target, 6) for r in rows} == expected
    assert sorted(rows) == sorted(mixing.op8_mixing(frame.repartition(7)).collect())


def test_awkward_rows(odd):
    rows = mixing.op8_mixing(odd).collect()
    assert len(rows) == len(ODD)
    assert sorted(r.size for r in rows) == sorted(len((t or "").split()) for _, t in ODD)


def test_null_source_is_the_last(documents):
    rows = mixing.op8_mixing(documents((1, "a b c d", None), (2, "a b c d", "x"))).collect()
    assert {r.doc_id: r.target for r in rows} == pytest.approx({1: 16 / 3, 2: 8 / 3})


def test_empty_table(documents):
    assert mixing.op8_mixing(documents()).collect() == []


@pytest.mark.parametrize(("total", "good", "draws"), [(10, 4, 5), (7, 0, 3), (7, 7, 3), (60, 20, 30)])
def test_hypergeometric(spark, total, good, draws):
    """Quantiles against exact binomials."""
    points = [(i + 0.5) / 40 for i in range(40)]
    expected = []
    for u in points:
        sum_ = 0.0
        for x in range(good + 1):
            ways = math.comb(good, x) * math.comb(total - good, draws - x) if x <= draws else 0
            sum_ += ways / math.comb(total, draws)
            if sum_ >= u:
                expected.append(x)
                break
    frame = spark.createDataFrame([(u,) for u in points], "u double")
    numbers = [F.lit(v).cast("long") for v in (total, good, draws)]
    rows = frame.select("u", mixing.hypergeometric(*numbers, F.col("u")).alias("x")).collect()
    assert [r.x for r in sorted(rows)] == expected


@pytest.mark.parametrize("shards", [1, 2, 5, 16])
def test_tree_splits_exactly(spark, shards):
    quotas = spark.createDataFrame([(0, 40), (1, 0), (2, 7), (3, 3000)], "sid int, draws int")
    rows = mixing.splitting_tree(quotas, shards).collect()
    assert sorted(r.shard for r in rows) == list(range(shards))
    assert [sum(r.counts[i] for r in rows) for i in range(4)] == [40, 0, 7, 3000]
    assert all(min(r.counts) >= 0 for r in rows)
    sizes = [sum(r.counts) for r in rows]
    assert max(sizes) - min(sizes) <= shards


def test_placements(spark, documents):
    """Every copy has a shard, and many blocks fill all shards."""
    frame = documents(*[(i, "w " * (1 + i % 9), f"s{i % 4}") for i in range(400)])
    rows = mixing.mix_plan(frame, shards=4, block_words=20).collect()
    assert all(len(r.placements) == r.copies for r in rows)
    shards = [p.shard for r in rows for p in r.placements]
    assert set(shards) == {0, 1, 2, 3}


def test_mix_documents(odd):
    """Each row comes as often as planned, with all its columns."""
    plan = mixing.mix_plan(odd).collect()
    found = mixing.mix_documents(odd)
    assert found.columns == odd.columns
    assert found.count() == sum(r.copies * r.n for r in plan)


@pytest.mark.parametrize("seed", range(3))
def test_long_document_is_no_miss(documents, seed):
    """Almost half of a source is one document longer than a block, and its short ones do
    not reach the target of 1,600: they fill what the long one leaves, wherever it stands."""
    rows = [(0, "w " * 1300, "a")] + [(i, "w " * 10, "a") for i in range(1, 151)]
    rows += [(i, "w " * 10, "b") for i in range(1000, 1020)]
    rows += [(2000, "w " * 1500, "c"), *[(i, "w " * 10, "c") for i in range(2001, 2251)]]
    taken = defaultdict(int)
    targets = {}
    for r in mixing.mix_plan(documents(*rows), block_words=500, seed=seed).collect():
        taken[r.source] += r.size * r.n * r.copies
        targets[r.source] = r.target
    assert set(targets) == {"a", "b", "c"}
    assert all(abs(taken[s] - t) <= 5 for s, t in targets.items()), (taken, targets)


def test_draws_stand_in_no_later_plan(spark, documents):
    """The driver plans every level of the tree alone; what follows reads stored draws."""
    rows = [(i, "some words " * (1 + i % 7), f"s{i % 3}") for i in range(60)]
    plan = mixing.mix_plan(documents(*rows), shards=16, block_words=20)
    assert "aggregate(" not in plan._jdf.queryExecution().optimizedPlan().toString()
    quotas = spark.createDataFrame([(0, 40), (1, 25)], "sid int, draws bigint")
    stored = mixing.splitting_tree(quotas, 16, folder=job_folder(spark, "test"))
    assert "aggregate(" not in stored._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(stored.collect()) == sorted(mixing.splitting_tree(quotas, 16).collect())
