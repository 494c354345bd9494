import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from gleanery.functions.scoring import hybrid_score
from gleanery.operators import search
from gleanery.operators.batch_search import Vocabulary, batch_search, query_slices
from gleanery.operators.search import SearchQuery, hybrid_search
from gleanery.plans import sample_corpus as corpus
from gleanery.schema import CHUNK, NATURAL_KEY
from gleanery.session import new_scratch
from gleanery.sources.chunk_table import ChunkTable

WORDS = ["alpha", "beta", "gamma", "delta", "running", "scripts"]
PLACES = ["src", "test", "docs", "tmp", "lib"]
ENDINGS = [(".py", "python"), (".sh", "shell"), (".yaml", "yaml"), (".md", "markdown"), ("", "")]


def _rows(count: int, seed: int = 1) -> list[tuple]:
    rnd = random.Random(seed)
    rows = []
    for i in range(count):
        ending, language = rnd.choice(ENDINGS)
        vector = rnd.choice([None, [0.0, 0.0, 0.0], [rnd.gauss(0, 1) for _ in range(3)]])
        rows.append((
            f"id{i}", rnd.choice(["r1", "r2", "r2", "r2"]), rnd.choice(["", "main"]),
            f"{rnd.choice(PLACES)}/f_{i % 40}{ending}", language or None,
            " ".join(rnd.choices(WORDS, k=rnd.randrange(5))) or None, "text", 1, i + 1, vector,
            f"h{i}", None, None,
        ))
    return rows


@pytest.fixture(scope="module")
def chunks(spark):
    frame = spark.createDataFrame(_rows(400), CHUNK)
    return frame.repartition(5).cache()


def _all_scored(chunks, query):
    """Every candidate with its score, maxima taken without pruning."""
    terms = search.score_terms(search.filter_candidates(chunks, query), query)
    top = search.score_maxima(terms).first()
    names = ["sem", "lex", "tri", "bias", "noise"]
    score = hybrid_score(*map(F.col, names), *map(F.lit, [top[f"max_{t}"] for t in names[:3]]))
    return terms.withColumn("score", score).orderBy(*search.best_first())


QUERIES = [
    SearchQuery("bash scripts for alpha f_12.py", 7, [0.3, -1.0, 0.5]),
    SearchQuery("beta gamma", 7, [0.3, -1.0, 0.5], repository="r1"),
    SearchQuery("f_3", 7, None, ref="main"),
    SearchQuery("run client", 7, [0.0, 0.0, 0.0], language="python"),
    SearchQuery("!!!", 7, [1.0, 0.0, 0.0], path_contains="F__.p"),
    SearchQuery("alpha", 500, [1.0, 0.0, 0.0]),
    SearchQuery("alpha", 2000, [1.0, 0.0, 0.0]),
    SearchQuery("alpha", 5, [1.0, 0.0, 0.0], repository="none"),
]


@pytest.mark.parametrize("query", QUERIES)
def test_pruning_is_exact(chunks, query):
    got = hybrid_search(chunks, query).orderBy("rank").collect()
    expected = _all_scored(chunks, query).limit(query.k).collect()
    assert [r["rank"] for r in got] == list(range(1, len(expected) + 1))
    assert [tuple(r)[:11] for r in got] == [tuple(r) for r in expected]


@pytest.mark.parametrize("stemmed", [True, False])
def test_batch_equals_single_searches(spark, chunks, stemmed):
    single = [q for q in QUERIES if q.k == 7]
    rows = [(i, q.text, q.vector, q.repository, q.ref, q.language, q.path_contains)
            for i, q in enumerate(single)] + [(99, " \n ", None, "", "", "", "")]
    queries = spark.createDataFrame(
        rows, "query_id int, query_text string, query_vec array<float>, repository string, "
        "ref string, language string, path_contains string")
    found = batch_search(chunks, queries, 7, stemmed, queries_per_pass=3).collect()
    assert {r["query_id"] for r in found} == {0, 1, 2, 3, 4}
    for i, query in enumerate(single):
        from dataclasses import replace

        one = hybrid_search(chunks, replace(query, stemmed=stemmed)).orderBy("rank").collect()
        many = sorted((r for r in found if r["query_id"] == i), key=lambda r: r["rank"])
        assert [tuple(r)[1:] for r in many] == [tuple(r) for r in one]


def test_all_equal_scores_follow_the_key(spark):
    rows = [(f"i{i}", "r", "m", f"p{i:03}", "go", "same", "", 1, 1, [0.0, 0.0], "h", None, None)
            for i in range(300)]
    chunks = spark.createDataFrame(rows, CHUNK).repartition(6)
    expected = [f"p{i:03}" for i in range(4)]
    one = hybrid_search(chunks, SearchQuery("x", 4, [0.0, 0.0])).orderBy("rank")
    assert [r["path"] for r in one.collect()] == expected
    queries = spark.createDataFrame([(1, "x", [0.0, 0.0])],
                                    "query_id int, query_text string, query_vec array<float>")
    many = batch_search(chunks, queries, 4).orderBy("rank")
    assert [r["path"] for r in many.collect()] == expected


def test_empty_queries(chunks):
    for query in (SearchQuery(" \t\n"), SearchQuery("x", 0)):
        empty = hybrid_search(chunks, query)
        assert empty.count() == 0
        assert empty.columns == hybrid_search(chunks, QUERIES[0]).columns
    with pytest.raises(ValueError):
        SearchQuery("x", -5)


def test_parse_k():
    assert [search.parse_k(v) for v in ("7", "x", None, "", "-5")] == [7, 5, 5, 5, -5]
    assert [search.parse_k(v) for v in (" 5 9", " 8", "1_0", "+3", "٣", "9" * 30)] == [5, 5, 5, 3, 5, 5]


def test_failing_embedding_leaves_the_lexical_search(chunks):
    class Broken:
        def embed_batch(self, texts):
            raise RuntimeError("no credentials")

    query = search.with_embedding(SearchQuery(" alpha "), Broken())
    assert query.vector is None
    assert {r["sem"] for r in hybrid_search(chunks, query).collect()} == {0.0}


def test_slices_are_bounded_and_complete(spark):
    queries = spark.range(57).withColumnRenamed("id", "query_id")
    slices = list(query_slices(queries, 10))
    assert max(map(len, slices)) <= 10
    assert sorted(r["query_id"] for s in slices for r in s) == list(range(57))


def _like(pattern: str, text: str) -> bool:
    """LIKE without case, a character at a time."""
    if not pattern:
        return not text
    head, rest = pattern[0], pattern[1:]
    if head == "%":
        return any(_like(rest, text[i:]) for i in range(len(text) + 1))
    if head == "\\" and rest:
        head, rest = rest[0], rest[1:]
    elif head == "_":
        return bool(text) and _like(rest, text[1:])
    return bool(text) and text[0].lower() == head.lower() and _like(rest, text[1:])


FRAGMENTS = ["a", "A_c", "%", "a%c", r"a\%", r"\_", "x.y", "(", "", r"\m", r"src\main", "foo\\",
             r"a\\b", r"\\", r"\a\%"]
TEXTS = ["abc", "ABC", "a%", "a_b", "x.y", "xzy", "f(x)", "a\nc", "", "srcmain", "foo%", "a\\b", "m"]


def test_path_fragments(column):
    rows = list(itertools.product(TEXTS, FRAGMENTS))
    got = column(rows, "t string, f string", search.path_matches(F.col("t"), F.col("f")))
    assert got == [_like(f"%{f}%", t) for t, f in rows]


def test_path_fragments_in_batches(spark):
    """Batch and single searches agree on every legal fragment."""
    rows = [(f"i{i}", "r", "m", t, "go", "alpha", "", 1, 1, [1.0, 0.0], "h", None, None)
            for i, t in enumerate(TEXTS)]
    chunks = spark.createDataFrame(rows, CHUNK)
    queries = spark.createDataFrame(
        [(i, "alpha", [1.0, 0.0], f) for i, f in enumerate(FRAGMENTS)],
        "query_id int, query_text string, query_vec array<float>, path_contains string")
    found = batch_search(chunks, queries, 99).collect()
    for i, fragment in enumerate(FRAGMENTS):
        paths = {r["path"] for r in found if r["query_id"] == i}
        assert paths == {t for t in TEXTS if not fragment or _like(f"%{fragment}%", t)}


def test_vocabulary_counts_repeats():
    import numpy as np
    import pyarrow as pa

    words = Vocabulary([["a", "b"], ["b"], []])
    lists = pa.array([["b", "b", "a"], [], None, ["zz", "a"]], pa.list_(pa.string()))
    assert words.word_hits(lists, False).tolist() == [[3, 2, 0], [0, 0, 0], [0, 0, 0], [1, 0, 0]]
    codes = Vocabulary([[5, 9], [9]])
    rows = np.array([0, 0, 1, 2])
    assert codes.code_hits(rows, np.array([5, 9, 7, 99]), 3).tolist() == [[2, 1], [0, 0], [0, 0]]
    nothing = Vocabulary([[], []])
    assert nothing.code_hits(rows, rows, 3).tolist() == [[0, 0]] * 3
    assert nothing.word_hits(lists, True).tolist() == [[0, 0]] * 4


def _executed(frame) -> str:
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("k", [10, 5000])
def test_plan_reads_vectors_once_and_no_content(spark, small, k, monkeypatch):
    table = ChunkTable(spark, new_scratch(spark, "plan"), corpus.DIM)
    table.save(corpus.chunks(spark, small))
    query = corpus.flagship_query(spark, small, k=k)
    written = []
    keep = search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, name: written.append(df) or keep(df, name))
    found = hybrid_search(table.load(), query)
    (terms,) = written
    plan = _executed(terms)
    assert "content" not in plan and "Exchange" not in plan
    assert re.search(r"PartitionFilters: \[.*main", plan)
    plan = _executed(found)
    assert "summary_vec" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("batch", [False, True])
def test_winners_partitions_alone_are_read(spark, small, batch):
    table = ChunkTable(spark, new_scratch(spark, "plan"), corpus.DIM)
    table.save(corpus.chunks(spark, small))
    chunks = table.load()
    if batch:
        ranked = batch_search(chunks, corpus.queries(spark, small).limit(3), 1)
    else:
        ranked = hybrid_search(chunks, corpus.flagship_query(spark, small, k=2))
    winners = ranked.collect()
    results = search.fetch_chunks(ranked, table)
    assert results.count() == len(winners)
    plan = _executed(results)
    pairs = {(r["repository"], r["ref"]) for r in winners}
    read = {tuple(f.split("/")[-3:-1]) for f in results.inputFiles() if "repository=" in f}
    assert {(r.split("=")[1], f.split("=")[1]) for r, f in read} == pairs
    assert "In(path" in plan
    assert not re.search(r"Exchange hashpartitioning[^\n]*\n[^\n]*content", plan)
    assert set(NATURAL_KEY) <= set(results.select("chunk.*").columns)
