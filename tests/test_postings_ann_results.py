import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.functions.stemmer import stem
from gleanery.functions.text import STOP_WORDS
from gleanery.operators import ann, postings, results, search
from gleanery.plans import sample_corpus as corpus
from gleanery.schema import CHUNK, NATURAL_KEY
from gleanery.session import new_scratch

TEXTS = [("src/run_it.py", "Running the runs", "the dogs ran; runs and the RUNS"), ("of/the", "", ""),
         ("a/b", None, "x " * 5), ("src/été.md", "été", None)]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(str(i), "r", "m", p, None, s, c, 1, 1, None, None, None, None)
            for i, (p, s, c) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, CHUNK)


def expected_postings(stemmed):
    found = {}
    for path, summary, content in TEXTS:
        start = 0
        fields = [re.sub("[^A-Za-z0-9]+", " ", path), summary or "", content or ""]
        for weight, value in zip("ABC", fields, strict=True):
            last = 0
            for place, word in enumerate(re.findall(r"[^\W_]+", value.lower()), 1):
                if word not in STOP_WORDS:
                    term = stem(word) if stemmed else word
                    found.setdefault((term, path), []).append((start + place, weight))
                    last = place
            start += last
    return found


@pytest.mark.parametrize("stemmed", [True, False])
@pytest.mark.parametrize("block", [1, 2_000_000])
def test_fielded_postings(chunks, stemmed, block, monkeypatch):
    monkeypatch.setattr(postings, "WORDS_PER_BLOCK", block)
    rows = postings.fielded_postings(chunks, stemmed).collect()
    got = {(r["term"], r["path"]): [tuple(p) for p in r["positions"]] for r in rows}
    assert got == expected_postings(stemmed) and len(rows) == len(got)
    for r in rows:
        weights = [p["weight"] for p in r["positions"]]
        assert [r["hits_a"], r["hits_b"], r["hits_c"]] == [weights.count(w) for w in "ABC"]


def test_postings_are_built_without_a_shuffle(chunks):
    plan = postings.fielded_postings(chunks)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_lookup_term(spark, chunks):
    path = new_scratch(spark, "postings")
    postings.save_postings(postings.fielded_postings(chunks), path, buckets=8)
    saved = spark.read.parquet(path)
    found = postings.lookup_term(saved, "run", buckets=8)
    assert {r["path"] for r in found.collect()} == {"src/run_it.py"}
    assert re.search(r"PartitionFilters: \[.*bucket", found._jdf.queryExecution().toString())


def _ranked(frame, key):
    found = {}
    for r in frame.orderBy("rank").collect():
        found.setdefault(r["query_id"], []).append(r[key])
    return found


def _share(near, exact, key="id"):
    return ann.recall(near, exact, key).agg(F.avg("recall")).first()[0]


def test_ann_of_all_cells_is_exact_and_the_default_finds_nine_of_ten(spark, small):
    rows = corpus.table(spark, small, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    queries = corpus.queries(spark, small)
    index = ann.AnnIndex.build(rows, new_scratch(spark, "ann"), corpus.DIM, "vec_id")
    assert spark.read.parquet(f"{index.path}/codes").count() == rows.count()
    exact = ann.exact_nearest(rows, queries, corpus.DIM, 10, "vec_id")
    whole = index.search(queries, 10, probes=len(index.quantizer.centres), short=rows.count())
    assert _ranked(whole, "vec_id") == _ranked(exact, "vec_id")
    asked = {r["query_id"]: r["query_vec"] for r in queries.collect()}
    all_rows = [(r["vec_id"], r["vector"]) for r in rows.collect()]

    def cosine(a, b):
        dot = sum(x * y for x, y in zip(a, b, strict=True))
        return dot / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    got = _ranked(exact, "vec_id")
    for query_id, vector in asked.items():
        brute = sorted(all_rows, key=lambda row: -cosine(vector, row[1]))[:10]
        assert got[query_id] == [row[0] for row in brute]
    near = index.search(queries, 10)
    assert _share(near, exact, "vec_id") >= 0.9
    # The vector itself is found.
    assert near.where("rank = 1").where("query_id = vec_id").count() == len(asked)


def test_ann_of_clusters_reads_a_tenth_of_the_vectors(spark):
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(30, 16))
    draw = lambda n: centres[np.arange(n) % 30] + 0.2 * rnd.normal(size=(n, 16))
    rows = spark.createDataFrame(
        [(i, v) for i, v in enumerate(draw(3000).tolist())], "id int, vector array<float>"
    )
    queries = spark.createDataFrame(
        [(i, v) for i, v in enumerate(draw(60).tolist())], "query_id int, query_vec array<float>"
    )
    index = ann.AnnIndex.build(rows, new_scratch(spark, "ann"), 16)
    assert _share(index.search(queries), ann.exact_nearest(rows, queries, 16)) >= 0.9
    assert index.quantizer.short <= 300
    assert index.quantizer.probes <= len(index.quantizer.centres) / 10
    again = ann.AnnIndex(spark, index.path)
    assert np.array_equal(again.quantizer.words, index.quantizer.words)


def test_ann_slices_zero_vectors_and_crowded_cells(spark):
    rnd = random.Random(2)
    rows = [(i, [1.0, rnd.random() / 10, 0.0]) for i in range(500)] + [(900 + i, None) for i in range(3)]
    rows += [(i, [0.0] * 3) for i in range(600, 603)]
    frame = spark.createDataFrame(rows, "id int, vector array<float>")
    queries = spark.createDataFrame(
        [(i, [1.0, i / 50, 0.0]) for i in range(5)] + [(8, [0.0] * 3), (9, None)],
        "query_id int, query_vec array<float>",
    )
    index = ann.AnnIndex.build(frame, new_scratch(spark, "ann"), 3)
    found = _ranked(index.search(queries, 30, queries_per_pass=2), "id")
    assert set(found) == {0, 1, 2, 3, 4, 8}
    assert all({600, 601, 602} <= set(ids) and len(ids) == 30 for q, ids in found.items() if q < 8)
    assert found[8] == list(range(30))
    with pytest.raises(ValueError, match="different vector dimensions"):
        index.search(spark.createDataFrame([(1, [1.0])], "query_id int, query_vec array<float>"))


def test_ann_of_nothing(spark):
    empty = spark.createDataFrame([], "id int, vector array<float>")
    index = ann.AnnIndex.build(empty, new_scratch(spark, "ann"), 3)
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id int, query_vec array<float>")
    assert index.search(queries).collect() == []
    assert index.search(queries.where("false")).collect() == []


@pytest.fixture(scope="module")
def shaped(spark, small):
    chunks = corpus.chunks(spark, small)
    query = corpus.flagship_query(spark, small, k=30)
    return search.attach_chunks(search.hybrid_search(chunks, query), chunks).cache()


def test_search_json(shaped):
    body = json.loads(results.json_body(shaped).first()["body"])
    assert len(body) == 30
    assert list(body[0]) == ["chunk", "score"]
    assert list(body[0]["chunk"]) == search.RESULT_COLUMNS
    scores = [item["score"] for item in body]
    assert scores == sorted(scores, reverse=True)
    assert body[0]["chunk"]["created_at"].startswith("2026-01-01T00:00:00")
    assert results.json_body(shaped.where("false")).first()["body"] == "[]"


def test_bad_scores_become_zero(shaped):
    broken = shaped.withColumn("score", F.lit(float("nan")))
    assert all(json.loads(r["result"])["score"] == 0 for r in results.search_json(broken).collect())
    assert {r["score"] for r in results.flat_results(broken).collect()} == {0.0}


def test_shown_results(spark, shaped):
    flat = results.flat_results(shaped).withColumn("q", F.lit(1))
    assert set(flat.columns) >= {"path", "language", "line_start", "line_end", "score", "preview",
                                 "summary", "ref", "repository"}
    shown = results.min_confidence(flat, ["q"], threshold=-1.0)
    assert sorted(r["rank"] for r in shown.collect()) == list(range(1, 21))
    counts = results.result_counts(flat, ["q"], threshold=-1.0).first()
    assert (counts["shown"], counts["passing"], counts["total"], counts["limited"]) == (20, 30, 30, True)
    bars = results.display_pct(shown, ["q"]).orderBy("rank").collect()
    assert bars[0]["pct"] == 100 and min(r["pct"] for r in bars) == 20
    same = results.display_pct(shown.withColumn("score", F.lit(0.5)), ["q"])
    assert {r["pct"] for r in same.collect()} == {100}
    assert results.min_confidence(flat, ["q"]).count() == flat.where("score >= 0.7").count()


def test_clamp_limit(column):
    got = column([(v,) for v in (-3, 0, 1, 7, 20, 99)], "k int", results.clamp_limit(F.col("k")))
    assert got == [1, 1, 1, 7, 20, 20]


def test_key_columns_are_results_columns():
    assert set(NATURAL_KEY) <= set(search.RESULT_COLUMNS)
