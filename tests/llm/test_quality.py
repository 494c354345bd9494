import tracemalloc
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.llm import quality
from tests.llm.conftest import ODD

LARGER = "/root/testdata/sf0.01"


def test_marginals_against_all_labelings():
    """Forward-backward equals the sum over every labeling of short chains."""
    rng = np.random.default_rng(2)
    at = np.array([0, 3, 4, 8])
    scores, links = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    chances, pairs = quality.marginals(scores, links, at, np.ones(8))
    expected, joint = np.zeros((8, 2)), np.zeros((2, 2))
    for a, b in zip(at[:-1], at[1:], strict=True):
        weights = {}
        for labels in product((0, 1), repeat=b - a):
            total = sum(scores[a + i, y] for i, y in enumerate(labels))
            total += sum(links[x, y] for x, y in zip(labels, labels[1:], strict=False))
            weights[labels] = np.exp(total)
        whole = sum(weights.values())
        for labels, w in weights.items():
            for i, y in enumerate(labels):
                expected[a + i, y] += w / whole
            for x, y in zip(labels, labels[1:], strict=False):
                joint[x, y] += w / whole
    assert np.allclose(chances, expected)
    assert np.allclose(pairs, joint)


def test_lines():
    """Lines never cross texts, and their lengths add up."""
    texts = ["one\ntwo\n", "", "\n\nx", "no break"]
    values, offsets = quality.text_buffers(pa.array(texts, pa.large_string()))
    features, lengths, at = quality.line_features(values, offsets)
    assert at.tolist() == [0, 3, 4, 7, 8]
    assert lengths.tolist() == [3, 3, 0, 0, 0, 0, 1, 8]
    assert len(features) == 8


def test_held_out_accuracy(spark):
    """Rows that never trained are told apart."""
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    found = quality.op5_quality_crf(spark.read.parquet(f"{LARGER}/documents.parquet"), labels)
    rows = found.join(labels, "doc_id").where("held_out").collect()
    good = [r.predicted == 1 for r in rows if r.quality == 1]
    bad = [r.predicted == 0 for r in rows if r.quality == 0]
    assert sum(good) / len(good) >= 0.97
    assert sum(bad) / len(bad) >= 0.85
    assert all((r.score >= 0.5) == r.predicted and 0 <= r.score <= 1 for r in rows)


@pytest.fixture
def labels(spark):
    def make(*rows):
        return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")

    return make


def _training(documents):
    good = [(100 + i, f"A calm line of text number {i}.\nAnd one more of them.") for i in range(40)]
    bad = [(300 + i, f"BUY!! NOW!! {i}!!\n$$$ *** ###") for i in range(40)]
    return good, bad


def test_awkward_rows(spark, documents, labels):
    good, bad = _training(documents)
    frame = documents(*ODD, *good, *bad).withColumn("score", F.lit("x"))
    marks = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad]
    marks += [(100, 1, 0), (None, 1, 0), (9999, 0, 0), (101, None, 0), (102, 7, 0)]
    rows = quality.op5_quality_crf(frame, labels(*marks)).collect()
    assert len(rows) == len(ODD) + 80
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == 1 for r in rows if 100 <= (r.doc_id or 0) < 200)
    assert all(r.predicted == 0 for r in rows if 300 <= (r.doc_id or 0) < 400)
    for r in rows:
        expected = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1
        assert r.held_out == expected
    twice = [r.score for r in rows if r.doc_id == 5]
    assert twice[0] == twice[1]
    empty = {r.score for r in rows if r.doc_id in (1, 2)}
    assert len(empty) == 1


def test_labels_of_one_kind_or_none(documents, labels):
    frame = documents((1, "a"), (2, "b"))
    assert {r.score for r in quality.op5_quality_crf(frame, labels()).collect()} == {0.5}
    marks = labels(*[(i, 1, 0) for i in range(9)])
    assert {r.score for r in quality.op5_quality_crf(frame, marks).collect()} <= {0.5, 1.0}


def test_empty_table(documents, labels):
    assert quality.op5_quality_crf(documents(), labels((1, 1, 0))).collect() == []


def test_training_holds_the_arrays_of_a_slice(monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 1)
    texts = [f"word{i} " * 3000 + "\n" + "x y\n" * (i % 5) for i in range(300)]
    whole = quality.line_features(*quality.text_buffers(pa.array(texts, pa.large_string())))
    for a, b in zip(quality._all_lines(texts), whole, strict=True):
        assert np.array_equal(a, b)
    tracemalloc.start()
    quality.fit(texts, [i % 2 for i in range(300)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * sum(map(len, texts))
