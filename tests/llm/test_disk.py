"""What the near-duplicate step leaves and moves on the executors' disks."""

import os
import time
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from gleanery.llm import common, minhash_dedup, sieve
from gleanery.session import shared_folder
from tests.llm.conftest import PASSAGE


def _shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = manager.getAllFiles().mkString("\n").split("\n")
    return {n for n in names if "/shuffle_" in n}


def _left(spark, before):
    """Shuffle files besides those of ``before``; they are removed in the background."""
    for _ in range(50):
        found = _shuffle_files(spark) - before
        if not found:
            break
        time.sleep(0.1)
    return found


def _rows(n):
    """Different texts, of which every tenth stands there twice."""
    texts = [" ".join(f"w{i}.{j}" for j in range(20 + i % 7)) for i in range(n)]
    return [(i, t) for i, t in enumerate(texts)] + [(n + i, texts[i]) for i in range(0, n, 10)]


def test_settled_tables_leave_no_shuffle_files(spark, tmp_path):
    before, setting = _shuffle_files(spark), spark.conf.get(common.SWEEP, None)
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    stored = common.settle(counted, str(tmp_path), "counted")
    assert not _left(spark, before)
    assert spark.conf.get(common.SWEEP, None) == setting
    assert sum(r["count"] for r in stored.collect()) == 1000


@pytest.mark.parametrize("crowded", [False, True])
def test_steps_leave_nothing(spark, documents, monkeypatch, crowded):
    """All shuffle files of the steps are gone before the result is read, and so are the
    tables that it does not need."""
    if crowded:
        monkeypatch.setattr(minhash_dedup, "SHORT", 3)
        monkeypatch.setattr(minhash_dedup, "FEW", 1)
    rows = _rows(60)
    rows += [(500 + i, f"{PASSAGE} {' '.join(f'e{i}.{j}' for j in range(i % 4))}") for i in range(20)]
    shared = urlparse(shared_folder(spark)).path
    before, folders = _shuffle_files(spark), set(os.listdir(shared))
    kept = minhash_dedup.keep_one(documents(*rows))
    assert not _left(spark, before)
    new = set(os.listdir(shared)) - folders
    assert [n.rsplit("-", 1)[0] for n in new] == ["near-copies"]
    assert {r.doc_id for r in kept.collect()} == {*range(60), 500}


def test_texts_that_nothing_is_like_do_not_move(documents, monkeypatch):
    rows, moved = _rows(400), []
    plain = sieve.Sieve.passing

    def passing(self, table, hashed):
        found = plain(self, table, hashed)
        if {"text", "row"} & set(table.columns):
            moved.append(found.count())
        return found

    monkeypatch.setattr(sieve.Sieve, "passing", passing)
    assert minhash_dedup.keep_one(documents(*rows)).count() == 400
    # No sets are needed (copies have one node), and only the 40 second copies may go.
    assert len(moved) == 2 and moved[0] <= 10 and 40 <= moved[1] <= 60


@pytest.mark.parametrize("most", [1 << 27, 1 << 6])
def test_sieve(spark, monkeypatch, most):
    """No key is stopped, each row is on one side, and a full filter stops little."""
    monkeypatch.setattr(sieve, "MOST_BITS", most)
    table = spark.range(5000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"))
    hashed = F.xxhash64("id")
    found = sieve.Sieve(table.where("id is null or id % 50 = 0"), hashed)
    inside = [r.id for r in found.passing(table, hashed).collect()]
    outside = [r.id for r in found.stopped(table, hashed).collect()]
    assert {None, *range(50, 5000, 50)} <= set(inside)
    assert sorted((x or 0) for x in inside + outside) == list(range(5000))
    assert len(inside) > 4000 if most == 1 << 6 else len(inside) < 300
    nothing = sieve.Sieve(table.where("id < 0"), hashed)
    assert nothing.passing(table, hashed).count() == 0 and nothing.stopped(table, hashed).count() == 5000
