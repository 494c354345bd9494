import os
import time

import pytest
from pyspark.sql import functions as F

from gleanery.functions.paths import should_skip
from gleanery.session import new_scratch
from gleanery.sources import tree, tree_source
from gleanery.sources.tree_source import TreeSource, TreeStreamReader

CONTENTS = {
    "main.go": b"package main", "empty.py": b"", ".github/ci.yml": b"on: push",
    "vendor/lib.go": b"no", "deep/a/b/c/d.txt": b"deep", "image.PNG": b"no", "raw": b"\xff\x00",
}
KEPT = {"main.go", "empty.py", ".github/ci.yml", "deep/a/b/c/d.txt", "raw"}


@pytest.fixture
def root(spark, tmp_path):
    spark.dataSource.register(TreeSource)
    for name, content in CONTENTS.items():
        write(tmp_path / "proj", name, content)
    return tmp_path / "proj"


def write(root, name, content):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)


def names(rows, root):
    return sorted(r["path"].removeprefix(f"{root}/") for r in rows)


def test_same_rows_as_scan_tree(spark, root):
    read = spark.read.format("source_tree").option("root", str(root)).load()
    columns = ["repository", "ref", "root", "path", "content"]
    found = sorted(map(tuple, read.select(columns).collect()))
    assert found == sorted(map(tuple, tree.scan_tree(spark, str(root)).select(columns).collect()))
    assert names(read.collect(), root) == sorted(KEPT)
    named = spark.read.format("source_tree").options(root=str(root), repository="r", ref="v1").load()
    assert {(r["repository"], r["ref"]) for r in named.collect()} == {("r", "v1")}


def test_missing_root_and_option(spark, root):
    with pytest.raises(Exception, match="names the tree"):
        spark.read.format("source_tree").load().collect()
    with pytest.raises(Exception, match="FileNotFound"):
        spark.read.format("source_tree").option("root", f"{root}/missing").load().collect()


def test_empty_tree(spark, root):
    (root / "none").mkdir()
    assert spark.read.format("source_tree").option("root", f"{root}/none").load().count() == 0


@pytest.mark.parametrize("budget", [1, 3, 100])
def test_every_file_is_in_one_part(root, monkeypatch, budget):
    monkeypatch.setattr(tree, "LIST_BUDGET", budget)
    reader = tree_source.TreeReader({"root": str(root), "tasks": "2"})
    parts = reader.partitions()
    found = [p for part in parts for batch in reader.read(part) for p in batch.column("path").to_pylist()]
    assert sorted(p.removeprefix(f"{root}/") for p in found) == sorted(KEPT)
    assert any(part.folders for part in parts) == (budget < 100)


def test_parts_and_batches_have_bounds(root, monkeypatch):
    monkeypatch.setattr(tree_source, "TASK_BYTES", 4)
    monkeypatch.setattr(tree, "BATCH_BYTES", 1)
    reader = tree_source.TreeReader({"root": str(root)})
    parts = reader.partitions()
    assert len(parts) > 2
    rows = [b.num_rows for part in parts for b in reader.read(part)]
    assert sum(rows) == len(KEPT)


def test_a_folder_that_goes_away_is_empty(root, monkeypatch):
    monkeypatch.setattr(tree, "LIST_BUDGET", 1)
    reader = tree_source.TreeReader({"root": str(root)})
    parts = reader.partitions()
    os.rename(root / "deep", root.parent / "elsewhere")
    found = [p for part in parts for b in reader.read(part) for p in b.column("path").to_pylist()]
    assert not any("deep" in p for p in found)


def test_skip_rule_is_that_of_the_scan(spark):
    paths = [
        "/a/main.go", "/a/x.PNG", "/a/vendor/x.go", "/vendor", "/a/.git/x", "/a.lock/b", "/a/b.lock",
        "/a/.sql", "/a/sql", "/a/x.sql.py", "/Build/x", "/a/no.", "", "/a/Node_Modules/b.js", "/a/é.MOD",
    ]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    wanted = {r["path"]: r["skip"] for r in rows.select("path", should_skip(F.col("path")).alias("skip")).collect()}
    assert {p: tree_source.skipped(p) for p in paths} == wanted


def run(spark, root, base):
    changes = spark.readStream.format("source_tree").options(root=str(root), settle=0.1)
    stream = changes.load().writeStream.trigger(availableNow=True).format("parquet").start(
        f"{base}/out", checkpointLocation=f"{base}/checkpoint")
    stream.awaitTermination()
    return spark.read.schema("path string, content binary").parquet(f"{base}/out").collect()


def test_a_restart_delivers_no_file_twice(spark, root):
    base = new_scratch(spark, "changed")
    time.sleep(0.2)
    assert names(run(spark, root, base), root) == sorted(KEPT)
    assert names(run(spark, root, base), root) == sorted(KEPT)
    write(root, "main.go", b"changed")
    write(root, "new/file.py", b"new")
    os.utime(root / "new/file.py", (1, 1))  # an old time of its content hides no file
    time.sleep(0.2)
    rows = run(spark, root, base)
    assert names(rows, root) == sorted([*KEPT, "main.go", "new/file.py"])
    assert {bytes(r["content"]) for r in rows if r["path"].endswith("main.go")} == {
        b"package main", b"changed"}


def test_windows_share_no_file_and_leave_none_out(root):
    reader = TreeStreamReader({"root": str(root), "settle": "0"})
    time.sleep(0.05)
    first = reader.latestOffset()
    write(root, "late.py", b"late")
    time.sleep(0.05)
    second = reader.latestOffset()

    def found(start, end):
        return sorted(path.removeprefix(f"{root}/") for part in reader.partitions(start, end)
                      for path, _ in reader.tree._files(part))

    assert found(reader.initialOffset(), first) == sorted(KEPT)
    assert found(first, second) == ["late.py"]
    assert found(reader.initialOffset(), second) == sorted([*KEPT, "late.py"])
    assert reader.partitions(second, second) == []
    # A replayed batch leaves out what changed meanwhile; the next one has it.
    write(root, "late.py", b"later")
    assert found(first, second) == []
