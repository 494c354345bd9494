import os

import pytest

from gleanery.sources import tree


@pytest.fixture
def root(tmp_path):
    contents = {
        "main.go": b"package main", "__init__.py": b"", ".github/ci.yml": b"on: push",
        "_private/x.py": b"1", "vendor/lib.go": b"no", "deep/a/b/c/d.txt": b"deep",
        "image.png": b"no", "deep/node_modules/m.js": b"no", "raw.bin": b"\xff\x00",
    }
    for name, content in contents.items():
        path = tmp_path / "proj" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    os.symlink(tmp_path / "proj" / "deep", tmp_path / "proj" / "loop")
    os.symlink(tmp_path / "proj" / "main.go", tmp_path / "proj" / "link.go")
    os.symlink(tmp_path / "nowhere", tmp_path / "proj" / "dangling.go")
    return str(tmp_path / "proj")


EXPECTED = {"main.go": b"package main", "__init__.py": b"", ".github/ci.yml": b"on: push",
            "_private/x.py": b"1", "deep/a/b/c/d.txt": b"deep", "raw.bin": b"\xff\x00",
            "link.go": b"package main"}


def test_scan_tree(spark, root):
    rows = tree.scan_tree(spark, root).collect()
    assert {r["path"].removeprefix(root + "/"): bytes(r["content"]) for r in rows} == EXPECTED
    assert {(r["repository"], r["ref"]) for r in rows} == {("local", "proj")}


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_scan_jobs(spark, root, scheme):
    jobs = spark.createDataFrame(
        [("https://host/a.git", "v1", f"{scheme}{root}/deep"), ("", "x", f"{scheme}{root}/.github")],
        "repository string, ref string, root string")
    got = {(r["repository"], r["ref"], r["path"].split("/")[-1])
           for r in tree.scan_jobs(jobs).collect()}
    assert got == {("https://host/a.git", "v1", "d.txt"), ("local", ".github", "ci.yml")}


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_what_cannot_be_listed_raises(spark, root, scheme, monkeypatch):
    for name in ("missing", "main.go"):
        with pytest.raises(Exception, match="FileNotFound|NotADirectory"):
            tree.scan_tree(spark, f"{scheme}{root}/{name}").collect()


def test_forbidden_folder_raises(root, monkeypatch):
    tries = []

    def entries(folder):
        tries.append(folder)
        raise PermissionError(folder) if "secret" in folder else OSError("busy")

    monkeypatch.setattr(tree, "_entries", entries)
    monkeypatch.setattr(tree.time, "sleep", lambda _: None)
    with pytest.raises(PermissionError):
        tree.listed("/secret")
    with pytest.raises(OSError, match="busy"):
        tree.listed("/shared")
    assert tries == ["/secret", "/shared", "/shared", "/shared"]


def test_too_long_files_are_unreadable(root, monkeypatch):
    monkeypatch.setattr(tree, "LONGEST_FILE", 5)
    assert tree._read_file(f"{root}/deep/a/b/c/d.txt") == b"deep"
    assert tree._read_file(f"{root}/main.go") is None


def test_small_budget_takes_more_rounds(spark, root, monkeypatch):
    monkeypatch.setattr(tree, "LIST_BUDGET", 1)
    rows = tree.scan_tree(spark, root).collect()
    assert len(rows) == len(EXPECTED)


def test_unreadable_files(spark, root, monkeypatch):
    jobs = spark.createDataFrame([("r", "m", root)], "repository string, ref string, root string")
    listed = tree.list_files(jobs)
    os.remove(f"{root}/main.go")  # gone between listing and reading
    monkeypatch.setattr(tree, "list_files", lambda _: listed)
    kept = {r["path"].split("/")[-1]: r["content"] for r in tree.scan_jobs(jobs, True).collect()}
    assert kept["main.go"] is None and kept["link.go"] is None
    counts = tree.unreadable_files(tree.scan_jobs(jobs, True)).collect()
    assert [(r["repository"], r["ref"], r["files"]) for r in counts] == [("r", "m", 2)]
    assert "main.go" not in [r["path"].split("/")[-1] for r in tree.scan_jobs(jobs).collect()]


def test_root_below_a_marker_skips_everything(spark, tmp_path):
    inner = tmp_path / "build" / "proj"
    inner.mkdir(parents=True)
    (inner / "a.py").write_bytes(b"1")
    assert tree.scan_tree(spark, str(inner)).count() == 0


def test_remote_paths(monkeypatch):
    class System:
        pass

    bases = {"hdfs://host:9/": "/", "s3://bucket/": "bucket", "gs://b/": "b/"}
    monkeypatch.setattr(tree, "_file_system", lambda address: (System, bases[address]))
    for path, inside in [("hdfs://host:9/a/b", "/a/b"), ("s3a://bucket/a", "bucket/a"), ("gs://b/x", "b/x")]:
        system, got, before = tree.open_store(path)
        assert (system, got) == (System, inside)
        assert before + got == path


def test_disabled_jobs_are_left_out(spark, root):
    jobs = spark.createDataFrame(
        [("a", "m", f"{root}/deep", False), ("b", "m", f"{root}/deep", True), ("c", "m", f"{root}/deep", None)],
        "repository string, ref string, root string, enabled boolean")
    assert {r["repository"] for r in tree.scan_jobs(jobs).collect()} == {"b", "c"}
