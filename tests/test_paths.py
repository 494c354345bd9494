from pyspark.sql import functions as F

from gleanery.functions import paths


def test_should_skip(column):
    cases = {
        "/w/jobs/etl.scala": False,
        "/w/node_modules/left/pad.js": True,
        "/w/vendor/a/b/c.rs": True,
        "/w/sub/.git/HEAD": True,
        "/w/scan.jpeg": True,
        "/w/manual.zip": True,
        "/w/go.sum": True,
        "/w/notes/today.md": False,
        "/w/bin.sh": False,
        "/project/Build/x.c": True,
        "vendor/lib.go": False,  # a marker needs its leading slash
        "/project/rebuild/x.c": False,
        "/project/IMAGE.PNG": True,
        "/a/.cache/x": True,
        "/a/b.sql/c": False,
    }
    got = column([(p,) for p in cases], "p string", paths.should_skip(F.col("p")))
    assert dict(zip(cases, got, strict=True)) == cases


def test_guess_lang(column):
    cases = {
        "cmd/serve.go": "go",
        "etl/load.py": "python",
        "docs/usage.md": "markdown",
        "ci/jobs.yml": "yaml",
        "data/rows.json": "json",
        "tools/run.sh": "shell",
        "web/view.js": "javascript",
        "web/model.ts": "typescript",
        "net/main.tf": "terraform",
        "plans/harbour.dwg": "dwg",
        "Makefile": "",
        ".gitignore": "gitignore",
        "a.b/Makefile": "",
        "a/x.TAR.GZ": "gz",
        "odd.": "",
        "x.PY": "python",
    }
    got = column([(p,) for p in cases], "p string", paths.guess_lang(F.col("p")))
    assert dict(zip(cases, got, strict=True)) == cases


def test_rel_path(column):
    cases = [
        ("/mnt/trees/app", "/mnt/trees/app/lib/queue.rb", "lib/queue.rb"),
        ("/mnt/trees/app/", "/mnt/trees/app/setup.cfg", "setup.cfg"),
        ("/elsewhere", "/mnt/trees/app/lib/queue.rb", "../mnt/trees/app/lib/queue.rb"),
        ("/a/b", "/a/bc/d", "../bc/d"),
        ("/a/b/c", "/a/x", "../../x"),
        ("/a", "/a", "."),
        ("/a", "rel/x", "rel/x"),
        ("rel", "/a/x", "/a/x"),
        ("", "src/x.py", "src/x.py"),
        (".", "src/x.py", "src/x.py"),
        ("/", "/etc/x", "etc/x"),
        ("/a", "/a//b/./c", "b/c"),
    ]
    got = column([c[:2] for c in cases], "r string, p string",
                 paths.rel_path(F.col("r"), F.col("p")))
    assert got == [c[2] for c in cases]


def test_default_ref(column):
    got = column([("/work/tree",), ("/work/tree/",), ("tree",)], "r string",
                 paths.default_ref(F.col("r")))
    assert got == ["tree"] * 3
