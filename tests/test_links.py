from pyspark.sql import functions as F

from gleanery.functions import links


def _url(column, rows, **options):
    return column(rows, "p string, a int, b int, r string, f string",
                  links.source_url(*map(F.col, "pabrf"), **options))


def test_source_url(column):
    rows = [
        ("jobs/nightly/clean.sql", None, None, "acme/warehouse", None),
        ("http://files.example.net/x/y/notes.txt", None, None, "", None),
        ("git@github.com:acme/tools/lib/run.rb", None, None, "", None),
        ("etc", None, None, "acme/warehouse.git", "r/2"),
        ("/src/a.py", 3, 9, "https://github.com/o/r.git", "v1"),
        ("src/a.py", 3, 0, "github.com/o/r/tree/x", ""),
        ("see HTTP://x/y.git/z", 1, None, "o/r", None),
        ("a.py", 0, 4, "", None),
    ]
    assert _url(column, rows) == [
        "https://github.com/acme/warehouse/blob/main/jobs/nightly/clean.sql",
        "http://files.example.net/x/y/notes.txt",
        "https://github.com/acme/tools/lib/run.rb",
        "https://github.com/acme/warehouse/blob/r/2/etc",
        "https://github.com/o/r/blob/v1/src/a.py#L3-L9",
        "https://github.com/o/r/blob/main/src/a.py#L3",
        "https://github.com/o/r/blob/main/HTTP://x/y/z#L1",
        None,
    ]
    assert _url(column, rows[-1:], link_base="git.example.org/x/") == [
        "https://git.example.org/x/a.py"]


def test_repo_label(column):
    cases = {
        "https://github.com/o/r.git": "o/r", "github.com/o/r/tree/main": "o/r",
        "https://git.example.org/g/s/r": "s/r", "local": "local", "": "", None: "",
        "https://github.com/o": "github.com/o", "o/r": "o/r",
    }
    got = column([(r,) for r in cases], "r string", links.repo_label(F.col("r")))
    assert dict(zip(cases, got, strict=True)) == cases


def test_is_local(column):
    cases = {"local": True, "my/tree": True, "https://x/y": False, "github.com/o/r": False,
             "x.git": False, "": False, None: False}
    got = column([(r,) for r in cases], "r string", links.is_local(F.col("r")))
    assert dict(zip(cases, got, strict=True)) == cases


def test_display_text(column):
    rows = [("told", "all"), (" \t﻿", "all"), (None, "all"), (" x ", "all")]
    got = column(rows, "s string, p string", links.display_text(F.col("s"), F.col("p")))
    assert got == ["told", "all", "all", " x "]
