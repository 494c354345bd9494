"""Exact and line dedup: SQL on the small tables, defined cases on fixtures."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as entry
from gleanery.llm import exact_dedup, line_dedup
from tests.llm.conftest import ODD


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op9_line_dedup"])
def test_sql(spark, small, name):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    other = connection.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in other.description]
    frame = entry.queries()[name](spark, small)
    assert sorted(frame.columns) == sorted(columns)
    assert sorted(map(tuple, frame.select(columns).collect())) == sorted(other.fetchall())


def _fold(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def test_exact_awkward_rows(odd):
    rows = exact_dedup.op4_exact_dedup(odd).collect()
    assert len(rows) == len(ODD)
    groups = {}
    for doc_id, text in ODD:
        groups.setdefault(_fold(text), []).append(doc_id)
    expected = sorted(
        (
            doc_id is not None, doc_id or 0, max((i for i in ids if i is not None), default=None),
            len(ids), hashlib.sha256(text.encode()).hexdigest(),
        )
        for text, ids in groups.items()
        for doc_id in ids
    )
    assert expected == sorted(
        (r.doc_id is not None, r.doc_id or 0, r.keep_id, r.group_size, r.text_sha256) for r in rows
    )
    # One row of every group stays, also among rows that repeat.
    assert sum(r.kept for r in rows) == len(groups)


def test_exact_levels(documents):
    """Equal length and prefix with another end; equal after folding A-Z only."""
    long = "p" * exact_dedup.PREFIX
    frame = documents((1, long + "a"), (2, long + "b"), (3, long + "B"), (4, "Ä"), (5, "ä"))
    kept = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(frame).collect()}
    assert kept == {1: (1, True), 2: (3, False), 3: (3, True), 4: (4, True), 5: (5, True)}


def test_exact_empty_table(documents):
    assert exact_dedup.op4_exact_dedup(documents()).collect() == []


def test_exact_reads_survivors_only(documents):
    frame = exact_dedup.exact_dedup(documents((1, "a"), (2, "bb"), (3, "bb")))
    assert {r.doc_id: r.full_hash is None for r in frame.collect()} == {1: True, 2: False, 3: False}


def test_line_awkward_rows(odd):
    rows = line_dedup.line_dedup(odd).collect()
    assert len(rows) == len(ODD)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert (by_id[1][0].n_lines, by_id[1][0].kept_text) == (0, "")
    assert (by_id[2][0].n_lines, by_id[2][0].kept_text) == (1, "")
    assert by_id[3][0].kept_text == " \t\n"
    assert all(r.n_removed == 0 for r in rows)  # no chunk of two lines repeats elsewhere
    assert by_id[5][0] == by_id[5][1]


def _block(name, n=40):
    return [f"{name} line number {i} of a long block" for i in range(n)]


def test_line_shifted_copies(documents):
    """A block inside other lines is found at any offset; its first place stays."""
    shared = _block("shared")
    frame = documents(
        (1, "\n".join(_block("a", 3) + shared)),
        (2, "\n".join(_block("b", 8) + shared + _block("c", 2))),
    )
    one, two = sorted(line_dedup.line_dedup(frame).collect())
    assert one.n_removed == 0
    assert two.n_removed >= 30
    assert two.kept_text.startswith("b line number 0")
    assert two.n_lines - two.n_removed == len(two.kept_text.split("\n"))


def test_line_single_lines_stay(documents):
    frame = documents((1, "same"), (2, "same"), (3, "same\nother"))
    assert all(r.n_removed == 0 for r in line_dedup.line_dedup(frame).collect())


def test_line_empty_table(documents):
    assert line_dedup.op9_line_dedup(documents()).collect() == []
