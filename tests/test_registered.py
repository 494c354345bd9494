"""Every registered query against its SQL in another engine, on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from gleanery.plans import oracle, registered
from tests.conftest import SMALL

TABLES = ["documents", "embeddings", "pages", "benchmark", "conversations"]


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(([_plain(row[i]) for i in order] for row in rows), key=repr)


def test_every_query_has_sql():
    assert set(registered.queries()) == set(oracle.oracle_sql())
    assert set(registered.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(registered.queries()))
def test_query(spark, sql, name):
    frame = entry.queries()[name](spark, SMALL)
    found = _table(frame.columns, frame.collect())
    other = sql.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in other.description]
    assert found == _table(columns, other.fetchall())
    assert found[1]


def test_entry(spark):
    assert entry.entry(spark).count() == 10
