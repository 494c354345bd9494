import duckdb
import pytest
from pyspark.sql import Row  # noqa: F401

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

#: A passage of 60 different words.
PASSAGE = " ".join(f"word{i}" for i in range(60))


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, source)."""

    def make(*rows):
        full = [
            (r[0], r[1], "en", r[2] if len(r) > 2 else "s0", len(r[1] or "")) for r in rows
        ]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def small_texts(small):
    return duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()


#: Null, empty and white-space texts, null ids, repeated rows, ties.
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (None, "a null id"),
    (5, PASSAGE),
    (5, PASSAGE),
    (6, PASSAGE.upper()),
    (7, "one"),
    (7, "another text of the same id"),
    (8, "x" * 50_000),
    (9, ("Grüße, été! " * 3000).strip()),
]


@pytest.fixture
def odd(spark, documents):
    """Awkward rows, with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["shard", "slot", "kept", "score", "size", "key", "part", "n", "node", "copies"]
    names += ["_key", "_row_hash", "_copy", "_score", "_bucket", "removed", "text_", "row", "copy"]
    return documents(*ODD).withColumns({n: F.lit("extra") for n in names})
