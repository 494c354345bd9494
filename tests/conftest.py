import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from gleanery.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        spark_sql_shuffle_partitions=2,
        spark_ui_enabled="false",
        spark_ui_showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture
def column(spark):
    """Values of a column expression over rows of named inputs, in order."""

    def run(rows, schema, expression):
        numbered = spark.createDataFrame(
            [(i, *row) for i, row in enumerate(rows)], f"row int, {schema}"
        )
        found = numbered.select("row", expression.alias("value")).collect()
        return [r["value"] for r in sorted(found, key=lambda r: r["row"])]

    return run
