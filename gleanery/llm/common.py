"""Helpers that the corpus operators share."""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.session import materialize, new_scratch

#: The white space between words, as bytes and as a pattern.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"

#: Spark's setting by which a query removes its shuffle files when it ends.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Stands for a null doc_id where an order is needed: smaller than any other.
NULL_ID = -(2**63)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character unchanged."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    blank = text
    for space in "\t\n\x0b\x0c\r":
        blank = F.replace(blank, F.lit(space), F.lit(" "))
    words = F.array_remove(F.split(blank, " "), "")
    return F.when(text.isNull(), 0).otherwise(F.size(words)).cast("long")


def uniform(*columns: Column) -> Column:
    """A double in [0, 1) from hashed columns, the same on every run."""
    return F.pmod(F.xxhash64(*columns), F.lit(2**52)).cast("double") / float(2**52)


def unused_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores behind it if a column is called so already."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def job_folder(spark: SparkSession, name: str) -> str:
    """A fresh shared folder for the intermediate tables of one call."""
    return new_scratch(spark, name)


def save(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    return materialize(df, f"{name}-{uuid.uuid4().hex[:6]}", folder)


@contextmanager
def sweeping(spark: SparkSession) -> Iterator[None]:
    """DataFrames made inside remove their shuffle files at the end of each query. Others
    keep them until the driver happens to collect its garbage, so that those of many steps
    lie on disk together."""
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SWEEP)
        else:
            spark.conf.set(SWEEP, before)


def settle(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``save`` that leaves no shuffle files behind."""
    with sweeping(df.sparkSession):
        return save(df.select("*"), folder, name)
