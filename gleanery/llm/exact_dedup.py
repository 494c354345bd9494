"""Exact dedup by progressive refinement: length, prefix hash, full hash.

Defined cases: a null text counts as empty; a null doc_id is smaller than any other
and comes back as null; of rows that repeat both doc_id and text exactly one stays;
an empty table gives an empty result; only the two named columns are read, so other
columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import lower_ascii

#: Characters of a text that the second level hashes.
PREFIX = 256


def normal_text(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def _thin(docs: DataFrame, id_column: str, text_column: str) -> list[Column]:
    text = F.coalesce(F.col(text_column), F.lit(""))
    return [
        F.col(id_column).alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(lower_ascii(F.substring(text, 1, PREFIX))).alias("prefix_hash"),
    ]


def exact_dedup(documents: DataFrame, id_column="doc_id", text_column="text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, prefix_hash, full_hash, keep_id,
    group_size, kept.

    Texts that differ in A-Z case only are equal; the largest doc_id of a group stays.
    Rows are counted per length and per length and prefix first. Only texts that still
    share both with another row are read in full and hashed (``full_hash``; null for
    the rest). All groupings combine before they shuffle, so a large group of copies
    is one row per task; the joins back are plain equi-joins that Spark splits.
    """
    thin = documents.select(_thin(documents, id_column, text_column))
    rows = thin.groupBy("doc_id", "n_bytes", "prefix_hash").agg(F.count("*").alias("n"))
    prefixes = rows.groupBy("n_bytes", "prefix_hash").agg(F.sum("n").alias("rows"))
    lengths = prefixes.groupBy("n_bytes").agg(F.sum("rows").alias("of_length"))
    shared = (
        prefixes.where("rows > 1")
        .join(lengths.where("of_length > 1"), "n_bytes", "left_semi")
        .select("n_bytes", "prefix_hash")
    )
    alone = (
        rows.join(prefixes.where("rows = 1"), ["n_bytes", "prefix_hash"], "left_semi")
        .select(
            "doc_id", "n_bytes", "prefix_hash",
            F.lit(None).cast("string").alias("full_hash"),
            F.col("doc_id").alias("keep_id"),
            F.lit(1).cast("long").alias("group_size"),
            F.lit(True).alias("kept"),
        )
    )
    text = F.coalesce(F.col(text_column), F.lit(""))
    surviving = (
        documents.select(*_thin(documents, id_column, text_column), text.alias("content"))
        .join(shared, ["n_bytes", "prefix_hash"], "left_semi")
        .groupBy(
            "doc_id", "n_bytes", "prefix_hash",
            F.sha2(lower_ascii("content"), 256).alias("full_hash"),
        )
        .agg(F.count("*").alias("n"))
    )
    groups = surviving.groupBy("n_bytes", "full_hash").agg(
        F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")
    )
    copies = (
        surviving.join(groups, ["n_bytes", "full_hash"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        .select(
            "doc_id", "n_bytes", "prefix_hash", "full_hash", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        )
    )
    return alone.unionByName(copies)


def op4_exact_dedup(documents: DataFrame) -> DataFrame:
    """The decisions with the digest of every text.

    Rows whose length and prefix are unique were never read in full by the operator;
    the report digests them where they lie and finds them by that unique pair.
    """
    found = exact_dedup(documents)
    digests = documents.select(
        *_thin(documents, "doc_id", "text"),
        F.sha2(normal_text(F.col("text")), 256).alias("text_sha256"),
    ).distinct()
    f, d = found.alias("f"), digests.alias("d")
    same = (
        F.col("f.doc_id").eqNullSafe(F.col("d.doc_id"))
        & (F.col("f.n_bytes") == F.col("d.n_bytes"))
        & (F.col("f.prefix_hash") == F.col("d.prefix_hash"))
        & (F.col("f.full_hash").isNull() | (F.col("f.full_hash") == F.col("d.text_sha256")))
    )
    return f.join(d, same).select(
        "f.doc_id", "f.keep_id", "f.group_size", "f.kept", "d.text_sha256"
    )


OP4_SQL = """
WITH normal AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM normal
"""
