"""Upsert of indexed chunks into the stored table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.schema import CHUNK_COLUMNS, NATURAL_KEY


def with_enrichment(delta: DataFrame, enriched: DataFrame) -> DataFrame:
    """Delta rows with ``summary`` and ``summary_vec`` ready for the upsert.

    Rows that needed nothing keep the summary found and pass no vector.
    """
    joined = delta.join(enriched, NATURAL_KEY, "left")
    return joined.withColumns(
        {
            "summary": F.coalesce("new_summary", "old_summary", F.lit("")),
            "summary_vec": F.col("new_vec"),
        }
    ).drop("new_summary", "new_vec")


def upserted(incoming: DataFrame, stored: DataFrame, run_ts: datetime) -> DataFrame:
    """The incoming rows as they stand after the upsert, with content if they have it.

    ``source_ref``, if present, names the ref a vector may be taken over from;
    all other old values come from the row itself. Old content is not read.
    """
    if "source_ref" not in incoming.columns:
        incoming = incoming.withColumn("source_ref", F.col("ref"))
    incoming = incoming.withColumn("source_ref", F.coalesce("source_ref", "ref"))
    old = stored.select(
        "repository",
        F.col("ref").alias("source_ref"),
        "path",
        "line_start",
        "line_end",
        F.col("id").alias("old_id"),
        F.col("summary").alias("stored_summary"),
        F.col("summary_vec").alias("stored_vec"),
        F.col("summarized_at").alias("stored_at"),
        F.col("created_at").alias("stored_created"),
    )
    joined = incoming.join(
        old, ["repository", "source_ref", "path", "line_start", "line_end"], "left"
    )
    conflict = F.col("old_id").isNotNull() & (F.col("source_ref") == F.col("ref"))
    now = F.lit(run_ts).cast("timestamp")
    given = F.nullif(F.col("summary"), F.lit(""))
    own = lambda column: F.when(conflict, F.col(column))
    carried = [c for c in ("content",) if c in incoming.columns]
    return joined.select(
        F.coalesce(own("old_id"), F.col("id")).alias("id"),
        *NATURAL_KEY,
        "language",
        F.when(conflict, F.coalesce(given, "stored_summary")).otherwise(F.col("summary"))
        .alias("summary"),
        *carried,
        F.coalesce("summary_vec", "stored_vec").alias("summary_vec"),
        "content_hash",
        F.coalesce(F.when(given.isNotNull(), now), own("stored_at")).alias("summarized_at"),
        F.when(conflict, F.col("stored_created")).otherwise(now).alias("created_at"),
    )


def upsert_chunks(incoming: DataFrame, stored: DataFrame, run_ts: datetime) -> DataFrame:
    """The whole table after the upsert; rows no longer delivered stay."""
    kept = stored.join(incoming.select(NATURAL_KEY), NATURAL_KEY, "left_anti")
    fresh = upserted(incoming, stored, run_ts).select(CHUNK_COLUMNS)
    return fresh.unionByName(kept.select(CHUNK_COLUMNS))
