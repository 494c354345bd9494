"""What an indexing run has to do: new chunks against the stored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import content as content_rules
from gleanery.functions.paths import guess_lang, rel_path
from gleanery.schema import NATURAL_KEY, SPAN_KEY


def chunk_files(files: DataFrame) -> DataFrame:
    """One chunk per scanned file, without summary and vector.

    Content that no text column can hold is left out; ``unstorable_files`` counts it.
    """
    return (
        files.withColumn("content", content_rules.storable_text(F.col("content")))
        .where(F.col("content").isNotNull())
        .withColumn("language", guess_lang(F.col("path")))
        .withColumn("path", rel_path(F.col("root"), F.col("path")))
        .withColumn("line_start", F.lit(1))
        .withColumn("line_end", content_rules.line_count(F.col("content")))
        .select(
            content_rules.chunk_id(F.col("path"), F.col("line_start"), F.col("line_end")).alias("id"),
            *NATURAL_KEY,
            "language",
            "content",
            content_rules.content_hash(F.col("content")).alias("content_hash"),
        )
    )


def unstorable_files(files: DataFrame) -> DataFrame:
    """How many files per repository and ref have content no text column can hold."""
    bad = files.where(content_rules.storable_text(F.col("content")).isNull())
    return bad.groupBy("repository", "ref").agg(F.count("*").alias("files"))


def meta_lookup(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New chunks with what is stored about them.

    Adds ``found``, ``old_hash``, ``old_summary``, ``old_has_vec``, ``old_language`` (of a
    row of the same ref) and ``source_ref``, the ref whose row answered. A row of the same ref comes first;
    else the lowest other ref of the repository holding the same content.
    """
    facts = stored.select(
        *NATURAL_KEY,
        F.col("content_hash").alias("old_hash"),
        F.coalesce("summary", F.lit("")).alias("old_summary"),
        F.col("summary_vec").isNotNull().alias("old_has_vec"),
        F.col("language").alias("old_language"),
    )
    same = facts.withColumn("in_ref", F.lit(True))
    # Copies of one file over many refs shrink to one row before they move.
    donors = facts.groupBy(*SPAN_KEY, F.col("old_hash").alias("content_hash")).agg(
        F.min_by(F.struct("old_summary", "old_has_vec", "ref"), "ref").alias("donor")
    )
    joined = new.join(same, NATURAL_KEY, "left").join(
        donors, [*SPAN_KEY, "content_hash"], "left"
    )
    own = F.coalesce("in_ref", F.lit(False))
    donated = ~own & F.col("donor").isNotNull()
    return joined.select(
        *new.columns,
        (own | donated).alias("found"),
        F.when(own, F.col("old_hash")).when(donated, F.col("content_hash")).alias("old_hash"),
        F.when(own, F.col("old_summary")).when(donated, F.col("donor.old_summary"))
        .alias("old_summary"),
        F.when(own, F.col("old_has_vec")).when(donated, F.col("donor.old_has_vec"))
        .alias("old_has_vec"),
        F.when(own, F.col("old_language")).alias("old_language"),
        F.when(own, F.col("ref")).when(donated, F.col("donor.ref")).alias("source_ref"),
    )


def index_delta(looked_up: DataFrame) -> DataFrame:
    """Flags for the costly steps: a summary, an embedding, or neither."""
    changed = ~F.col("found") | ~F.col("old_hash").eqNullSafe(F.col("content_hash"))
    return looked_up.withColumns(
        {
            "need_summary": changed | (F.col("old_summary") == ""),
            "need_embed": changed | ~F.col("old_has_vec"),
        }
    )


def unchanged(delta: DataFrame) -> Column:
    """Rows of ``index_delta`` that an upsert would give a new time stamp and nothing else."""
    return (
        F.col("source_ref").eqNullSafe(F.col("ref"))
        & ~F.col("need_summary")
        & ~F.col("need_embed")
        & F.col("old_language").eqNullSafe(F.col("language"))
    )


def flagged_content(new: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows of ``index_delta`` that need a provider, with their content.

    Lookup and flags run without content, once per key and hash; content joins what they
    flagged at the end and moves once.
    """
    key = [*NATURAL_KEY, "content_hash"]
    thin = new.drop("content").dropDuplicates(key)
    delta = index_delta(meta_lookup(thin, stored))
    flagged = delta.where(F.col("need_summary") | F.col("need_embed"))
    content = new.select(*[F.col(c).alias(f"_{c}") for c in key], "content")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    return content.join(flagged, same).select(*flagged.columns, "content")
