"""Shaping of search results ``(chunk, score)`` for clients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.scoring import sanitize_score

MIN_CONFIDENCE = 0.7
MAX_SHOWN = 20


def clamp_limit(k: Column) -> Column:
    """The limit a client may ask for."""
    return F.least(F.greatest(k, F.lit(1)), F.lit(MAX_SHOWN))


def flat_results(results: DataFrame) -> DataFrame:
    """One flat row per result; the preview is the full content.

    Rows that are flat already stay as they are.
    """
    if "chunk" not in results.columns:
        return results
    others = [c for c in results.columns if c not in ("chunk", "score")]
    return results.select(
        *others,
        "chunk.path",
        "chunk.language",
        "chunk.line_start",
        "chunk.line_end",
        sanitize_score(F.col("score")).alias("score"),
        F.col("chunk.content").alias("preview"),
        "chunk.summary",
        "chunk.ref",
        "chunk.repository",
    )


def _rfc3339(time: Column) -> Column:
    """Time as text, without trailing zeros in the fraction."""
    text = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return F.regexp_replace(text, r"\.?0*(Z|[+-]\d\d:\d\d)\z", "$1")


def search_json(results: DataFrame) -> DataFrame:
    """Results as JSON objects, one per row, with finite scores."""
    others = [c for c in results.columns if c not in ("chunk", "score")]
    chunk = F.col("chunk").withField("created_at", _rfc3339(F.col("chunk.created_at")))
    packed = F.struct(chunk.alias("chunk"), sanitize_score(F.col("score")).alias("score"))
    options = {"ignoreNullFields": "false"}
    return results.select(*others, F.to_json(packed, options).alias("result"))


def json_body(results: DataFrame) -> DataFrame:
    """The results of one search (at most k rows) as one JSON array, ``[]`` if none."""
    lines = search_json(results).agg(
        F.array_sort(F.collect_list(F.struct("rank", "result"))).alias("rows")
    )
    texts = F.transform("rows", lambda row: row["result"])
    return lines.select(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")).alias("body"))


def min_confidence(
    flat: DataFrame, by: list[str], threshold: float = MIN_CONFIDENCE, shown: int = MAX_SHOWN
) -> DataFrame:
    """Results at or above the threshold, the first 20 of each search."""
    order = Window.partitionBy(*by).orderBy("rank")
    return (
        flat.where(F.col("score") >= threshold)
        .withColumn("shown_at", F.row_number().over(order))
        .where(F.col("shown_at") <= shown)
        .drop("shown_at")
    )


def display_pct(shown: DataFrame, by: list[str]) -> DataFrame:
    """Bar length of each shown result, in percent of the best of its search."""
    group = Window.partitionBy(*by)
    low, high = F.min("score").over(group), F.max("score").over(group)
    relative = F.lit(0.2) + F.try_divide(F.col("score") - low, high - low) * F.lit(0.8)
    share = F.when(high == low, 1.0).otherwise(relative)
    # Halves go up, as in the client.
    return shown.withColumn("pct", F.floor(share * 100 + 0.5).cast("int"))


def result_counts(
    flat: DataFrame, by: list[str], threshold: float = MIN_CONFIDENCE, shown: int = MAX_SHOWN
) -> DataFrame:
    """Per search: results shown, passing the threshold, and in total."""
    passing = F.count_if(F.col("score") >= threshold)
    return flat.groupBy(*by).agg(
        F.least(passing, F.lit(shown).cast("long")).alias("shown"),
        passing.alias("passing"),
        F.count("*").alias("total"),
        (passing > shown).alias("limited"),
    )
