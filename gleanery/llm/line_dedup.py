"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last lines ends a chunk wherever its last hex
digit is below ``CUT``, so an inserted or deleted line moves no boundary beyond its
neighbours. A chunk of two or more lines that occurs again is removed; its first place
(smallest doc_id, then position) stays. Chunks with equal hashes are compared by bytes
before anything is removed, and single lines are never removed.

Defined cases: a null text has no lines, an empty one has one; a null doc_id is smaller
than any other; rows that repeat doc_id and text are one document, with the same result
for each row; an empty table gives an empty result. Only two columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import job_folder, save

#: Lines under the rolling hash, and how many of 16 hash values end a chunk.
ROLL = 3
CUT = 4
#: Lines of the smallest chunk that can be removed.
LEAST = 2


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def chunks(text: Column) -> Column:
    """The chunks of a text in order: array of (c, n lines, chunk)."""
    cuts = list("0123456789abcdef"[:CUT])

    def ends_chunk(hashes, i):
        first = F.greatest(i - ROLL + 1, F.lit(1))
        rolled = F.md5(F.concat_ws("", F.slice(hashes, first, i - first + 1)))
        return (i == F.size(hashes)) | F.substring(rolled, 32, 1).isin(cuts)

    def cut(lines, ends):
        def one(end, c):
            start = F.when(c == 0, 0).otherwise(F.get(ends, c - 1))
            chunk = F.array_join(F.slice(lines, start + 1, end - start), "\n")
            return F.struct(c.alias("c"), (end - start).alias("n"), chunk.alias("chunk"))

        return F.transform(ends, one)

    def of_lines(lines):
        hashes = F.transform(lines, lambda line: F.md5(line))
        ends = _bound(
            hashes,
            lambda h: F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: ends_chunk(h, i)),
        )
        return _bound(ends, lambda e: cut(lines, e))

    found = _bound(F.split(text, "\n"), of_lines)
    none = F.array().cast("array<struct<c:int,n:int,chunk:string>>")
    return F.when(text.isNull(), none).otherwise(found)


def _removable(texts: DataFrame, *more: str) -> DataFrame:
    """One row per chunk that could be removed: place, hash and text."""
    large = F.filter(chunks(F.col("text")), lambda x: x["n"] >= LEAST)
    return texts.select("doc_id", "key", *more, F.inline(large)).withColumn(
        "chunk_hash", F.md5("chunk")
    )


def _same(left: str, right: str):
    return (F.col(f"{left}.key") == F.col(f"{right}.key")) & F.col(f"{left}.doc_id").eqNullSafe(
        F.col(f"{right}.doc_id")
    )


def line_dedup(documents: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_chunks, n_removed (lines), kept_text.

    Chunk hashes are grouped with their first and last place, combined before the
    shuffle. Only documents with a repeated hash hand out chunk texts, which meet again
    by hash and bytes. The texts shuffle for each of both joins, whatever the size of the
    other side, which grows with the corpus.
    """
    folder = job_folder(documents.sparkSession, "lines")
    place = F.struct("doc_id", "key", "c")
    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("key"))
    thin = _removable(texts).select("doc_id", "key", "c", "chunk_hash")
    repeated = (
        thin.groupBy("chunk_hash")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first != last")
    )
    suspects = save(
        thin.join(repeated, "chunk_hash", "left_semi")
        .groupBy("doc_id", "key")
        .agg(F.collect_set("c").alias("suspects")),
        folder, "suspects",
    )
    suspected = (
        texts.alias("t")
        .join(suspects.hint("merge").alias("s"), _same("t", "s"))
        .select("t.doc_id", "t.key", "t.text", "s.suspects")
    )
    found = _removable(suspected, "suspects").where(F.array_contains("suspects", F.col("c")))
    first = found.groupBy("chunk_hash", "chunk").agg(F.min(place).alias("first"))
    losers = save(
        found.join(first, ["chunk_hash", "chunk"])
        .where(place != F.col("first"))
        .groupBy("doc_id", "key")
        .agg(F.collect_set("c").alias("removed")),
        folder, "losers",
    )
    marked = (
        texts.alias("t")
        .join(losers.hint("merge").alias("l"), _same("t", "l"), "left")
        .select(
            "t.doc_id", "t.key", "t.text",
            F.coalesce("l.removed", F.array().cast("array<int>")).alias("removed"),
        )
    )
    return _without(marked)


def _without(marked: DataFrame) -> DataFrame:
    """What the removed chunks leave of the texts."""
    gone = lambda x: F.array_contains("removed", x["c"])
    lines = lambda total, x: total + x["n"]
    none = F.lit(0).cast("long")
    left = F.transform(F.filter("chunks", lambda x: ~gone(x)), lambda x: x["chunk"])
    return marked.select("doc_id", "removed", chunks(F.col("text")).alias("chunks")).select(
        "doc_id",
        F.aggregate("chunks", none, lines).alias("n_lines"),
        F.size("chunks").cast("long").alias("n_chunks"),
        F.aggregate(F.filter("chunks", gone), none, lines).alias("n_removed"),
        F.array_join(left, "\n").alias("kept_text"),
    )


def op9_line_dedup(documents: DataFrame) -> DataFrame:
    """What is left of every document, with a digest of the kept lines."""
    kept = F.coalesce(F.col("kept_text"), F.lit(""))
    return line_dedup(documents).select(
        "doc_id", "n_lines", "n_chunks", "n_removed", F.sha2(kept, 256).alias("kept_sha256")
    )


OP9_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), hashed AS (
  SELECT *, md5(line) AS h, max(i) OVER (PARTITION BY doc_id) AS n FROM lines
), rolled AS (
  SELECT *, i = n OR right(md5(coalesce(lag(h, 2) OVER d, '') || coalesce(lag(h, 1) OVER d, '')
                               || h), 1) IN ('0', '1', '2', '3') AS ends
  FROM hashed WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), placed AS (
  SELECT *, coalesce(sum(ends::int) OVER (PARTITION BY doc_id ORDER BY i
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
  FROM rolled
), chunks AS (
  SELECT doc_id, c, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS chunk
  FROM placed GROUP BY doc_id, c
), judged AS (
  SELECT *, n_lines >= 2 AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, c) > 1
            AS gone
  FROM chunks
)
SELECT d.doc_id, coalesce(sum(n_lines), 0)::bigint AS n_lines, count(c) AS n_chunks,
       coalesce(sum(n_lines) FILTER (gone), 0)::bigint AS n_removed,
       sha256(coalesce(string_agg(chunk, chr(10) ORDER BY c) FILTER (NOT gone), ''))
         AS kept_sha256
FROM documents d LEFT JOIN judged USING (doc_id) GROUP BY d.doc_id
"""
