"""Chunk, query and snapshot tables built from a folder of document tables."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.content import (
    chunk_id,
    content_hash,
    line_count,
    summary_heuristic,
)
from gleanery.functions.paths import guess_lang
from gleanery.operators.search import SearchQuery
from gleanery.schema import CHUNK_COLUMNS
from gleanery.sources.tree import local_path

DIRECTORIES = ["src", "test", "docs", "vendor", "sample", "lib", "tmp"]
SUFFIXES = [".py", ".go", ".sh", ".md", ".yaml", ".json", ".tf", ".ts"]
FIRST_RUN = datetime(2026, 1, 1, tzinfo=UTC)
SECOND_RUN = datetime(2026, 1, 2, tzinfo=UTC)
DIM = 64
#: Seconds that let the time stamps of written files become past.
SETTLE = 0.4
QUERY_TEXT = "bash script attion eriner tion thnt doc_12.py"
QUERY_VECTOR = 7
TREE_ROOT = "/root/x"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input has fewer splits than there are cores.

    A no-op on data of any size: there the scan has more splits than that.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def document_path() -> Column:
    doc = F.col("doc_id")
    return F.concat(
        _pick(DIRECTORIES, doc % 7), F.lit("/"), F.col("lang"), F.lit("/doc_"),
        doc.cast("string"), _pick(SUFFIXES, doc % 8),
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of a source tree: repository, ref, path, text."""
    return spread(table(spark, folder, "documents").select("doc_id", "text", "lang", "source")).select(
        "doc_id",
        F.col("source").alias("repository"),
        F.when(F.col("doc_id") % 3 < 2, "main").otherwise("dev").alias("ref"),
        document_path().alias("path"),
        "text",
    )


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("summary_vec")
    )


def _shaped(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as chunks without vectors. What follows from the text is computed here, so
    that a join behind it moves the text only where content is wanted."""
    shaped = (
        documents(spark, folder)
        .withColumn("line_start", F.lit(1))
        .withColumn("line_end", line_count(F.col("text")))
    )
    return shaped.select(
        "doc_id",
        chunk_id(F.col("path"), F.col("line_start"), F.col("line_end")).alias("id"),
        "repository",
        "ref",
        "path",
        guess_lang(F.col("path")).alias("language"),
        summary_heuristic(F.col("text")).alias("summary"),
        F.col("text").alias("content"),
        "line_start",
        "line_end",
        content_hash(F.col("text")).alias("content_hash"),
        F.lit(FIRST_RUN).alias("summarized_at"),
        F.lit(FIRST_RUN).alias("created_at"),
    )


def chunks_with_id(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk table, with ``doc_id`` on top."""
    shaped = _shaped(spark, folder)
    return shaped.join(_vectors(spark, folder), "doc_id", "left").select("doc_id", *CHUNK_COLUMNS)


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunks_with_id(spark, folder).select(CHUNK_COLUMNS)


def queries(spark: SparkSession, folder: str) -> DataFrame:
    """Query table: every benchmark text, with a vector."""
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("query_vec")
    )
    return table(spark, folder, "benchmark").join(vectors, "item_id", "left").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text"), "query_vec"
    )


def query_vector(spark: SparkSession, folder: str) -> list[float]:
    found = table(spark, folder, "embeddings").where(F.col("vec_id") == QUERY_VECTOR)
    return found.select("embedding").first()[0]


def flagship_query(spark: SparkSession, folder: str, **changes) -> SearchQuery:
    options = {
        "text": QUERY_TEXT,
        "k": 10,
        "ref": "main",
        "vector": query_vector(spark, folder),
        "stemmed": False,
    }
    return SearchQuery(**{**options, **changes})


def previous_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """An older state of the chunk table, by remainder of ``doc_id`` by five.

    0: missing, though every second of them is stored under the ref ``old``;
    1: other content; 2: no summary; 3: no vector; 4: as it is now.
    """
    now = _shaped(spark, folder)
    rest = F.col("doc_id") % 5
    old_content = F.when(rest == 1, F.concat("content", F.lit(" old"))).otherwise(F.col("content"))
    before = (
        now.where((rest != 0) | (F.col("doc_id") % 10 == 5))
        .withColumn("ref", F.when(rest == 0, "old").otherwise(F.col("ref")))
        .withColumn("content", old_content)
        .withColumn("content_hash", content_hash(F.col("content")))
        .withColumn("summary", F.when(rest == 2, "").otherwise(F.col("summary")))
    )
    return (
        before.join(_vectors(spark, folder), "doc_id", "left")
        .withColumn("summary_vec", F.when(rest != 3, F.col("summary_vec")))
        .select(CHUNK_COLUMNS)
    )


def new_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The current files as an indexing run sees them before enrichment.

    They have no vectors, so no text moves for these; a document with several vectors is as
    many chunks here as in the chunk table.
    """
    several = _vectors(spark, folder).groupBy("doc_id").agg(F.count("*").alias("times"))
    several = several.where("times > 1")
    times = F.coalesce("times", F.lit(1)).cast("int")
    repeated = _shaped(spark, folder).join(F.broadcast(several), "doc_id", "left")
    return repeated.select(
        "id", "repository", "ref", "path", "line_start", "line_end", "language", "content",
        "content_hash", F.explode(F.array_repeat(F.lit(0), times)).alias("copy"),
    ).drop("copy")


def write_tree(files: DataFrame) -> None:
    """Write (root, path, text) rows as plain files, from the executors."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                target = f"{row['root']}/{row['path']}"
                local = local_path(target)
                if local is None:
                    system, inside = fs.FileSystem.from_uri(target)
                    system.create_dir(os.path.dirname(inside))
                    with system.open_output_stream(inside) as file:
                        file.write(row["text"].encode())
                    continue
                os.makedirs(os.path.dirname(local), exist_ok=True)
                with open(local, "wb") as file:
                    file.write(row["text"].encode())
            yield pa.RecordBatch.from_pydict({"written": pa.array([batch.num_rows], pa.int64())})

    files.select("root", "path", "text").mapInArrow(write, "written long").write.format(
        "noop"
    ).mode("overwrite").save()
