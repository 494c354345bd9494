"""Indexing change records as they arrive."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from gleanery.operators.delta import chunk_files
from gleanery.plans.index_job import index_chunks
from gleanery.sources.chunk_table import ChunkTable
from gleanery.sources.providers import ProviderSpec

CHANGES = (
    "repository string, ref string, root string, path string, content binary, changed_at timestamp"
)


FILE = ["repository", "ref", "root", "path"]

#: Groups that the files are dealt to by hash. A call into Python costs milliseconds, so one
#: for each file would take far longer than the rest of a run.
GROUPS = 16_384

#: What is known of a group: for each of its files the hash of its name, and time
#: (microseconds) and content hash of its newest change.
_MARK = struct.Struct(">16sq20s")
_MARKS = "marks binary"
_NEWEST = ", ".join(f"{c} string" for c in FILE) + ", content binary"
#: Time of a change without one: earlier than any other.
_NEVER = -(2**63)


def _newest(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The newest change of each file of a group, unless a newer one came in an earlier batch.

    Only marks are kept as state, and in memory one content for each file of the group.
    """
    marks = {}
    if state.exists:
        marks = {name: (at, digest) for name, at, digest in _MARK.iter_unpack(bytes(state.get[0]))}
    found = {}
    for part in parts:
        columns = [part[c] for c in ("name", "at", "content_hash", *FILE, "content")]
        for name, at, digest, *row in zip(*columns, strict=True):
            name, mark = bytes(name), (int(at), bytes(digest))
            if name not in marks or mark >= marks[name]:
                marks[name], found[name] = mark, row
    if found:
        state.update((b"".join(_MARK.pack(name, *mark) for name, mark in marks.items()),))
        yield pd.DataFrame(list(found.values()), columns=[*FILE, "content"])


def newest_changes(changes: DataFrame) -> DataFrame:
    """Of a stream of changes, the last one of each file in a batch; of equal times, the one
    with the greater content hash. Changes older than one of an earlier batch are left out.

    Keyed state holds one mark of 44 bytes per file, by groups of files, so a batch reads and
    writes the marks of the groups of its own files, whatever came before.
    """
    # A missing name differs from an empty one.
    name = F.md5(F.to_json(F.array(*FILE)))
    marked = changes.select(
        *FILE, "content",
        F.unhex(name).alias("name"),
        F.coalesce(F.unix_micros("changed_at"), F.lit(_NEVER)).alias("at"),
        # Without content: the lowest hash.
        F.unhex(F.coalesce(F.sha1("content"), F.lit("0" * 40))).alias("content_hash"),
    )
    dealt = marked.withColumn("files", F.pmod(F.xxhash64("name"), F.lit(GROUPS)))
    return dealt.groupBy("files").applyInPandasWithState(
        _newest, _NEWEST, _MARKS, "update", "NoTimeout"
    )


def index_stream(
    changes: DataFrame,
    table: ChunkTable,
    provider: ProviderSpec | None,
    checkpoint: str,
    run_ts: datetime,
    max_calls: int | None = None,
) -> StreamingQuery:
    """Fold a stream of change records into the table, then stop.

    Each micro-batch is one indexing run over the newest change per file. The time and hash
    of the newest change of each file are state of the stream, kept in its checkpoint, so a
    record that arrives after a newer one changes nothing, however the records are split
    into batches; a stream with a new checkpoint knows no earlier records. A batch that is
    replayed after a failure starts from the state before it, finds its content already
    indexed and changes nothing but time stamps. Checkpoints from before marks were kept by
    groups have another state and cannot be continued.
    """

    def fold(batch: DataFrame, _: int) -> None:
        target = ChunkTable(batch.sparkSession, table.path, table.dim)
        # Its first step writes the chunks down, so the state is passed once a batch.
        index_chunks(chunk_files(batch), target, provider, run_ts, max_calls)

    return (
        newest_changes(changes).writeStream.foreachBatch(fold)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
