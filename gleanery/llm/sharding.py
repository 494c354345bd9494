"""Sharding: a two-pass external shuffle.

Pass one scatters the records by seeded hashes over buckets that fit in memory; pass
two permutes each bucket (Fisher-Yates, the built-in ``shuffle``) and numbers it. The
generator of ``shuffle`` goes on from row to row in a task, so buckets are dealt to a fixed
number of tasks and stand in a fixed order there: slots depend on the rows alone, not on
shuffle partitions, adaptive plans or tasks that run again.

The law is ``key``: doc_id and the number of shards decide alone. Each shard draws a
hash for the doc_id and the largest one wins, so a further shard takes rows only into
itself and no row moves between old shards.

Defined cases: a null doc_id is decided by the text, a null text has no bytes and a
null checksum; repeated rows go to the same shard, each with a slot of its own; an
empty table gives an empty result. Columns that the result adds replace input columns
of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.session import materialize, new_scratch

#: Bytes of text that one bucket should hold.
BUCKET_BYTES = 4 * 2**20
SEED = 20_240_607
#: Buckets that one task permutes, and buckets whose counts are added up at once.
BUCKETS_A_TASK = 8
COUNTED_AT_ONCE = 1024


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose hash of the key is largest; the first one wins ties."""
    if shards == 1:
        return F.lit(0)
    draws = [F.xxhash64(F.lit(seed), F.lit(s), key) for s in range(shards)]
    return (F.array_position(F.array(*draws), F.greatest(*draws)) - 1).cast("int")


def shard_key(id_column: str, text_column: str) -> Column:
    return F.coalesce(F.col(id_column), F.xxhash64(text_column))


def shuffle_shards(
    documents: DataFrame,
    shards: int = 16,
    id_column: str = "doc_id",
    text_column: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    seed: int = SEED,
) -> DataFrame:
    """All input columns plus ``shard`` and ``slot`` (gapless from 0 in each shard).

    The first action counts bytes per key and sizes the buckets. Buckets never depend
    on doc_id alone: if one key's rows would outgrow a bucket, rows scatter by their
    place in the input as well, so no bucket grows with a hot key.
    """
    added = {"shard", "slot"}
    carried = [c for c in documents.columns if c.lower() not in added]
    key = shard_key(id_column, text_column)
    size = F.coalesce(F.octet_length(text_column), F.lit(0)) + 1
    per_key = documents.groupBy(key.alias("key")).agg(F.sum(size).alias("bytes"))
    total, largest = per_key.agg(F.sum("bytes"), F.max("bytes")).first()
    per_shard = max(1, math.ceil((total or 0) / shards / bucket_bytes))
    scatter = [F.lit(seed + 1), key, F.xxhash64(text_column)]
    if (largest or 0) > bucket_bytes:
        # A stored table, so that a row keeps its place if a task runs again.
        documents = materialize(documents, "documents", new_scratch(documents.sparkSession, "shards"))
        scatter.append(F.monotonically_increasing_id())
    placed = documents.select(
        shard_of(key, shards, seed).alias("_shard"),
        F.xxhash64(*scatter).alias("_hash"),
        F.struct(*carried).alias("_record"),
    ).withColumn("_bucket", F.pmod("_hash", F.lit(per_shard)).cast("int"))
    tasks = math.ceil(shards * per_shard / BUCKETS_A_TASK)
    permuted = (
        placed.repartition(tasks, "_shard", "_bucket")
        .groupBy("_shard", "_bucket")
        .agg(F.sort_array(F.collect_list(F.struct("_hash", "_record"))).alias("_rows"))
        .sortWithinPartitions("_shard", "_bucket")
        .withColumn("_rows", F.shuffle("_rows", seed))
        .join(_slots_before(placed), ["_shard", "_bucket"])
        .select("_shard", "_before", F.posexplode("_rows").alias("_at", "_row"))
    )
    return permuted.select(
        *[F.col("_row._record")[c].alias(c) for c in carried],
        F.col("_shard").alias("shard"),
        (F.col("_before") + F.col("_at")).alias("slot"),
    )


def _slots_before(placed: DataFrame) -> DataFrame:
    """Rows of a shard in the buckets before each: sums within stretches of buckets, and
    sums of whole stretches before."""
    stretch = F.floor(F.col("_bucket") / COUNTED_AT_ONCE)
    counts = placed.groupBy("_shard", "_bucket").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_stretch", stretch)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = earlier(Window.partitionBy("_shard", "_stretch").orderBy("_bucket"))
    whole = counts.groupBy("_shard", "_stretch").agg(F.sum("_n").alias("_n"))
    ahead = F.sum("_n").over(earlier(Window.partitionBy("_shard").orderBy("_stretch")))
    whole = whole.select("_shard", "_stretch", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    near = counts.withColumn("_near", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return near.join(whole, ["_shard", "_stretch"]).select(
        "_shard", "_bucket", (F.col("_near") + F.col("_ahead")).alias("_before")
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard, rows in the order of their slots. The slots are written down
    before they are ranged, so that a task that runs again finds the same ones."""
    placed = materialize(placed, "placed", new_scratch(placed.sparkSession, "shards"))
    ordered = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)


def op1_sharding(documents: DataFrame) -> DataFrame:
    """All documents in shards 0 to 15 under the law ``key``."""
    text = F.col("text")
    key = shard_key("doc_id", "text")
    return shuffle_shards(documents.select("doc_id", "text")).select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        shard_of(key, 17).alias("grown_shard"),
    )
