"""Inverted postings of path, summary and content."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.stemmer import stem
from gleanery.functions.text import STOP_WORDS, tokens
from gleanery.schema import NATURAL_KEY

#: Weight class of each field.
FIELD_WEIGHTS = {"path": "A", "summary": "B", "content": "C"}

POSTINGS = (
    "term string, repository string, ref string, path string, line_start int, line_end int, "
    "hits_a long, hits_b long, hits_c long, positions array<struct<position:int,weight:string>>"
)

#: Words grouped at a time; a single chunk may exceed it.
WORDS_PER_BLOCK = 2_000_000


def _field_words(field: str) -> Column:
    text = F.coalesce(F.col(field), F.lit(""))
    if field == "path":
        text = F.regexp_replace(text, "[^A-Za-z0-9]+", " ")
    return tokens(text)


def _word_blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch, cut so that few words are held at once."""
    counts = sum(np.asarray(pc.list_value_length(batch[f"{f}_words"])) for f in FIELD_WEIGHTS)
    block_of = np.cumsum(counts) // WORDS_PER_BLOCK
    cuts = [0, *(np.nonzero(np.diff(block_of))[0] + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:], strict=False):
        if end > start:
            yield batch.slice(start, end - start)


def _indexed_words(lists: pa.Array, stemmed: bool) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(row, distinct terms, term number, place) of all words but stop words."""
    lengths = np.asarray(pc.list_value_length(lists))
    rows = np.repeat(np.arange(len(lists)), lengths)
    places = np.arange(1, len(rows) + 1) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    encoded = lists.flatten().dictionary_encode()
    words = encoded.dictionary.to_pylist()
    numbers = np.asarray(encoded.indices)
    stop_words = set(STOP_WORDS)
    kept = np.array([w not in stop_words for w in words], dtype=bool)[numbers]
    return rows[kept], [stem(w) if stemmed else w for w in words], numbers[kept], places[kept]


def _group(block: pa.RecordBatch, stemmed: bool) -> pa.RecordBatch:
    """Postings of the chunks in a block, one row per chunk and term."""
    rows, terms, positions, weights = [], [], [], []
    ends = np.zeros(block.num_rows, dtype=np.int64)
    vocabulary: dict[str, int] = {}
    for weight, field in enumerate(FIELD_WEIGHTS):
        at, words, numbers, places = _indexed_words(block[f"{field}_words"], stemmed)
        codes = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], dtype=np.int64)
        rows.append(at)
        terms.append(codes[numbers])
        # A field starts after the last indexed position of those before it.
        positions.append(places + ends[at])
        weights.append(np.full(len(at), weight))
        np.maximum.at(ends, at, positions[-1])
    row, term, position, weight = map(np.concatenate, (rows, terms, positions, weights))
    # Fields and words come in order, so equal keys keep theirs in a stable sort.
    order = np.argsort(row * max(1, len(vocabulary)) + term, kind="stable")
    row, term, position, weight = row[order], term[order], position[order], weight[order]
    changes = (np.diff(row) != 0) | (np.diff(term) != 0)
    starts = np.concatenate([np.zeros(min(1, len(row)), np.int64), np.nonzero(changes)[0] + 1])
    names = pa.array(list(FIELD_WEIGHTS.values())).take(pa.array(weight))
    places = pa.StructArray.from_arrays(
        [pa.array(position, pa.int32()), names], names=["position", "weight"]
    )
    offsets = pa.array(np.append(starts, len(row)), pa.int32())
    columns = {"term": pa.array(list(vocabulary), pa.string()).take(pa.array(term[starts]))}
    columns.update({c: block[c].take(pa.array(row[starts])) for c in NATURAL_KEY})
    for number, name in enumerate(FIELD_WEIGHTS.values()):
        hits = np.add.reduceat((weight == number).astype(np.int64), starts) if len(starts) else []
        columns[f"hits_{name.lower()}"] = pa.array(hits, pa.int64())
    columns["positions"] = pa.ListArray.from_arrays(offsets, places)
    return pa.RecordBatch.from_pydict(columns)


def fielded_postings(chunks: DataFrame, stemmed: bool = True) -> DataFrame:
    """One row per term and chunk: hits per weight, and the positions in order.

    Positions count all words of a field, stop words too. All words of a chunk
    are in its row, so they are grouped where the row is and nothing is shuffled,
    whether a term is rare or in every chunk.
    """
    words = chunks.select(
        *NATURAL_KEY, *[_field_words(field).alias(f"{field}_words") for field in FIELD_WEIGHTS]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _word_blocks(batch):
                yield _group(block, stemmed)

    return words.mapInArrow(run, POSTINGS)


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def save_postings(postings: DataFrame, path: str, buckets: int = 256) -> None:
    """Write postings for lookup by term: a folder per bucket, sorted by term.

    The rebalance hint splits the bucket of a very common term over several files.
    """
    (
        postings.withColumn("bucket", _bucket(F.col("term"), buckets))
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "term")
        .write.partitionBy("bucket")
        .parquet(path)
    )


def lookup_term(saved: DataFrame, term: str, buckets: int = 256) -> DataFrame:
    """Postings of one term; only its bucket is read."""
    return saved.where((F.col("bucket") == _bucket(F.lit(term), buckets)) & (F.col("term") == term))
