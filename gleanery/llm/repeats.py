"""Repeated windows of a corpus: routing that substring dedup and suffix dedup share.

A window is ``width`` consecutive units (bytes or words) of one document. Documents go, in
the order of doc_id, into blocks of a few megabytes, which are stored once. Then

1. every window is named by the smallest hash of the ``gram``-unit pieces in it. Windows
   with the same content have the same name, and neighbouring windows mostly share one:
   a run of them is a segment of text. Blocks send the names' leading bits to buckets,
   which answer with the names that occur again anywhere;
2. blocks send only segments of such names, with equal ones of a block merged, to buckets
   by name. All windows that could be equal meet in one bucket, which decides them with
   the operator's own method and answers with a bit per window. A name with more than
   ``HEAVY`` segments in the corpus is split: blocks send its windows one by one, each
   content once, to buckets by a hash of the content. Equal windows have the same name,
   so they still meet, and the rest spreads;
3. blocks mark what the windows cover.

Names only choose where to compare; the decision compares contents. No step gathers a
name's occurrences by document: a block sends a name and a segment's text once, and
buckets are as many as the corpus has ``BUCKET_BYTES``. Every step is written to the
shared folder.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import job_folder, save
from gleanery.llm.wordhash import mix, text_buffers

#: Text of a block, and corpus text per bucket.
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
#: Segments of a name in the corpus that still go to one bucket (a few megabytes).
HEAVY = 1 << 14
#: Leading bits of a name that decide whether it may occur again.
NAME_BITS = 44
#: Windows whose names are computed at once (arrays that stay in a core's cache), and bits
#: that hold a place among them.
PIECE = 1 << 15
PLACE_BITS = 20

_BLOCK = "block bigint, ids array<bigint>, lengths array<bigint>, payload binary"


@dataclass
class Block:
    """Texts of one block: their doc_ids and all bytes with the places between them."""

    number: int
    ids: list
    values: np.ndarray
    offsets: np.ndarray


@dataclass
class Named:
    """Segments of a block: start, number of windows, name, and whether the piece that
    gives the name stands in the segment more than once."""

    starts: np.ndarray
    counts: np.ndarray
    names: np.ndarray
    inner: np.ndarray


@dataclass
class Units:
    """What windows are made of.

    ``names``: block -> its segments, in units of the block. ``content``: block -> function
    giving the bytes of a segment.
    """

    width: int
    names: Callable[[Block], Named]
    content: Callable[[Block], Callable[[int, int], bytes]]


def sliding_least(hashes: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    least, have = hashes, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return least


def name_windows(
    n: int, valid: np.ndarray, width: int, gram: int, hashes: Callable[[int, int], np.ndarray]
) -> Named:
    """Name the ``n`` windows of a block and cut their sequence into segments.

    ``hashes(a, b)`` gives the hashes of the pieces that start at units a to b - 1;
    ``valid`` tells which windows lie in one document. The low bits of a hash give way to
    its place, so that the least is the leftmost one.
    """
    if n <= 0:
        nothing = np.empty(0, np.int64)
        return Named(nothing, nothing, nothing.astype(np.uint64), nothing.astype(bool))
    names, places = np.empty(n, np.uint64), np.empty(n, np.int64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    for a in range(0, n, PIECE):
        b = min(n, a + PIECE)
        pieces = hashes(a, b + width - gram)
        pieces = pieces & ~low | np.arange(len(pieces), dtype=np.uint64)
        least = sliding_least(pieces, width - gram + 1)
        names[a:b] = least >> np.uint64(PLACE_BITS)
        places[a:b] = (least & low).astype(np.int64) + a
    change = np.ones(n + 1, bool)
    change[1:-1] = (names[1:] != names[:-1]) | (valid[1:] != valid[:-1])
    edges = np.flatnonzero(change)
    starts, counts = edges[:-1], np.diff(edges)
    good = valid[starts]
    starts, counts = starts[good], counts[good]
    # Least values crowd at the low end; mixed, they spread over the buckets.
    return Named(starts, counts, mix(names[starts]), places[starts] != places[starts + counts - 1])


def _build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    ids, texts, size, number, where = [], [], 0, 0, 0

    def flush():
        lengths = [len(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([where << 32 | number], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([lengths], pa.list_(pa.int64())),
                pa.array([packer.compress(b"".join(texts))], pa.binary()),
            ],
            ["block", "ids", "lengths", "payload"],
        )

    for part in parts:
        values, offsets = text_buffers(part.column("text"))
        if len(part):
            where = part.column("part")[0].as_py()
        for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
            ids.append(doc_id)
            texts.append(values[offsets[i] : offsets[i + 1]].tobytes())
            size += len(texts[-1])
            if size >= BLOCK_BYTES:
                yield flush()
                ids, texts, size, number = [], [], 0, number + 1
    if ids:
        yield flush()


def _blocks(part: pa.RecordBatch) -> Iterator[Block]:
    reader = zstandard.ZstdDecompressor()
    for i in range(len(part)):
        values = np.frombuffer(reader.decompress(part.column("payload")[i].as_py()), np.uint8)
        lengths = np.asarray(part.column("lengths")[i].values, np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        yield Block(part.column("block")[i].as_py(), part.column("ids")[i].as_py(), values, offsets)


def build_blocks(documents: DataFrame, folder: str) -> DataFrame:
    """Blocks in ascending order of doc_id (null first, equal ones by content)."""
    # Equal rows may go to different ranges, so no row's copies fill a task.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.rand(5)]
    ranged = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order[:2])
        .withColumn("part", F.spark_partition_id())
    )
    return save(ranged.mapInArrow(_build, _BLOCK), folder, "blocks")


def _bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _short(names: np.ndarray) -> np.ndarray:
    return np.unique(names >> np.uint64(64 - NAME_BITS))


def _by_bucket(short: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """Slices of ascending short names by bucket."""
    of = _bucket_of(short << np.uint64(64 - NAME_BITS), buckets)
    edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])) if len(of) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(of[a]), a, b


def _planes(values: np.ndarray) -> bytes:
    """Ascending numbers as compressed byte planes of their differences."""
    steps = np.diff(values, prepend=values.dtype.type(0)).astype("<u8")
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unplanes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8")[:, 0], dtype="<u8")


def _send_names(units: Units, buckets: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for block in _blocks(part):
                named = units.names(block)
                values, where, n = np.unique(
                    named.names >> np.uint64(64 - NAME_BITS), return_inverse=True, return_counts=True
                )
                inner = np.bincount(where, weights=named.inner, minlength=len(values))
                twice = (n > 1) | (inner > 0)
                rows = [
                    (
                        bucket, _planes(values[a:b]), np.packbits(twice[a:b]).tobytes(),
                        zstandard.compress(np.minimum(n[a:b], 65_535).astype("<u2").tobytes(), 1),
                    )
                    for bucket, a, b in _by_bucket(values, buckets)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int32()),
                        pa.array([block.number] * len(rows), pa.int64()),
                        pa.array([r[1] for r in rows], pa.binary()),
                        pa.array([r[2] for r in rows], pa.binary()),
                        pa.array([r[3] for r in rows], pa.binary()),
                    ],
                    ["bucket", "block", "names", "twice", "counts"],
                )

    return run


def _find_again(heavy: int):
    """For each block's names in a bucket: which of them occur again, and which have more
    than ``heavy`` segments."""

    def run(table: pa.Table) -> pa.Table:
        names = [_unplanes(v.as_py()) for v in table.column("names")]
        twice = [
            np.unpackbits(np.frombuffer(v.as_py(), np.uint8), count=len(n)).astype(bool)
            for v, n in zip(table.column("twice"), names, strict=True)
        ]
        values, counts = np.unique(np.concatenate(names), return_counts=True)
        again = counts > 1
        segments = np.zeros(len(values), np.int64)
        for n, raw in zip(names, table.column("counts"), strict=True):
            found = np.frombuffer(zstandard.decompress(raw.as_py()), "<u2")
            segments[np.searchsorted(values, n)] += found
        split = segments > heavy
        bits, splits = [], []
        for n, t in zip(names, twice, strict=True):
            at = np.searchsorted(values, n)
            bits.append(np.packbits(again[at] | t).tobytes())
            splits.append(np.packbits(split[at]).tobytes() if split[at].any() else b"")
        return pa.table(
            {
                "block": table.column("block"),
                "bucket": table.column("bucket").cast(pa.int32()),
                "bits": pa.array(bits, pa.binary()),
                "split": pa.array(splits, pa.binary()),
            }
        )

    return run


def _pack(arrays: list[np.ndarray], contents: bytes) -> bytes:
    head = struct.pack(f"<{len(arrays)}q", *map(len, arrays))
    body = b"".join(a.astype("<i8").tobytes() for a in arrays)
    return zstandard.compress(head + body + contents, 3)


def _unpack(raw: bytes, n: int) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.decompress(raw)
    sizes = struct.unpack_from(f"<{n}q", raw)
    at, arrays = 8 * n, []
    for size in sizes:
        arrays.append(np.frombuffer(raw, "<i8", size, at))
        at += 8 * size
    return arrays, raw[at:]


def _send_segments(units: Units, buckets: int):
    """Rows of (bucket, block, payload): distinct segments and where they stand. Windows of
    split names go to a second set of buckets."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i, block in enumerate(_blocks(part)):
                named = units.names(block)
                starts, counts, names = named.starts, named.counts, named.names
                short = _short(names)
                again, split = np.zeros(len(short), bool), np.zeros(len(short), bool)
                answers = {r["bucket"]: r for r in part.column("again")[i].as_py()}
                for bucket, a, b in _by_bucket(short, buckets):
                    row = np.frombuffer(answers[bucket]["bits"], np.uint8)
                    again[a:b] = np.unpackbits(row, count=b - a)
                    if answers[bucket]["split"]:
                        row = np.frombuffer(answers[bucket]["split"], np.uint8)
                        split[a:b] = np.unpackbits(row, count=b - a)
                at = np.searchsorted(short, names >> np.uint64(64 - NAME_BITS))
                hit = np.flatnonzero(again[at]) if len(short) else []
                content = units.content(block)
                held: dict[int, dict[bytes, tuple[int, list[int]]]] = {}
                of = _bucket_of(names, buckets)
                for s in hit:
                    if split[at[s]]:
                        for w in range(int(starts[s]), int(starts[s] + counts[s])):
                            text = content(w, 1)
                            bucket = buckets + (zlib.crc32(text) * buckets >> 32)
                            seen = held.setdefault(bucket, {})
                            seen.setdefault(text, (1, []))[1].append(w)
                        continue
                    text = content(int(starts[s]), int(counts[s]))
                    seen = held.setdefault(int(of[s]), {})
                    seen.setdefault(text, (int(counts[s]), []))[1].append(int(starts[s]))
                rows = []
                for bucket, seen in held.items():
                    windows = np.array([v[0] for v in seen.values()])
                    copies = np.array([len(v[1]) for v in seen.values()])
                    where = np.array([p for v in seen.values() for p in v[1]])
                    sizes = np.array([len(text) for text in seen])
                    rows.append((bucket, _pack([windows, copies, where, sizes], b"".join(seen))))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int32()),
                        pa.array([block.number] * len(rows), pa.int64()),
                        pa.array([r[1] for r in rows], pa.binary()),
                    ],
                    ["bucket", "block", "payload"],
                )

    return run


@dataclass
class Segments:
    """The distinct segments of a bucket: content, number of windows, and the places
    (block, start) where each stands, in ascending order."""

    contents: list[bytes]
    windows: np.ndarray
    places: list[list[tuple[int, int]]]


def _marks(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table(
        {
            "block": pa.array([r[0] for r in rows], pa.int64()),
            "marks": pa.array([r[1] for r in rows], pa.binary()),
        }
    )


def _decide_windows(table: pa.Table, method) -> pa.Table:
    """The windows of split names: only those that stand twice go to ``method``, with two
    of their places; places stay arrays, one per block and content."""
    held: dict[bytes, list[tuple[int, np.ndarray]]] = {}
    for block, payload in zip(table.column("block"), table.column("payload"), strict=True):
        (_, copies, where, sizes), contents = _unpack(payload.as_py(), 4)
        ends, to, number = np.cumsum(sizes), np.cumsum(copies), block.as_py()
        for k in range(len(sizes)):
            text = contents[ends[k] - sizes[k] : ends[k]]
            held.setdefault(text, []).append((number, where[to[k] - copies[k] : to[k]]))
    again = {t: p for t, p in held.items() if len(p) > 1 or len(p[0][1]) > 1}
    two = []
    for parts in again.values():
        parts.sort(key=lambda x: x[0])
        (a, at), (b, then) = parts[0], parts[-1]
        two.append([(a, int(at[0])), (b, int(then[-1]))])
    first, later = method(Segments(list(again), np.ones(len(again), np.int64), two))
    answers: dict[int, list[np.ndarray]] = {}
    for k, parts in enumerate(again.values()):
        for turn, (number, starts) in enumerate(parts):
            on = np.full(len(starts), later[k])
            if turn == 0:
                on[0] = first[k]
            answers.setdefault(number, []).append(starts[on])
    rows = []
    for number, found in answers.items():
        starts = np.concatenate(found)
        ones = np.ones(len(starts), np.int64)
        rows.append((number, _pack([starts, ones], np.packbits(ones.astype(bool)).tobytes())))
    return _marks(rows)


def _decide(method: Callable[[Segments], tuple[np.ndarray, np.ndarray]], buckets: int):
    """``method`` gives a bit per window of the segments, for their first place and for
    all later places."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= buckets:
            return _decide_windows(table, method)
        merged: dict[bytes, tuple[int, list[tuple[int, int]]]] = {}
        for block, payload in zip(table.column("block"), table.column("payload"), strict=True):
            (windows, copies, where, sizes), contents = _unpack(payload.as_py(), 4)
            at, w, number = 0, 0, block.as_py()
            for k in range(len(windows)):
                text = contents[at : at + sizes[k]]
                at += sizes[k]
                places = merged.setdefault(text, (int(windows[k]), []))[1]
                places.extend((number, int(p)) for p in where[w : w + copies[k]])
                w += copies[k]
        for _, places in merged.values():
            places.sort()
        found = Segments(
            list(merged), np.array([v[0] for v in merged.values()], np.int64),
            [v[1] for v in merged.values()],
        )
        first, later = method(found)
        ends = np.cumsum(found.windows)
        answers: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for k, places in enumerate(found.places):
            a, b = ends[k] - found.windows[k], ends[k]
            for turn, (number, start) in enumerate(places):
                bits = (later if turn else first)[a:b]
                if bits.any():
                    answers.setdefault(number, []).append((start, b - a, bits))
        rows = []
        for number, marks in answers.items():
            arrays = [np.array([m[0] for m in marks]), np.array([m[1] for m in marks])]
            bits = np.packbits(np.concatenate([m[2] for m in marks])).tobytes()
            rows.append((number, _pack(arrays, bits)))
        return _marks(rows)

    return run


def window_marks(marks: list[bytes]) -> np.ndarray:
    """Starts of the marked windows of a block, in units."""
    found = []
    for raw in marks:
        (starts, counts), bits = _unpack(raw, 2)
        total = int(counts.sum())
        on = np.unpackbits(np.frombuffer(bits, np.uint8), count=total).astype(bool)
        inside = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        found.append((np.repeat(starts, counts) + inside)[on])
    return np.concatenate(found) if found else np.empty(0, np.int64)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` units lie in a window that starts at one of ``starts``."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + width, n), -1)
    return np.cumsum(steps[:-1]) > 0


def repeated_windows(
    documents: DataFrame,
    units: Units,
    method: Callable[[Segments], tuple[np.ndarray, np.ndarray]],
    finish: Callable[[Block, np.ndarray], pa.RecordBatch],
    schema: str,
) -> DataFrame:
    """Run the steps; ``finish`` turns a block and the starts of its marked windows into
    result rows."""
    folder = job_folder(documents.sparkSession, "repeats")
    blocks = build_blocks(documents, folder)
    total = blocks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)))
    buckets = max(1, -(-(total.first()[0] or 0) // BUCKET_BYTES))
    names = blocks.mapInArrow(
        _send_names(units, buckets),
        "bucket int, block bigint, names binary, twice binary, counts binary",
    )
    again = (
        names.groupBy("bucket")
        .applyInArrow(_find_again(HEAVY), "block bigint, bucket int, bits binary, split binary")
        .groupBy("block")
        .agg(F.collect_list(F.struct("bucket", "bits", "split")).alias("again"))
    )
    again = save(again, folder, "again")
    # The answers grow with the corpus: both joins shuffle, whatever their size today.
    sent = blocks.join(again.hint("merge"), "block").mapInArrow(
        _send_segments(units, buckets), "bucket int, block bigint, payload binary"
    )
    marks = (
        sent.groupBy("bucket")
        .applyInArrow(_decide(method, buckets), "block bigint, marks binary")
        .groupBy("block")
        .agg(F.collect_list("marks").alias("marks"))
    )
    marks = save(marks, folder, "marks")

    def last(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i, block in enumerate(_blocks(part)):
                yield finish(block, window_marks(part.column("marks")[i].as_py() or []))

    return blocks.join(marks.hint("merge"), "block", "left").mapInArrow(last, schema)
