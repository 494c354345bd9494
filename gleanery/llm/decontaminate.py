"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-case letters and digits with single spaces between runs. A
test item of n characters may differ by n / ``PER_EDIT`` edits. It is cut into one piece
more than that, so at least one piece of a match is unchanged: an Aho-Corasick automaton
finds every exact piece in one pass over a document, and Myers' bit-parallel distance
decides around each hit.

The items are a query set: they go to the tasks in slices of at most ``SLICE_BYTES``, and
each slice reads the documents once, whatever the number of items.

Defined cases: null and empty texts and items without letters or digits match nothing; a
null doc_id is reported as null; rows that repeat are reported each; items that repeat
are reported each; empty tables give an empty result. Only doc_id and text, and item_id
and text, are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of an item per allowed edit.
PER_EDIT = 16
#: Bytes of item texts that one pass over the documents takes.
SLICE_BYTES = 2 << 20

_OTHER = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def budget(length: int) -> int:
    return length // PER_EDIT


def pieces(item: str) -> list[tuple[int, str]]:
    """One piece more than the edits allowed, with their places in the item."""
    n = budget(len(item)) + 1
    edges = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


class Pattern:
    """An item prepared for Myers' algorithm: a bit mask per character."""

    def __init__(self, item: str):
        self.length = len(item)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """Least edit distance of the item to any substring, and where the first such
        substring ends."""
        full, top = (1 << self.length) - 1, 1 << (self.length - 1)
        up, down, distance = full, 0, self.length
        found = (distance, 0)
        for at, c in enumerate(text, 1):
            match = self.masks.get(c, 0)
            across = match | down
            flat = (((match & up) + up) ^ up) | match | down
            plus, minus = (down | ~(flat | up)) & full, up & flat
            distance += bool(plus & top) - bool(minus & top)
            plus, minus = plus << 1 & full, minus << 1 & full
            up, down = (minus | ~(across | plus)) & full, plus & across
            if distance < found[0]:
                found = (distance, at)
        return found


class Matcher:
    """All items of a slice behind one automaton."""

    def __init__(self, items: list[tuple[int, int, str]]):
        import ahocorasick

        self.items = [(number, item_id, normal(text)) for number, item_id, text in items]
        self.items = [item for item in self.items if item[2]]
        self.patterns = [Pattern(text) for _, _, text in self.items]
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (_, _, text) in enumerate(self.items):
            for at, piece in pieces(text):
                places.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """Item index -> (distance, end in the normal text) of its best match."""
        found: dict[int, tuple[int, int]] = {}
        if not self.items:
            return found
        seen: set[tuple[int, int]] = set()
        text = normal(text)
        for last, (length, where) in self.automaton.iter(text):
            for i, at in where:
                start = last + 1 - length - at
                if (i, start) in seen or found.get(i, (1,))[0] == 0:
                    continue
                seen.add((i, start))
                pattern = self.patterns[i]
                slack = budget(pattern.length)
                begin = max(0, start - slack)
                window = text[begin : max(0, start + pattern.length + slack)]
                distance, end = pattern.best(window)
                if distance <= slack and (distance, begin + end) < found.get(i, (slack + 1, 0)):
                    found[i] = (distance, begin + end)
        return found


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[int, int, str]]]:
    """The items, in slices of bounded size (one empty slice if there are none)."""
    items = benchmark.where(F.col("text").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), "text"
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = -(-total // SLICE_BYTES) or 1
    for number in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == number)
        yield [(i, row.item_id, row.text) for i, row in enumerate(part.collect())]


def matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, distance, end (in the
    normalised text)."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for items in _slices(benchmark):
        one = _slice_matches(texts, items)
        found = one if found is None else found.unionByName(one)
    return found


def _slice_matches(texts: DataFrame, items: list[tuple[int, int, str]]) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(items)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value)
        for part in parts:
            rows = [
                (doc_id.as_py(), matcher.items[i][1], distance, end)
                for doc_id, text in zip(part.column("doc_id"), part.column("text"), strict=True)
                for i, (distance, end) in matcher.find(text.as_py() or "").items()
            ]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, pa.int64()) for column in columns],
                ["doc_id", "item_id", "distance", "end"],
            )

    return texts.mapInArrow(run, "doc_id bigint, item_id bigint, distance bigint, end bigint")


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    for items in _slices(benchmark):
        sent = documents.sparkSession.sparkContext.broadcast(items)

        def run(parts: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value)
            for part in parts:
                keep = [not matcher.find(text.as_py() or "") for text in part.column("text")]
                yield part.filter(pa.array(keep, pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents


def op3_decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contaminated documents with the items they hold."""
    return matches(documents, benchmark)
