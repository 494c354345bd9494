"""Substring dedup by relative Lempel-Ziv parsing over words.

Each word of a run of ``WIDTH`` consecutive words that also starts anywhere else is
removed, everywhere it stands; runs are judged on the input. ``repeats`` cuts the corpus
into reference blocks: all runs that could be equal meet in one, whichever documents they
come from. There every segment is parsed against the whole block: at each point the
parser takes another place of the coming run from the block's index and extends the match
word by word to a factor. Factors of ``WIDTH`` words and more become duplicate spans. A
run that straddles the end of a factor is looked up by itself, so the choice among several
places of a factor never changes the result.

Defined cases: a null text has no words; documents shorter than ``WIDTH`` words keep
everything; rows that repeat are documents of their own, so all their runs occur twice; a
null doc_id is an ordinary value; an empty table gives an empty result. Only doc_id and
text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.repeats import (
    Block,
    Named,
    Segments,
    Units,
    covered,
    name_windows,
    repeated_windows,
)
from gleanery.llm.wordhash import sequence_hashes, word_hashes, word_spans

WIDTH = 35
#: Words of the pieces that name a run.
GRAM = 10


def _words(block: Block):
    starts, ends, at = word_spans(block.values, block.offsets)
    return starts, ends, at, word_hashes(block.values, starts, ends)


def word_names(block: Block) -> Named:
    """Segments of the word runs of a block."""
    _, _, at, words = _words(block)
    n = len(words) - WIDTH + 1
    valid = np.ones(max(n, 0), bool)
    for end in at[1:-1]:
        valid[max(0, end - WIDTH + 1) : end] = False
    hashes = lambda a, b: sequence_hashes(words[a : b + GRAM - 1], GRAM)
    return name_windows(n, valid, WIDTH, GRAM, hashes)


def _content(block: Block):
    starts, ends, _ = word_spans(block.values, block.offsets)
    raw = block.values.tobytes()

    def content(start: int, count: int) -> bytes:
        return b" ".join(raw[starts[start] : ends[start + count + WIDTH - 2]].split())

    return content


UNITS = Units(WIDTH, word_names, _content)


class ReferenceBlock:
    """The words of a bucket's segments with an index of their runs.

    ``other`` gives for every run another place where it starts, or -1.
    """

    def __init__(self, found: Segments):
        sizes = np.array([len(c) for c in found.contents], np.int64)
        values = np.frombuffer(b"".join(found.contents), np.uint8)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        starts, ends, at = word_spans(values, offsets)
        self.words = word_hashes(values, starts, ends)
        self.begin, self.end = at[:-1], at[1:]
        self.windows = found.windows
        first = np.cumsum(found.windows) - found.windows
        inside = np.arange(found.windows.sum()) - np.repeat(first, found.windows)
        places = np.repeat(self.begin, found.windows) + inside
        self.segment_of = np.repeat(np.arange(len(sizes)), np.diff(at))
        keys = sequence_hashes(self.words, WIDTH)[places]
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        self.other = np.full(len(self.words), -1, np.int64)
        self.other[places[order[1:][same]]] = places[order[:-1][same]]
        self.other[places[order[:-1][same]]] = places[order[1:][same]]

    def factor(self, at: int, end: int) -> int:
        """Length of the factor at ``at``: how far another place of its run agrees."""
        place = int(self.other[at])
        if place < 0:
            return 0
        length = min(end - at, int(self.end[self.segment_of[place]]) - place)
        differ = self.words[at : at + length] != self.words[place : place + length]
        return int(differ.argmax()) if differ.any() else length

    def parse(self, segment: int) -> np.ndarray:
        """Marks of the segment's runs that lie in a factor or were found by themselves."""
        begin, end = int(self.begin[segment]), int(self.end[segment])
        n = int(self.windows[segment])
        marks = np.zeros(n, bool)
        known = np.flatnonzero(self.other[begin : begin + n] >= 0)
        turn = 0
        while turn < len(known):
            at = int(known[turn])
            length = self.factor(begin + at, end)
            if length < WIDTH:
                turn += 1
                continue
            # The factor's own runs; then go on with those that straddle its end.
            after = at + length - WIDTH + 1
            marks[at:after] = True
            turn = int(np.searchsorted(known, after))
        return marks


def found_elsewhere(found: Segments) -> tuple[np.ndarray, np.ndarray]:
    """Marks of runs that start at another place as well."""
    total = int(found.windows.sum())
    if not total:
        return np.zeros(0, bool), np.zeros(0, bool)
    block = ReferenceBlock(found)
    marks = np.zeros(total, bool)
    ends = np.cumsum(found.windows)
    for k, places in enumerate(found.places):
        a, b = ends[k] - found.windows[k], ends[k]
        marks[a:b] = True if len(places) > 1 else block.parse(k)
    return marks, marks


def _finish(block: Block, runs: np.ndarray) -> pa.RecordBatch:
    starts, ends, at = word_spans(block.values, block.offsets)
    gone = covered(runs, WIDTH, len(starts))
    removed = np.concatenate([[0], np.cumsum(gone)])[at]
    raw = block.values.tobytes()
    kept = []
    for i in range(len(block.ids)):
        if removed[i] == removed[i + 1]:
            kept.append(b" ".join(raw[block.offsets[i] : block.offsets[i + 1]].split()))
        else:
            left = at[i] + np.flatnonzero(~gone[at[i] : at[i + 1]])
            kept.append(b" ".join(raw[starts[w] : ends[w]] for w in left))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(block.ids, pa.int64()), pa.array(np.diff(at).astype(np.int64)),
            pa.array(np.diff(removed).astype(np.int64)), pa.array(kept, pa.binary()),
        ],
        ["doc_id", "n_words", "n_removed", "kept"],
    )


def substring_dedup(documents: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (words with one space)."""
    return repeated_windows(
        documents, UNITS, found_elsewhere, _finish,
        "doc_id bigint, n_words bigint, n_removed bigint, kept binary",
    )


def op7_substring_dedup(documents: DataFrame) -> DataFrame:
    """Counts of removed words and a digest of the rest."""
    return substring_dedup(documents).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )
