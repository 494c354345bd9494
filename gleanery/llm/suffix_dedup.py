"""Suffix-array dedup: repeated byte strings by blockwise difference-cover sorting.

Texts are UTF-8 bytes. Each byte of a ``WIDTH``-byte string that also starts earlier (in
a document of a smaller doc_id, or earlier in the same one) is removed; strings overlap
and are judged on the input. ``repeats`` brings the suffixes that can share ``WIDTH``
bytes into one bucket. A bucket sorts its suffixes alone: by their first bytes, and where
these tie, by the ranks of a difference-cover sample of the bucket's text. The sample
holds, for any two suffixes, a pair at the same short distance behind them, so a tie of
any length takes one comparison of ranks, and memory is bounded by the bucket. Neighbours
in the sorted order that share ``WIDTH`` bytes are one group; its earliest member stays.

Defined cases: a null text is empty; documents shorter than ``WIDTH`` bytes keep
everything; a null doc_id is smaller than any other; rows that repeat a doc_id are
documents of their own, ordered by their contents' hash (rows equal in both in any
order); an empty table gives an empty result. Only doc_id and text are read.
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
from gleanery.llm.wordhash import mix

WIDTH = 100
#: Bytes of the pieces that name a string.
GRAM = 32
#: Period of the difference cover; ties of more bytes are decided by ranks.
PERIOD = 32

_BASE = 0x9E3779B97F4A7C15


def _gram_hashes(values: np.ndarray) -> np.ndarray:
    """A hash of every ``GRAM`` consecutive bytes (a power of two), by doubling."""
    hashes, have = values.astype(np.uint64) + np.uint64(1), 1
    while have < GRAM:
        factor = np.uint64(pow(_BASE, have, 2**64))
        hashes = hashes[:-have] * factor + hashes[have:]
        have *= 2
    return mix(hashes)


def byte_names(block: Block) -> Named:
    """Segments of the byte strings of a block."""
    n = len(block.values) - WIDTH + 1
    valid = np.ones(max(n, 0), bool)
    # Strings that start in the last bytes of a text reach into the next one.
    for end in block.offsets[1:-1]:
        valid[max(0, end - WIDTH + 1) : end] = False
    hashes = lambda a, b: _gram_hashes(block.values[a : b + GRAM - 1])
    return name_windows(n, valid, WIDTH, GRAM, hashes)


def _content(block: Block):
    raw = block.values.tobytes()
    return lambda start, count: raw[start : start + count + WIDTH - 1]


UNITS = Units(WIDTH, byte_names, _content)


def difference_cover(period: int) -> np.ndarray:
    """A small set of residues whose differences are all residues (greedily chosen)."""
    cover, seen = [0], np.zeros(period, bool)
    seen[0] = True
    while not seen.all():
        def gain(c):
            new = seen.copy()
            for d in cover:
                new[(c - d) % period] = new[(d - c) % period] = True
            return new

        best = max((c for c in range(period) if c not in cover), key=lambda c: gain(c).sum())
        seen = gain(best)
        cover.append(best)
    return np.array(sorted(cover))


COVER = difference_cover(PERIOD)


def _distances() -> np.ndarray:
    """For residues (i, j): the least d with i + d and j + d both in the cover."""
    inside = np.isin(np.arange(PERIOD), COVER)
    table = np.zeros((PERIOD, PERIOD), np.int64)
    for i in range(PERIOD):
        for j in range(PERIOD):
            d = np.arange(PERIOD)
            table[i, j] = d[inside[(i + d) % PERIOD] & inside[(j + d) % PERIOD]][0]
    return table


_DISTANCE = _distances()


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes at every position as one big-endian number."""
    padded = np.concatenate([text, np.zeros(7, np.uint8)]).astype(np.uint64)
    found = np.zeros(len(text), np.uint64)
    for i in range(8):
        found |= padded[i : i + len(text)] << np.uint64(56 - 8 * i)
    return found


def _refine(order: np.ndarray, group: np.ndarray, keys_at: np.ndarray, at: int):
    """Sort positions by the key at distance ``at`` within groups of ties.

    Only positions that are still tied move. ``group`` holds the index of the first
    member of each position's group, by place in the order. Returns the places that moved.
    """
    ties = np.zeros(len(order), bool)
    same = group[1:] == group[:-1]
    ties[1:] |= same
    ties[:-1] |= same
    place = np.flatnonzero(ties)
    if len(place):
        keys = keys_at[np.minimum(order[place] + at, len(keys_at) - 1)]
        by = np.lexsort((keys, group[place]))
        order[place] = order[place][by]
        keys, old = keys[by], group[place][by]
        start = np.ones(len(place), bool)
        start[1:] = (keys[1:] != keys[:-1]) | (old[1:] != old[:-1])
        group[place] = place[np.maximum.accumulate(np.where(start, np.arange(len(place)), 0))]
    return place


def cover_ranks(text: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Ranks of the sample suffixes, at their positions (0 behind the text).

    The sample is sorted by four periods of bytes. A period behind a sample position is
    another one, so from there on ranks double the depth until no tie is left.
    """
    order = np.flatnonzero(np.isin(np.arange(len(text)) % PERIOD, COVER))
    group = np.zeros(len(order), np.int64)
    depth = 4 * PERIOD
    for at in range(0, depth, 8):
        _refine(order, group, words, at)
    ranks = np.zeros(len(text) + PERIOD + 1, np.int64)
    ranks[order] = group + 1
    while depth < 2 * len(text):
        place = _refine(order, group, ranks, depth)
        ranks[order[place]] = group[place] + 1
        depth *= 2
        if not len(place):
            break
    # Left are suffixes of zero bytes up to the end; the shorter one comes first.
    place = _refine(order, group, -np.arange(len(text) + 1), 0)
    ranks[order[place]] = group[place] + 1
    return ranks


def _merge_ties(order: np.ndarray, group: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Sort the members of each group by the ranks of their common cover distance.

    A merge sort of all groups at once: each member finds its place among the members of
    the neighbouring run by binary search.
    """
    def before(a, b, equal):
        d = _DISTANCE[a % PERIOD, b % PERIOD]
        ra, rb = ranks[a + d], ranks[b + d]
        return (ra < rb) | (equal & (ra == rb))

    n = len(order)
    place = np.arange(n)
    end = np.searchsorted(group, group, side="right")
    inside = place - group
    width, longest = 1, int((end - group).max(initial=0))
    while width < longest:
        run = inside // width
        left = run % 2 == 0
        other = group + np.where(left, run + 1, run - 1) * width
        lo = np.minimum(other, end)
        hi = np.minimum(other + width, end)
        first = lo.copy()
        active = np.flatnonzero(lo < hi)
        while len(active):
            middle = (lo[active] + hi[active]) // 2
            # Equal members keep their order: those of the left run come first.
            smaller = before(order[middle], order[active], ~left[active])
            lo[active] = np.where(smaller, middle + 1, lo[active])
            hi[active] = np.where(smaller, hi[active], middle)
            active = active[lo[active] < hi[active]]
        pair = group + (run - (run % 2)) * width
        target = pair + (place - (group + run * width)) + (lo - first)
        moved = np.empty_like(order)
        moved[target] = order
        order = moved
        width *= 2
    return order


def sort_suffixes(text: np.ndarray, positions: np.ndarray):
    """``positions`` in the order of their suffixes, and the words of the text. At least
    ``PERIOD`` bytes must follow each position."""
    words = _words(text)
    ranks = cover_ranks(text, words)
    order, group = positions.copy(), np.zeros(len(positions), np.int64)
    for at in range(0, PERIOD, 8):
        _refine(order, group, words, at)
    return _merge_ties(order, group, ranks), words


def _same_strings(order: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether each suffix in the order shares ``WIDTH`` bytes with the one before."""
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        a, b = order[1:], order[:-1]
        equal = np.ones(len(a), bool)
        for at in [*range(0, WIDTH - 8, 8), WIDTH - 8]:
            equal &= words[a + at] == words[b + at]
        same[1:] = equal
    return same


def earliest_stay(found: Segments) -> tuple[np.ndarray, np.ndarray]:
    """Marks of windows that occur earlier. A segment's later places are copies of its
    first one, so all their windows are marked."""
    total = int(found.windows.sum())
    first, later = np.zeros(total, bool), np.ones(total, bool)
    if not total:
        return first, later
    # Zero bytes behind every segment: no string reaches into the next one unnoticed,
    # as only positions inside a segment are sorted and compared over WIDTH bytes.
    text = np.frombuffer(b"".join(found.contents) + bytes(WIDTH + PERIOD), np.uint8)
    sizes = np.array([len(c) for c in found.contents])
    base = np.cumsum(sizes) - sizes
    begin = np.cumsum(found.windows) - found.windows
    inside = np.arange(total) - np.repeat(begin, found.windows)
    positions = np.repeat(base, found.windows) + inside
    block = np.repeat(np.array([p[0][0] for p in found.places]), found.windows)
    start = np.repeat(np.array([p[0][1] for p in found.places]), found.windows) + inside
    order, words = sort_suffixes(text, positions)
    number = np.empty(len(text), np.int64)
    number[positions] = np.arange(total)
    group = np.cumsum(~_same_strings(order, words))
    members = number[order]
    by = np.lexsort((start[members], block[members], group))
    members, group = members[by], group[by]
    copies = np.zeros(total, bool)
    copies[1:] = group[1:] == group[:-1]
    first[members[copies]] = True
    return first, later


def _finish(block: Block, starts: np.ndarray) -> pa.RecordBatch:
    gone = covered(starts, WIDTH, len(block.values))
    edges = np.zeros(len(gone) + 1, bool)
    edges[:-1] = gone
    edges[1:-1] &= ~gone[:-1]
    inner = block.offsets[:-1][block.offsets[:-1] < len(gone)]
    edges[inner] = gone[inner]
    removed = np.concatenate([[0], np.cumsum(gone)])[block.offsets]
    spans = np.concatenate([[0], np.cumsum(edges[:-1])])[block.offsets]
    left = block.values[~gone].tobytes()
    kept = block.offsets - removed
    return pa.RecordBatch.from_arrays(
        [
            pa.array(block.ids, pa.int64()),
            pa.array(np.diff(block.offsets)), pa.array(np.diff(removed)),
            pa.array(np.diff(spans)),
            pa.array([left[a:b] for a, b in zip(kept[:-1], kept[1:], strict=True)], pa.binary()),
        ],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
    )


def suffix_dedup(documents: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (bytes)."""
    return repeated_windows(
        documents, UNITS, earliest_stay, _finish,
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary",
    )


def op2_suffix_dedup(documents: DataFrame) -> DataFrame:
    """Counts of removed bytes and a digest of the rest."""
    return suffix_dedup(documents).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
