"""Words and shingles of a batch of texts as hashed numpy arrays.

A word is a run of bytes other than the six white-space bytes; this equals the rule on
characters, as those bytes never occur inside a longer UTF-8 character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from gleanery.llm.common import SPACE_BYTES

#: Bytes hashed at once; longer words make larger pieces.
PIECE = 1 << 19

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BYTE_VALUES = np.random.Generator(np.random.PCG64(17)).integers(
    1, 2**63, 256, dtype=np.uint64
)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, (length - 1).bit_length())
    if size not in _POWERS:
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the len + 1 offsets of a string or binary column; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(values: np.ndarray, offsets: np.ndarray):
    """Starts and ends of all words, and per text the number of words before it."""
    inside = np.zeros(len(values) + 2, bool)
    inside[1:-1] = ~_IS_SPACE[values]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(values))]
    first[edges] = inside[1:-1][edges]
    last[edges - 1] = inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(
    values: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False
) -> np.ndarray:
    """A 64-bit hash per word: a polynomial of random byte values, then mixed."""
    found = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, side="right")))
        base = starts[at]
        piece = values[base : ends[stop - 1]]
        up, down = _powers(len(piece))
        terms = _BYTE_VALUES[_LOWER[piece] if lower else piece] * up[: len(piece)]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        a, b = starts[at:stop] - base, ends[at:stop] - base
        found[at:stop] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        at = stop
    return found


def sequence_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash for every run of ``length`` words; 63 bits, so that it sorts alike with or
    without a sign."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, length, np.uint64)
    for i in range(length):
        total = total * np.uint64(0xD1342543DE82EF95) + words[i : i + n]
    return mix(total) >> np.uint64(1)


def batches(table: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices whose texts have about ``most`` bytes; a longer text is a slice alone."""
    lengths = np.asarray(pa.compute.binary_length(table.column(column)).fill_null(0))
    ends = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < len(lengths):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield table.slice(at, stop - at)
        at = stop
