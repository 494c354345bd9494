"""Numpy steps shared by the operators that score blocks of rows in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_ROWS = 2048
#: Cells of a rows x queries matrix, of which a task holds a dozen at a time.
BLOCK_CELLS = 1 << 17


def row_blocks(batches: Iterator[pa.RecordBatch], queries: int = 1) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces small enough for a rows x queries matrix."""
    rows = min(BLOCK_ROWS, max(1, BLOCK_CELLS // max(1, queries)))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def key_order(block: pa.RecordBatch, key: list[str]) -> np.ndarray:
    """Position of each row in the order of the key, to break ties."""
    order = np.asarray(pc.sort_indices(block, sort_keys=[(c, "ascending") for c in key]))
    position = np.empty(len(order), dtype=np.int64)
    position[order] = np.arange(len(order))
    return position


def best_pairs(
    score: np.ndarray, tie: np.ndarray, position: np.ndarray, floor: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """(rows, queries) of the best k rows per query column of ``score``.

    Order: score, then ``tie``, both descending, then ``position``. Minus
    infinity marks pairs that do not count; pairs below ``floor``, the k-th best
    score of earlier blocks, cannot win any more.
    """
    if len(score) > k:
        floor = np.maximum(floor, np.partition(score, len(score) - k, axis=0)[len(score) - k])
    rows, queries = np.nonzero((score >= floor) & (score > -np.inf))
    order = np.lexsort((position[rows], -tie[rows, queries], -score[rows, queries], queries))
    rows, queries = rows[order], queries[order]
    nth = np.arange(len(queries)) - np.searchsorted(queries, queries, side="left")
    return rows[nth < k], queries[nth < k]


class RunningBest:
    """Best k rows per query over the blocks of one task."""

    def __init__(self, k: int, queries: int, order: list[tuple[str, str]]):
        self.k = k
        self.order = [("query", "ascending"), *order]
        self.floor = np.full(queries, -np.inf)
        self.tables: list[pa.Table] = []
        self.waiting = 0

    def add(self, pairs: pa.Table) -> None:
        self.tables.append(pairs)
        self.waiting += pairs.num_rows
        if self.waiting > 4 * self.k * len(self.floor) + 1000:
            self.result()

    def result(self) -> pa.Table | None:
        if not self.tables:
            return None
        merged = pa.concat_tables(self.tables).combine_chunks()
        merged = merged.take(pc.sort_indices(merged, sort_keys=self.order))
        queries = np.asarray(merged["query"])
        nth = np.arange(len(queries)) - np.searchsorted(queries, queries, side="left")
        merged = merged.filter(pa.array(nth < self.k))
        full = merged.filter(pa.array(nth[nth < self.k] == self.k - 1))
        self.floor[np.asarray(full["query"])] = np.asarray(full["score"])
        self.tables, self.waiting = [merged], 0
        return merged
