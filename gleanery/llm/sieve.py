"""Bit filters of keys, so that only rows which a join needs move to it.

A filter has no false negatives and at most ``MOST_BITS`` bits, whatever the number of
keys; it is sent to the executors as one row and tested where the rows are read. Rows that
pass by mistake are decided by the join behind it, so a full filter costs time and nothing
else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import sweeping, unused_name

#: Bits of a filter at most (16 MB), and for each key in it.
MOST_BITS = 1 << 27
BITS_EACH = 16


class Sieve:
    """The filter of all values of ``keys``, a stored table, under ``hashed`` of its columns."""

    def __init__(self, keys: DataFrame, hashed: Column):
        with sweeping(keys.sparkSession):
            wanted = max(1024, keys.count() * BITS_EACH)
            self.bits = min(MOST_BITS, 1 << (wanted - 1).bit_length())
            slot = F.explode(F.array(*self._slots(hashed))).alias("slot")
            mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), _place(F.col("slot")))
            words = keys.select(slot).groupBy(_word(F.col("slot")).alias("word"))
            found = words.agg(F.bit_or(mask).alias("mask")).toArrow()
        values = np.zeros(self.bits // 64, np.int64)
        values[found.column("word").to_numpy()] = found.column("mask").to_numpy()
        row = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))
        self.row = keys.sparkSession.createDataFrame(pa.table({"words": row}))

    def _slots(self, hashed: Column) -> list[Column]:
        return [h.bitwiseAND(self.bits - 1) for h in (hashed, F.xxhash64(hashed))]

    def passing(self, rows: DataFrame, hashed: Column) -> DataFrame:
        """Rows whose key is in the filter, and a few others."""
        return self._split(rows, hashed, "left_semi")

    def stopped(self, rows: DataFrame, hashed: Column) -> DataFrame:
        """The rows that do not pass; none of their keys is in the filter."""
        return self._split(rows, hashed, "left_anti")

    def _split(self, rows: DataFrame, hashed: Column, how: str) -> DataFrame:
        name = unused_name("words", rows.columns)
        first, second = (
            F.getbit(F.get(name, _word(s)), _place(s)) == 1 for s in self._slots(hashed)
        )
        words = F.broadcast(self.row.withColumnRenamed("words", name))
        return rows.join(words, first & second, how)


def _word(slot: Column) -> Column:
    return F.shiftright(slot, 6).cast("int")


def _place(slot: Column) -> Column:
    return slot.bitwiseAND(63).cast("int")
