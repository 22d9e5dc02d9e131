"""A set of numbers in bounded memory, to drop rows before a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = (16, 27)  # least and most bits of a bitmap, as powers of two


class Bitmap:
    """A set of 64-bit numbers in bounded memory; may hold more, never less."""

    def __init__(self, numbers: DataFrame, column: str, spread: int = 8):
        count = numbers.count()
        self.bits = min(max(BITS[0], (spread * count).bit_length()), BITS[1])
        slot = F.col(column).bitwiseAND(F.lit((1 << self.bits) - 1))
        found = (
            numbers.select(F.shiftright(slot, 6).alias("cell"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit"))
            .groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
        )
        self.cells = np.zeros(1 << (self.bits - 6), np.uint64)
        self.cells[found.column("cell").to_numpy()] = found.column("bits").to_numpy().astype(np.int64).view(np.uint64)

    def has(self, numbers: np.ndarray) -> np.ndarray:
        slot = numbers & np.uint64((1 << self.bits) - 1)
        return (self.cells[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def likely_in(rows: DataFrame, column: str, numbers: DataFrame, number: str, inside: bool = True) -> DataFrame:
    """Rows of ``rows`` whose long ``column`` may be among ``numbers``; all that are stay.

    A join has to follow.  It saves shuffling rows that the join would drop; a null is dropped.
    With ``inside`` False, all other rows: none of them is among ``numbers``.
    """
    held = rows.sparkSession.sparkContext.broadcast(Bitmap(numbers, number))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(column)
            there = held.value.has(key.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
            there &= key.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(there == inside))

    return rows.mapInArrow(run, rows.schema)


class Sieve(Bitmap):
    """A set like ``Bitmap`` that looks at two places for each number and lets fewer others through."""

    def __init__(self, numbers: DataFrame, column: str, spread: int = 32):
        both = F.explode(F.array(F.col(column), F.shiftrightunsigned(F.col(column), 32)))
        super().__init__(numbers.select(both.alias(column)), column, spread)

    def has(self, numbers: np.ndarray) -> np.ndarray:
        return super().has(numbers) & super().has(numbers >> np.uint64(32))


def maybe_in(column: Column, held) -> Column:
    """Whether a long, or any long of an array, may be in the broadcast set ``held``; null is not.

    Only ``column`` travels to Python; the rest of the row stays in the JVM.
    """

    @F.arrow_udf("boolean")
    def there(numbers: pa.Array) -> pa.Array:
        ends = numbers.flatten() if pa.types.is_list(numbers.type) else numbers
        found = held.value.has(ends.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
        found &= ends.is_valid().to_numpy(zero_copy_only=False)
        if ends is numbers:
            return pa.array(found)
        sums = np.concatenate([[0], np.cumsum(found)])
        size = pc.fill_null(pc.list_value_length(numbers), 0).to_numpy(zero_copy_only=False)
        last = np.cumsum(size)
        return pa.array(sums[last] > sums[last - size])

    return there(column)
