"""Rows left out before a shuffle: a blocked Bloom filter of the keys on the other side.

A key sets four bits of one 64-bit block. Spark puts the blocks together by ``bit_or``, so
building adds up in tasks, and their number is bounded whatever the keys: a filter that is
too small for them lets more rows through, and loses none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import ROWS

# Blocks per key, and blocks at most: 8 bytes each in the broadcast.
BLOCKS_PER_KEY = 0.25
BLOCKS = 1 << 22
# Shifts of the key that name a block's bits, and the one that names the block.
BIT_SHIFTS, BLOCK_SHIFT = (0, 6, 12, 18), 24


def known(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which of the keys may be among those of the filter."""
    own = table[(key >> BLOCK_SHIFT) % len(table)]
    bits = np.zeros(len(key), np.int64)
    for shift in BIT_SHIFTS:
        bits |= np.int64(1) << ((key >> shift) & 63)
    return (own & bits) == bits


class KeyFilter:
    """Whether keys (bigint hashes) may be among those of ``keys`` (key)."""

    def __init__(self, keys: DataFrame, most: int = BLOCKS):
        blocks = min(max(int(keys.count() * BLOCKS_PER_KEY), 1), most)
        bits = " | ".join(
            f"shiftleft(1L, cast(shiftright(key, {s}) & 63 as int))" for s in BIT_SHIFTS
        )
        block = F.pmod(F.shiftright("key", BLOCK_SHIFT), F.lit(blocks))
        rows = keys.select(block.alias("block"), F.expr(bits).alias("bits"))
        # At most ``most`` rows.
        found = rows.groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
        table = np.zeros(blocks, np.int64)
        table[found.column("block").to_numpy()] = found.column("bits").to_numpy()
        self.table = keys.sparkSession.sparkContext.broadcast(table)

    def split(self, rows: DataFrame, inside: bool) -> DataFrame:
        """The rows (with a column ``key``) that may be in, or those that are not."""
        return rows.mapInArrow(self.choosing(rows, inside), rows.schema)

    def choosing(self, rows: DataFrame, inside: bool) -> Callable:
        """``split`` as a step on batches of ``rows``, for a function that goes on with
        them in the same worker."""
        shared, place = self.table, rows.columns.index("key")

        def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value
            for whole in batches:
                # A few rows at a time: what is chosen is a copy of theirs.
                for i in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(i, ROWS)
                    key = batch.column(place).to_numpy(zero_copy_only=False)
                    yield batch.filter(pa.array(known(table, key) == inside))

        return choose
