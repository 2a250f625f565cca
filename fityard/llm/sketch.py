"""How often hashed values occur, as one small table that every task can hold.

``occurrence_levels`` counts values in ``2 ** LOG_BUCKETS`` buckets over all rows and sends the counts,
rounded to half powers of two, to all tasks: 4 MB however large the input is. Two values may share a
bucket, so a level is an upper bound of a value's own count; level 1 means that it occurs once. Operators
use levels to put the values of a row in order of rarity. Any order that is the same everywhere gives
the same results, so rounding and shared buckets only cost time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

LOG_BUCKETS = 22
_SLICES = 1 << 10


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - LOG_BUCKETS)).astype(np.int64)


def occurrence_levels(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> Broadcast:
    """Broadcast ``uint8`` array of levels by bucket: 0 never, 1 once, then 1 + 2 log2(count), at most 63.
    ``hashes`` gives the 64-bit hashes to count of one record batch of ``rows``."""
    width = (1 << LOG_BUCKETS) // _SLICES

    def slices(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = counts.reshape(_SLICES, width)
        used = np.flatnonzero(table.any(axis=1))
        for a in range(0, len(used), 64):
            at = used[a:a + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array([table[i].tobytes() for i in at], pa.binary())],
                names=["slice", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << LOG_BUCKETS, dtype=np.uint32)
        for batch in batches:
            for h in hashes(batch):
                np.add.at(total, buckets_of(h), np.uint32(1))
        yield from slices(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(counts.as_py(), dtype=np.uint32)
                sums[at] = sums[at] + part if at in sums else part.astype(np.uint64)
        for at, part in sums.items():
            level = np.where(part > 0, 1 + np.floor(2 * np.log2(np.maximum(part, 1))), 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int32()), pa.array([np.minimum(level, 63).astype(np.uint8).tobytes()])],
                names=["slice", "levels"])

    spark = rows.sparkSession
    parts = (rows.mapInArrow(count, "slice int, counts binary").repartition("slice")
             .mapInArrow(add, "slice int, levels binary"))
    levels = np.zeros((_SLICES, width), dtype=np.uint8)
    for row in parts.toLocalIterator():
        levels[row["slice"]] = np.frombuffer(row["levels"], dtype=np.uint8)
    return spark.sparkContext.broadcast(levels.reshape(-1))
