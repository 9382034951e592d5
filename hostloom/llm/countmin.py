"""Count-min sketch over keys that tasks draw from rows; counters stop at two.

Each task sketches its own rows and hands on only the cells that it touched, by chunks of the sketch.
A shuffle by chunk merges the parts; what stays is one bit a cell: touched twice or more. Its size is a
parameter (`2 ** bits` cells in each of `ROWS` rows, so `ROWS * 2 ** bits / 8` bytes), whatever the input.
Cells only overestimate: a key that occurs twice always reads as repeated.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from hostloom.llm.common import mix

ROWS, CHUNK_BITS = 2, 20
#: Keys that a task holds before it hands its cells on.
BUFFER = 1 << 19


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(keys, 101 + row) >> np.uint64(64 - bits)


def build(df: DataFrame, keys: Callable[[dict], Iterator[np.ndarray]], bits: int) -> Broadcast:
    """keys: from the columns of a batch, arrays of unsigned 64-bit keys. Returns the broadcast bitmaps."""

    def touched(buffered: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        drawn = np.concatenate(buffered)
        for row in range(ROWS):
            cell, n = np.unique(cells(drawn, row, bits), return_counts=True)
            packed = ((cell & np.uint64((1 << CHUNK_BITS) - 1)) << np.uint64(1) | (n > 1).astype(np.uint64)).astype(np.uint32)
            chunk, first = np.unique(cell >> np.uint64(CHUNK_BITS), return_index=True)
            parts = np.split(packed, first[1:])
            yield pa.RecordBatch.from_arrays([pa.array((chunk.astype(np.int64) * ROWS + row).astype(np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], ["chunk", "part"])

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for drawn in keys({name: batch.column(i) for i, name in enumerate(batch.schema.names)}):
                held.append(drawn)
                n += len(drawn)
                if n >= BUFFER:
                    yield from touched(held)
                    held, n = [], 0
        if n:
            yield from touched(held)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = counts.setdefault(chunk, np.zeros(1 << CHUNK_BITS, dtype=np.uint8))
                packed = np.frombuffer(part, dtype=np.uint32)
                cell = packed >> np.uint32(1)
                seen[cell] = np.minimum(seen[cell] + 1 + (packed & np.uint32(1)).astype(np.uint8), 2)
        for chunk, seen in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([zlib.compress(np.packbits(seen == 2).tobytes(), 1)], pa.binary())], ["chunk", "part"])

    schema = "chunk int, part binary"
    merged = df.mapInArrow(sketch, schema).repartition("chunk").mapInArrow(merge, schema)
    maps = np.zeros((ROWS, 1 << max(bits - 3, CHUNK_BITS - 3)), dtype=np.uint8)
    size = 1 << (CHUNK_BITS - 3)
    for chunk, part in merged.toLocalIterator():  # a fixed number of chunks of a fixed size
        at, row = divmod(chunk, ROWS)
        maps[row, at * size : (at + 1) * size] = np.frombuffer(zlib.decompress(bytes(part)), dtype=np.uint8)
    return df.sparkSession.sparkContext.broadcast(maps)


def repeated(maps: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Which keys the sketch counts twice or more."""
    found = np.ones(len(keys), dtype=bool)
    for row in range(ROWS):
        cell = cells(keys, row, bits)
        found &= (maps[row, cell >> np.uint64(3)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1
    return found
