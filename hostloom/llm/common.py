"""Shared helpers of the training-data operators: settled tables, checked broadcasts, word hashes."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostloom.functions.shared import discard, settle, shared_dir  # noqa: F401

#: Bytes of a side that may be broadcast after its rows were counted.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int, width: int) -> DataFrame:
    """Broadcast a side whose counted rows, of about `width` bytes each, stay under the limit; else leave the join to a shuffle."""
    return F.broadcast(df) if rows * (width + 32) <= BROADCAST_BYTES else df


def row_key() -> F.Column:
    """Names a row by its id and text: rows that share it are equal in both, so they share all results."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


#: Rows of an Arrow batch that are held as Python objects at once.
SLICE = 128


def as_bytes(column: pa.Array) -> Iterator[bytes | None]:
    """The texts of a batch's column, a slice at a time, so a batch is never held twice."""
    for k in range(0, len(column), SLICE):
        yield from column.slice(k, SLICE).cast(pa.large_binary()).to_pylist()


def apart_from(spans: list[tuple]) -> Callable[[int, int], bool]:
    """Whether (start, end) overlaps none of the spans, which are in order of start and may overlap each other."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e, *_ in spans:
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)

    def clear(s: int, e: int) -> bool:
        k = bisect_left(starts, e) - 1  # the last that starts before the end
        return k < 0 or ends[k] <= s

    return clear


# --- vectorised hashes -------------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SIZE, _ROLL = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
_LANE = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser over unsigned arrays."""
    x = x + np.uint64((seed * 0xA24BAED4963EE407 + 0x9FB21C651E98DF25) & _MASK)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words [^\\x20\\x09-\\x0D]+: starts and ends (exclusive)."""
    word = np.zeros(len(buf) + 2, dtype=bool)
    np.logical_not(_SPACE[buf], out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def word_hashes(data: bytes, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word of the text, in order; hashes of two seeds are independent from the bytes up.

    Words are read in lanes of eight bytes. Each lane passes the finaliser with its place before lanes are added up, so
    no pattern of letters cancels out, as it would in a polynomial modulo 2 ** 64.
    """
    starts, ends = word_bounds(np.frombuffer(data, dtype=np.uint8))
    return span_hashes(data, starts, ends, seed)


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """The hashes of word_hashes for any spans of the bytes, in their order."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    whole = data + bytes(8)
    sizes = ends - starts
    eight = np.ndarray(len(whole) - 7, dtype="<u8", buffer=whole, strides=(1,))
    out = eight[starts] & _LANE[np.minimum(sizes, 8)]
    out = mix(out + sizes.astype(np.uint64) * np.uint64(_SIZE), seed)
    long = np.flatnonzero(sizes > 8)
    if len(long):
        size = sizes[long]
        lanes = (size - 1) >> 3
        cut = np.cumsum(lanes) - lanes
        own = np.repeat(np.arange(len(long)), lanes)
        k = np.arange(len(own)) - cut[own] + 1
        lane = eight[starts[long][own] + 8 * k] & _LANE[np.minimum(size[own] - 8 * k, 8)]
        lane = mix(lane ^ mix(k.astype(np.uint64), seed + 1), seed + 2)
        out[long] = mix(out[long] + np.add.reduceat(lane, cut), seed + 3)
    return out


def rolling(words: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of `length` words, by doubling: log(length) passes and no power tables. Each doubling folds the
    high bits back, so runs of repeating words don't cancel out either."""
    m = len(words) - length + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    part, size, done, total = mix(words, seed), 1, 0, np.zeros(m, dtype=np.uint64)
    while size <= length:
        shift = np.uint64(pow(_ROLL, size, 1 << 64))
        if length & size:
            total = total * shift + part[done : done + m]
            total ^= total >> np.uint64(31)
            done += size
        if 2 * size <= length:
            part = part[:-size] * shift + part[size:]
            part ^= part >> np.uint64(29)
        size *= 2
    return mix(total, seed + 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` entries."""
    return _slide(x, width, np.minimum)


def sliding_max(x: np.ndarray, width: int) -> np.ndarray:
    return _slide(x, width, np.maximum)


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x, size = best(x[:-size], x[size:]), 2 * size
    return best(x[: len(x) - (width - size)], x[width - size :]) if width > size else x
