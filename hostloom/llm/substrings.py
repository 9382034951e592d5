"""Repeated-passage removal: a count-min prefilter, then exact groups of the windows that it leaves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.llm import countmin
from hostloom.llm.common import as_bytes, rolling, row_key, settle, sliding_max, sliding_min, word_hashes

WINDOW = 35
#: Cells in each row of the sketch, as a power of two: 2 rows of 2 ** 27 bits are broadcast, 32 MB.
SKETCH_BITS = 27
#: Rows of windows that are handed on at once.
BATCH = 200_000


def marks(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(mark of each window, marks drawn in the text).

    A window is sketched by its mark, the least hash of its grams (about half a window long). Equal windows have equal
    marks at equal places, so a mark is drawn at least as often as any of its windows starts; and a text draws only
    about a tenth as many marks as it has windows, which lets a sketch of fixed size tell more of them apart.
    """
    gram = max(1, window // 2 - 1)
    grams, width = rolling(words, gram, 41), window - gram + 1
    if len(grams) < width:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    least = sliding_min(grams, width)
    pad = np.zeros(width - 1, dtype=np.uint64)
    drawn = sliding_max(np.concatenate((pad, least, pad)), width) == grams
    return least, grams[drawn]


def repeats(documents: DataFrame, window: int = WINDOW, bits: int = SKETCH_BITS):
    """(sketch, singles): the broadcast sketch, and (key, pos) of the windows it wrongly counts as repeated.

    All starts of windows that the sketch counts twice are grouped by two hashes of the window, 96 bits that are
    independent from the bytes up, with counts combined before the shuffle; a group of one names the only place of a window that isn't repeated. What remains are exactly
    the repeated windows, and copies of any number never meet in one task.
    """

    def keys(columns: dict) -> Iterator[np.ndarray]:
        for data in as_bytes(columns["text"]):
            yield marks(word_hashes(data), window)[1]

    texts = documents.where(F.col("text").isNotNull())
    sketch = countmin.build(texts.select("text"), keys, bits)

    def starts(batches) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def rows(held):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[i] for h in held])) for i in range(4)], ["h1", "h2", "key", "pos"])

        for batch in batches:
            for data, key in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words = word_hashes(data)
                at = np.flatnonzero(countmin.repeated(sketch.value, marks(words, window)[0], bits))
                if len(at):
                    h2 = (rolling(word_hashes(data, 200), window, 53)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    held.append((rolling(words, window, 51)[at].view(np.int64), h2, np.full(len(at), key, dtype=np.int64), at.astype(np.int32)))
                    n += len(at)
                if n >= BATCH:
                    yield rows(held)
                    held, n = [], 0
        if n:
            yield rows(held)

    found = texts.select("text", row_key().alias("key")).mapInArrow(starts, "h1 long, h2 int, key long, pos int")
    groups = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("key").alias("key"), F.min("pos").alias("pos"))
    return sketch, groups.where(F.col("n") == 1).select("key", "pos")


def strip_repeats(documents: DataFrame, window: int = WINDOW, bits: int = SKETCH_BITS) -> DataFrame:
    """One row per document row: doc_id, n_words, n_removed, kept_sha256, kept (text of the words that stay).

    A word goes if a window of `window` consecutive words covers it that also starts anywhere else, in the same or
    another document; windows are judged on the input. Words are [^\\x20\\x09-\\x0D]+, kept ones are joined by a space.
    Null text has no words and keeps the empty text; texts shorter than a window stay; repeated rows are other
    documents, so their windows are repeated. Long texts are read whole.
    """
    sketch, singles = repeats(documents, window, bits)
    singles = settle(singles)
    by_row = singles.groupBy("key").agg(F.collect_list("pos").alias("singles"))  # at most a document's windows
    docs = documents.select(F.col("doc_id").cast("long"), "text", row_key().alias("key"))

    # which rows have singles, as a filter of fixed size that never misses one: each key is counted twice
    def twice(columns: dict) -> Iterator[np.ndarray]:
        yield np.repeat(np.asarray(columns["key"]).view(np.uint64), 2)

    having = countmin.build(singles.select("key").distinct(), twice, bits)

    def part(batch: pa.RecordBatch, wanted: bool) -> pa.RecordBatch:
        has = countmin.repeated(having.value, np.asarray(batch.column(2)).view(np.uint64), bits)
        return batch.filter(pa.array(has == wanted))

    def in_place(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = part(batch, False)
            yield pa.RecordBatch.from_arrays([rest.column(0), rest.column(1), pa.nulls(len(rest), pa.list_(pa.int32()))], ["doc_id", "text", "singles"])

    def to_join(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield part(batch, True)

    def kept(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digest, text = [], [], [], []
            for data, single in zip(as_bytes(batch.column(1)), batch.column(2), strict=True):
                words = (data or b"").split()
                if len(words) >= window:
                    hashes = word_hashes(data)
                    hit = countmin.repeated(sketch.value, marks(hashes, window)[0], bits)
                    if single.is_valid:
                        hit[np.asarray(single.values)] = False
                    if hit.any():
                        cover = np.zeros(len(words) + 1, dtype=np.int32)
                        at = np.flatnonzero(hit)
                        cover[at] += 1
                        cover[at + window] -= 1
                        stay = np.cumsum(cover[:-1]) == 0
                        left = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                    else:
                        left = words
                else:
                    left = words
                line = b" ".join(left)
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                digest.append(hashlib.sha256(line).hexdigest())
                text.append(line)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(text, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    # only rows that may have singles are shuffled, to meet them; hashed, so texts needn't be sorted. The others stay where they are
    joined = docs.mapInArrow(to_join, "doc_id long, text string, key long").join(by_row.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "singles")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    return docs.mapInArrow(lambda batches: kept(in_place(batches)), out).unionByName(joined.mapInArrow(kept, out))
