"""Byte-level BPE: a minimal perfect hash finds whole pre-tokens, a heap over linked bytes merges the others."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hostloom.llm.common import as_bytes, mix, span_hashes

#: Pre-tokens, and characters of pre-tokens, that a task remembers with their ids before it starts afresh.
MEMO_TOKENS, MEMO_CHARS = 1 << 18, 1 << 22
#: Rows of an Arrow batch that are handed on at once.
ROWS = 512


def _cut(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token, rank), by rank. Ranks must run from 0 without a gap."""
    with open(path, "rb") as file:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, file)}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must run from 0 without a gap")
    return [found[k] for k in range(len(found))]


def _hashed(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    return span_hashes(b"".join(words), np.append(0, ends[:-1]) if len(ends) else ends, ends, 50)


class PerfectHash:
    """Hash and displace: each of n different words has a place of its own in 0 to n - 1, and no place is free.

    Words share a bucket by one hash; each bucket stores the shift that puts its words on free places. Large buckets
    choose first. Buckets of one word take what is left: they store the place itself, as -1 - place.
    """

    def __init__(self, words: list[bytes], load: int = 3):
        n, hashes = len(words), _hashed(words)
        if len(np.unique(hashes)) < n:
            raise ValueError("words must differ, and so must their hashes")
        self.shift = np.zeros(max(1, n // load), dtype=np.int32)
        self.at = np.zeros(n, dtype=np.int32)
        bucket = self._bucket(hashes)
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if n else []
        free = np.ones(n, dtype=bool)
        alone = []
        for group in sorted(groups, key=len, reverse=True):
            if len(group) == 1:
                alone.append(int(group[0]))
                continue
            first = 0
            while True:  # a block of shifts at once; the least that fits is taken
                place = self._place(hashes[group], np.arange(first, first + 64)[:, None])
                fits = free[place].all(axis=1) & (np.diff(np.sort(place, axis=1), axis=1) > 0).all(axis=1)
                if fits.any():
                    break
                first += 64
            place = place[fits.argmax()]
            free[place] = False
            self.at[place] = group
            self.shift[bucket[group[0]]] = first + fits.argmax()
        for word, place in zip(alone, np.flatnonzero(free).tolist(), strict=True):
            self.at[place] = word
            self.shift[bucket[word]] = -1 - place

    def _bucket(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes % np.uint64(len(self.shift))).astype(np.int64)

    def _place(self, hashes: np.ndarray, shift) -> np.ndarray:
        return (mix(hashes + np.asarray(shift).astype(np.uint64), 51) % np.uint64(len(self.at))).astype(np.int64)

    def candidates(self, words: list[bytes]) -> np.ndarray:
        """The one word of the set, by number, that each word may be equal to; the caller compares the two."""
        if not len(self.at):
            return np.full(len(words), -1, dtype=np.int32)
        hashes = _hashed(words)
        shift = self.shift[self._bucket(hashes)]
        return self.at[np.where(shift < 0, -1 - shift, self._place(hashes, np.maximum(shift, 0)))]


class Vocabulary:
    """Tokens by rank, their perfect hash, and the merges: pairs of ranks whose tokens join into a third."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.hash = tokens, PerfectHash(tokens)
        rank = {t: k for k, t in enumerate(tokens)}
        self.bytes = [rank.get(bytes([b]), -1) for b in range(256)]
        if -1 in self.bytes:
            raise ValueError("every single byte must be a token")
        self.merges = {}
        for k, t in enumerate(tokens):
            for cut in range(1, len(t)):
                if (a := rank.get(t[:cut])) is not None and (b := rank.get(t[cut:])) is not None:
                    self.merges[a << 32 | b] = k

    def whole(self, words: list[bytes]) -> list[int]:
        """The rank of each word that is a token as it is; else -1."""
        tokens = self.tokens
        return [k if k >= 0 and tokens[k] == w else -1 for k, w in zip(self.hash.candidates(words).tolist(), words, strict=True)]

    def merged(self, word: bytes) -> list[int]:
        """The ranks that a word ends in when the pair of least rank is joined until none is left, leftmost first.

        Bytes are a linked list; pairs wait in a heap by rank and place, and one whose bytes have gone is passed over.
        """
        found, n = self.merges.get, len(word)
        ids = [self.bytes[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        bits = n.bit_length()
        low = (1 << bits) - 1
        heap = [r << bits | i for i in range(n - 1) if (r := found(ids[i] << 32 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, rank = top & low, top >> bits
            j = after[i]
            if ids[i] < 0 or j == n or found(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := found(rank << 32 | ids[k])) is not None:
                    heappush(heap, r << bits | i)
            h = before[i]
            if h >= 0 and (r := found(ids[h] << 32 | rank)) is not None:
                heappush(heap, r << bits | h)
        return [x for x in ids if x >= 0]


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def encode(documents: DataFrame, tokens: list[bytes], pattern: str) -> DataFrame:
    """One row per document row: doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers).

    The pattern cuts a text into pre-tokens; each is encoded by itself, without special tokens. Null and empty texts
    have no ids; whole texts are read, and a single pre-token of any length takes n log n steps. Repeated rows give
    repeated rows; an empty table gives an empty one; other columns are left out. The vocabulary is broadcast: its size
    doesn't grow with the documents.
    """
    shared = documents.sparkSession.sparkContext.broadcast(Vocabulary(tokens))

    def run(batches) -> Iterator[pa.RecordBatch]:
        vocabulary, split = shared.value, regex.compile(pattern).findall
        memo: dict[str, bytes] = {}
        chars = 0
        for batch in _cut(batches):
            n, ids = [], []
            for data in as_bytes(batch.column(1)):
                words = split(data.decode("utf-8", "replace")) if data else []
                new = list(set(words).difference(memo))
                if len(memo) + len(new) > MEMO_TOKENS or chars > MEMO_CHARS:
                    memo, chars, new = {}, 0, list(set(words))
                if new:
                    raw = [w.encode() for w in new]
                    chars += sum(map(len, new))
                    for w, r, k in zip(new, raw, vocabulary.whole(raw), strict=True):
                        memo[w] = _packed([k] if k >= 0 else vocabulary.merged(r))
                ids.append(b"".join(map(memo.__getitem__, words)))
                n.append(len(ids[-1]) // 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return documents.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokens: list[bytes]) -> DataFrame:
    """The encoded rows with `decoded`, the bytes that their ids stand for. Null ids give null; an unknown id is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(tokens)

    def run(batches) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in _cut(batches):
            out = [None if ids is None else b"".join(map(token, np.frombuffer(ids, dtype="<u4").tolist())) for ids in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
