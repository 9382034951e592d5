"""Quality rules: fixed heuristics, and a calibrated logistic regression over hashed word and character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.llm.common import _SPACE, as_bytes, discard, mix, rolling, settle, word_hashes

BITS = 14
#: Labelled documents that the model is fitted on, at most; chosen by hash of the id.
TRAIN_ROWS = 3_000
#: A document is rejected from this calibrated probability of low quality on.
REJECT_AT = 0.9
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def rule_counts(data: bytes, words: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    buf = np.frombuffer(data, dtype=np.uint8)
    chars = int(((buf & 0xC0) != 0x80).sum() - _SPACE[buf].sum())
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line.split():
            dup += line in seen
            seen.add(line)
    grams = np.stack([rolling(words, REPEAT_WINDOW, 11), rolling(words, REPEAT_WINDOW, 12)], axis=1)
    repeat = 0
    if len(grams):
        order = np.lexsort((grams[:, 1], grams[:, 0]))
        same = (grams[order][1:] == grams[order][:-1]).all(axis=1)
        twice = np.zeros(len(grams) + 1, dtype=bool)
        twice[order[:-1][same]] = True
        twice[order[1:][same]] = True
        cover = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(cover, np.flatnonzero(twice), 1)
        np.add.at(cover, np.flatnonzero(twice) + REPEAT_WINDOW, -1)
        repeat = int((np.cumsum(cover) > 0).sum())
    return chars, int(_SYMBOL[buf].sum()), dup, repeat


def hashed_features(data: bytes, words: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Sparse (index, value): word 1- and 2-grams, 3- and 4-grams of code points; log counts, unit length."""
    points = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    grams = [mix(words, 21), rolling(words, 2, 22), rolling(points, 3, 23), rolling(points, 4, 24)]
    counts = np.bincount((np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    at = np.flatnonzero(counts)
    value = np.log1p(counts[at])
    return at.astype(np.int32), (value / max(1e-9, np.sqrt((value**2).sum()))).astype(np.float32)


#: Rows that the fit handles at once.
CHUNK = 128


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, rounds: int = 150, ridge: float = 1e-3, n: np.ndarray | None = None) -> np.ndarray:
    """Weights and, last, the bias; full-batch Adam over a bounded sample, so reruns agree. Gradients are summed over
    chunks of rows, so nothing but the sparse rows themselves is held. y: 0 to 1, soft labels count for both classes by
    their share; `n` weighs rows; either class weighs half in all."""
    w, m, v = np.zeros(dims + 1), np.zeros(dims + 1), np.zeros(dims + 1)
    n = np.ones(len(y)) if n is None else n
    yes, no = 0.5 * n * y / max(1e-9, (n * y).sum()), 0.5 * n * (1 - y) / max(1e-9, (n * (1 - y)).sum())
    for step in range(1, rounds + 1):
        g = ridge * np.append(w[:-1], 0) / len(rows)
        for k in range(0, len(rows), CHUNK):
            part = rows[k : k + CHUNK]
            at, value = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
            owner = np.repeat(np.arange(len(part), dtype=np.int32), [len(r[0]) for r in part])
            p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, value * w[at], len(part)) + w[-1], -40, 40)))
            slope = no[k : k + CHUNK] * p - yes[k : k + CHUNK] * (1 - p)
            g[:-1] += np.bincount(at, value * slope[owner], dims)
            g[-1] += slope.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities, on rows held out of the fit."""
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y <= 0).sum() + 2))
    loss = lambda a, b: float((np.logaddexp(0, a * z + b) - t * (a * z + b)).sum())
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        s = p * (1 - p) + 1e-9
        g = np.array([((p - t) * z).sum(), (p - t).sum()])
        h = np.array([[(s * z * z).sum(), (s * z).sum()], [(s * z).sum(), s.sum()]]) + 1e-6 * np.eye(2)
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > loss(a, b):
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
    return float(a), float(b)


def train(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, bits: int = BITS) -> tuple[np.ndarray, float, float] | None:
    """Weights and calibration from labelled quality rows (quality 0 is the positive class); None without both kinds.

    A fifth of the sample is held out of the fit for the calibration. Labels with a null id or quality are ignored; an id
    with several labels has the least of them, an id with several texts the least text. One task fits the model to the
    sample, which `train_rows` bounds whatever the input, and hands the driver 2 ** bits weights.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = settle(known.withColumn("lot", F.xxhash64("doc_id", F.lit(5))))
    n, unit = max(1, known.count()), 1 << 20
    share = min(1.0, 1.5 * train_rows / n)  # cut down by hash first, so that few rows are ranked
    chosen = settle(known.where(F.pmod("lot", F.lit(unit)) < int(share * unit)).orderBy("lot", "doc_id").limit(train_rows))
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # train_rows rows at most
    once = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def features(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), CHUNK):
                part = batch.slice(k, CHUNK)
                made = [hashed_features(t, word_hashes(t), bits) for t in as_bytes(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([m[0].tobytes() for m in made], pa.binary()), pa.array([m[1].tobytes() for m in made], pa.binary())], ["doc_id", "quality", "at", "value"])

    def fit(batches) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for i, q, at, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows.append((i, q, (np.frombuffer(at, np.int32), np.frombuffer(value, np.float32))))
        rows.sort(key=lambda r: r[0])
        made = fitted([r[2] for r in rows], np.array([r[1] == 0 for r in rows], dtype=np.float64), bits)
        out = [] if made is None else [(made[0].tobytes(), made[1], made[2])]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.float64())], ["w", "a", "b"])

    sample = settle(once.select(F.col("doc_id").cast("long"), "quality", "text").mapInArrow(features, "doc_id long, quality int, at binary, value binary"))
    found = sample.repartition(1).mapInArrow(fit, "w binary, a double, b double").collect()  # one row
    discard(known, chosen, sample)
    return (np.frombuffer(bytes(found[0].w), np.float32), found[0].a, found[0].b) if found else None


def fitted(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, bits: int) -> tuple[np.ndarray, float, float] | None:
    """Weights, and slope and offset of the calibration; None where there is too little of either kind."""
    held = np.arange(len(x)) % 5 == 4
    if len(x) < 10 or min(y[~held].sum(), (1 - y[~held]).sum()) < 1:
        return None
    w = fit_logistic([r for r, h in zip(x, held, strict=True) if not h], y[~held], 1 << bits)
    z = np.array([float(w[at] @ value) + w[-1] for (at, value), h in zip(x, held, strict=True) if h])
    a, b = platt(z, y[held])
    return (w.astype(np.float32), a, b) if a > 0 else (w.astype(np.float32), 1.0, 0.0)


def verdict(data: bytes, model: tuple[np.ndarray, float, float] | None, reject_at: float, bits: int) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_low of a text."""
    words = word_hashes(data)
    n, counts, p = len(words), rule_counts(data, words), None
    failed = n < MIN_WORDS or 100 * counts[3] > MAX_REPEAT_PERCENT * n
    if model is not None:
        at, value = hashed_features(data, words, bits)
        w, a, b = model
        p = float(1 / (1 + np.exp(-np.clip(a * (float(w[at] @ value) + float(w[-1])) + b, -40, 40))))
    return n, *counts, failed, not failed and (p is None or p < reject_at), p


def judge(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, reject_at: float = REJECT_AT, bits: int = BITS) -> DataFrame:
    """One row per document row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_low.

    Null and empty texts have no words and fail. Without labels of both kinds the fixed rules decide alone (p_low null).
    Repeated rows get equal results; other columns are ignored; an empty table gives an empty result.
    """
    model = train(documents, labels, train_rows, bits)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2 ** bits weights

    def score(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [verdict(data or b"", shared.value, reject_at, bits) for data in as_bytes(batch.column(1))]
            cols = list(zip(*out, strict=True)) if out else [[] for _ in range(8)]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_low"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_low double")


def keep(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, reject_at: float = REJECT_AT, bits: int = BITS) -> DataFrame:
    """The document rows that `judge` keeps, as they are."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, labels, train_rows, bits))
    at = documents.columns.index("text")

    def good(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([verdict(data or b"", shared.value, reject_at, bits)[6] for data in as_bytes(batch.column(at))], pa.bool_()))

    return documents.mapInArrow(good, documents.schema)
