"""Language identification: multinomial naive Bayes over hashed character n-grams, scored in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.llm.common import as_bytes, rolling

BITS, SIZES = 14, (1, 2, 3)
#: Languages of one broadcast matrix, of LANGS * 2 ** BITS numbers; more languages are scored one matrix after the other.
LANGS = 256


def held_out(doc_id: Column) -> Column:
    """Documents that training must not see: crc32 of the id as text, mod 4, is 2. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def gram_cells(text: str, bits: int = BITS) -> np.ndarray:
    """Cells of the text's lower-cased character n-grams; characters that are no letters count as one break."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters(points)
    points = np.where(letter, points, 32).astype(np.uint64)
    points = points[letter | np.append(True, letter[:-1])]
    return np.concatenate([(rolling(points, n, 30 + n) >> np.uint64(64 - bits)).astype(np.int32) for n in SIZES])


def _letters(points: np.ndarray) -> np.ndarray:
    """Which code points are letters; looked up once for each different one."""
    kinds, at = np.unique(points, return_inverse=True)
    return np.array([chr(c).isalpha() for c in kinds.tolist()], dtype=bool)[at] if len(kinds) else np.zeros(0, dtype=bool)


def counts(documents: DataFrame, bits: int = BITS) -> DataFrame:
    """(lang, cell, n) over all documents that training may see; texts without a letter teach nothing."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for data, lang in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                sums.setdefault(lang, np.zeros(1 << bits, dtype=np.int64))
                text = data.decode("utf-8", "replace")
                if any(c.isalpha() for c in text):
                    sums[lang] += np.bincount(gram_cells(text, bits), minlength=1 << bits)
            if len(sums) > 32:
                yield from _rows(sums)
                sums = {}
        yield from _rows(sums)

    seen = documents.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang")
    return seen.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def _rows(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "cell", "n"])


def train(documents: DataFrame, bits: int = BITS, langs: int = LANGS) -> Iterator[tuple[list[str], np.ndarray]]:
    """Languages in order and their log probabilities, `langs` languages at a time: one column of 2 ** bits cells for
    each, smoothed by one half."""
    by_lang = counts(documents, bits).groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))
    names, lines = [], []
    for row in by_lang.orderBy("lang").toLocalIterator():  # at most 2 ** bits cells for each language
        line = np.zeros(1 << bits)
        cells = np.array(row.cells, dtype=np.int64).reshape(-1, 2)
        line[cells[:, 0]] = cells[:, 1]
        names.append(row.lang)
        lines.append(np.log((line + 0.5) / (line.sum() + 0.5 * len(line))).astype(np.float32))
        if len(names) == langs:
            yield names, np.stack(lines, axis=1)
            names, lines = [], []
    if names:
        yield names, np.stack(lines, axis=1)


def identify(documents: DataFrame, bits: int = BITS, langs: int = LANGS) -> DataFrame:
    """One row per document row: doc_id, held_out, lang_pred, score.

    Trained on every document with a text and a language that is not held out; predictions use the text alone.
    `und` with score 0: null texts, texts without a letter, and all texts if nothing can be learned. The score is the
    winner's posterior under equal priors at the mean log probability of an n-gram times the root of their number, so
    that long texts don't all reach 1. Equal scores: the first language in order. Very long texts are scored whole.
    Any number of languages: each matrix of `langs` of them is scored in a pass of its own, which carries on the best so far.
    """
    sc = documents.sparkSession.sparkContext
    none = [F.lit(None).cast(t).alias(c) for t, c in (("string", "best"), ("double", "most"), ("double", "rest"))]
    rows = documents.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text", *none)
    schema = "doc_id long, held_out boolean, text string, best string, most double, rest double"
    for names, matrix in train(documents, bits, langs):
        rows = rows.mapInArrow(_scorer(sc.broadcast((names, matrix)), bits), schema)
    score = F.coalesce(1 / F.col("rest"), F.lit(0.0))
    return rows.select("doc_id", "held_out", F.coalesce("best", F.lit("und")).alias("lang_pred"), score.alias("score"))


def _scorer(shared, bits: int):
    """A pass over rows that carries on the best language, its log probability, and the sum over all languages so far of
    what the score compares with it."""

    def score(batches) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value
        for batch in batches:
            out = []
            before = zip(*[batch.column(k).to_pylist() for k in (3, 4, 5)], strict=True)
            for data, (best, most, rest) in zip(as_bytes(batch.column(2)), before, strict=True):
                text = data.decode("utf-8", "replace") if data else ""
                cells = gram_cells(text, bits) if any(c.isalpha() for c in text) else ()
                if len(cells):
                    n = np.bincount(cells, minlength=1 << bits)
                    at = np.flatnonzero(n)
                    total, root = n[at].astype(np.float64) @ table[at], np.sqrt(len(cells))
                    top = int(total.argmax())
                    if best is None or total[top] > most:
                        rest = 0.0 if best is None else rest * np.exp((most - total[top]) / root)
                        best, most = langs[top], float(total[top])
                    rest = float(rest + np.exp((total - most) / root).sum())
                out.append((best, most, rest))
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            kinds = (pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "held_out", "text", "best", "most", "rest"])

    return score
