"""Personal data: fixed patterns, and weakly supervised spans (labelers vote, EM weighs them, a classifier decides)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.llm.common import apart_from, as_bytes, discard, settle
from hostloom.llm.quality import fit_logistic

KINDS = ("email", "ip", "card", "phone", "other")
LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(rb"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser spans that the labelers judge: number groups, and addresses that are spelled out or lack a dot.
NUMBERS = re.compile(rb"(?<![0-9A-Za-z+])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,17}(?![0-9A-Za-z])")
SPELLED = re.compile(rb"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}(?:\x20?[(\[]\x20?at\x20?[)\]]\x20?|\x20at\x20)[A-Za-z0-9-]{2,63}(?:\x20?[(\[]\x20?dot\x20?[)\]]\x20?|\x20dot\x20)[A-Za-z]{2,10}(?![A-Za-z])")
BRACKETED = re.compile(rb"[(\[]\x20?at\x20?[)\]].*[(\[]\x20?dot\x20?[)\]]")
#: Gazetteer of words that name personal data, and words that name other numbers.
NAMES = frozenset("phone tel telephone telefon mobile cell call fax handy telefono telefone portable mail email correo contact contacto kontakt card visa mastercard carte tarjeta karte ssn social passport pasaporte iban konto account cuenta compte address adresse direccion dob".split())
OTHERS = frozenset("page pages isbn issn version item order ref part no nr number invoice total price eur usd year vol volume line table figure id".split())
STRICT = re.compile(rb"^(?:\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})$")
DATE = re.compile(rb"^(?:[0-9]{4}[.-][0-9]{1,2}[.-][0-9]{1,2}|[0-9]{1,2}[.-][0-9]{1,2}[.-][0-9]{2,4})$")
LABELERS, BITS = 6, 12
#: Candidate spans that the classifier is fitted on, in expectation; posterior from which on it adds a span.
TRAIN_SPANS, ADD_AT = 20_000, 0.95


def luhn(digits: bytes) -> bool:
    d = [c - 48 for c in digits]
    return (sum(d[-1::-2]) + sum(x * 2 - 9 * (x > 4) for x in d[-2::-2])) % 10 == 0


def _at_most_255(digits: bytes) -> bool:
    """Digits without leading zeros; long ones aren't read as a number."""
    return len(digits) < 3 or len(digits) == 3 and digits <= b"255"


def emails(data: bytes) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @: linear in the text."""
    last, at = 0, data.find(b"@")
    while at >= 0:
        start = at
        while start > last and data[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(data, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = data.find(b"@", max(at + 1, last))


def base_spans(data: bytes, digits: bool) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes, in order of start, then kind."""
    found = [(s, e, 0) for s, e in emails(data)] if b"@" in data else []
    if digits:
        found += [(m.start(), m.end(), 1) for m in IP.finditer(data) if all(_at_most_255(g.lstrip(b"0")) for g in m.groups())]
        for m in CARD.finditer(data):
            if 14 <= len(d := re.sub(rb"[^0-9]", b"", m[0])) <= 19 and luhn(d):
                found.append((m.start(), m.end(), 2))
        if b"+" in data:
            found += [(m.start(), m.end(), 3) for m in PHONE.finditer(data) if 10 <= sum(48 <= c < 58 for c in m[0]) <= 15]
    return sorted(found, key=lambda x: (x[0], x[2]))


def votes(data: bytes, s: int, e: int, base: int) -> tuple[int, ...]:
    """Of each labeler: 1 personal, -1 not, 0 no opinion. Regex, checksum, gazetteer, context, date shape, sameness.
    Checksum and sameness judge numbers only, not addresses with digits in them."""
    span = data[s:e]
    number = not re.search(rb"[A-Za-z]", span)
    d = re.sub(rb"[^0-9]", b"", span) if number else b""
    around = [w.decode("ascii", "ignore").lower() for w in re.findall(rb"[A-Za-z]+", data[max(0, s - 40) : s])[-5:]]
    return (
        1 if base >= 0 or STRICT.match(span) or BRACKETED.search(span) else 0,
        0 if len(d) < 13 else 1 if luhn(d) else -1,
        1 if NAMES & set(around) else 0,
        -1 if OTHERS & set(around) or data[max(0, s - 1) : s] in (b"$", b"#", b".", b"/", b"=", b"-") or data[e : e + 1] in (b"%", b"/", b"=") else 0,
        -1 if DATE.match(span) else 0,
        -1 if d and len(set(d)) <= 2 else 0,
    )


def candidates(data: bytes, digits: bool, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, tuple[int, ...]]]:
    """(start, end, base kind or -1, votes): the base spans and looser ones that overlap none of them."""
    for s, e, k in base:
        yield s, e, k, votes(data, s, e, k)
    loose = [m.span() for m in NUMBERS.finditer(data)] if digits else []
    if b"dot" in data:
        loose += [m.span() for m in SPELLED.finditer(data)]
    clear = apart_from(base)
    for s, e in loose:
        if clear(s, e):
            yield s, e, -1, votes(data, s, e, -1)


def features(data: bytes, s: int, e: int) -> list[int]:
    """Cells of the span's shape (3-grams of 9 for digits, a for letters) and of the words around it."""
    shape = re.sub(rb"[A-Za-z]", b"a", re.sub(rb"[0-9]", b"9", data[s:e][:64]))
    told = [b"s" + shape[i : i + 3] for i in range(max(1, len(shape) - 2))] + [b"n%d" % min(24, len(re.sub(rb"[^0-9]", b"", data[s:e])))]
    told += [b"w" + w.lower() for w in re.findall(rb"[A-Za-z]+", data[max(0, s - 40) : s])[-3:]] + [b"b" + data[max(0, s - 1) : s], b"e" + data[e : e + 1]]
    return sorted({zlib.crc32(t) & ((1 << BITS) - 1) for t in told})


def reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = 100) -> dict[tuple[int, ...], float]:
    """EM over vote patterns: the labelers' reliabilities in either class, then each pattern's posterior."""
    v = np.array(list(patterns))
    n = np.array(list(patterns.values()), dtype=float)
    score = v.sum(axis=1)
    post = np.where(score > 0, 0.9, np.where(score < 0, 0.1, 0.5))
    for _ in range(rounds):
        prior = np.clip((n * post).sum() / n.sum(), 0.01, 0.99)
        log_odds = np.full(len(n), np.log(prior / (1 - prior)))
        for j in range(v.shape[1]):
            for x in (-1, 0, 1):
                # smoothed towards the vote's own sense, which keeps the classes from changing places
                yes = ((n * post)[v[:, j] == x].sum() + 1 + (x > 0)) / ((n * post).sum() + 4)
                no = ((n * (1 - post))[v[:, j] == x].sum() + 1 + (x < 0)) / ((n * (1 - post)).sum() + 4)
                log_odds += np.where(v[:, j] == x, np.log(yes / no), 0)
        post = 1 / (1 + np.exp(-log_odds))
    return {p: float(q) for p, q in zip(patterns, post, strict=True)}


def _has_digit(data: bytes) -> bool:
    buf = np.frombuffer(data, dtype=np.uint8)
    return bool(((buf >= 48) & (buf < 58)).any())


def train(documents: DataFrame, train_spans: int = TRAIN_SPANS) -> np.ndarray | None:
    """Weights of the span classifier, fitted to the posteriors of a bounded sample of spans; None without spans."""

    def vote(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in as_bytes(batch.column(0)):
                digits = _has_digit(data)
                for s, e, _, v in candidates(data, digits, base_spans(data, digits)):
                    rows.append((",".join(map(str, v)), features(data, s, e), zlib.crc32(data[max(0, s - 40) : e + 8])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.int64())], ["votes", "at", "place"])

    seen = settle(documents.where(F.col("text").isNotNull()).select("text").mapInArrow(vote, "votes string, at array<int>, place long"))
    patterns = {tuple(map(int, r[0].split(","))): r[1] for r in seen.groupBy("votes").agg(F.count("*")).collect()}  # at most 3 ** LABELERS
    if not patterns:
        return None
    post = reliabilities(patterns)
    share = int(min(1.0, train_spans / sum(patterns.values())) * (1 << 32))
    # equal spans in equal places hash alike: one of them, weighed by the root of their number, so copies can't flood it
    sample = seen.where(F.col("place") < share).groupBy("place", "votes", "at").agg(F.count("*").alias("n")).collect()
    discard(seen)
    sample.sort(key=lambda r: (r.place, r.votes, r.at))
    y = np.array([post[tuple(map(int, r.votes.split(",")))] for r in sample])
    if not len(y) or not (y > 0.5).any() or not (y <= 0.5).any():
        return None
    return fit_logistic([(np.array(r.at, np.int64), np.ones(len(r.at))) for r in sample], y, 1 << BITS, n=np.sqrt([r.n for r in sample]))


def find(documents: DataFrame, train_spans: int = TRAIN_SPANS, add_at: float = ADD_AT) -> DataFrame:
    """One row per document row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_other.

    Base spans come from fixed patterns, leftmost and non-overlapping per kind. Looser candidates (number groups,
    spelled-out addresses) that overlap no base span are judged: labelers vote, EM over all vote patterns of the corpus
    estimates what each vote is worth, and a logistic classifier of shape and context, fitted to those posteriors,
    adds `other` spans from `add_at` on. Votes reach the classifier by way of EM only: no labeler has a veto, and a span
    that none voted for can be found. Offsets are code points, end exclusive. Null counts as empty; without spans of
    both kinds nothing is added.
    """
    weights = train(documents, train_spans)

    def spans(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in as_bytes(batch.column(1)):
                data = data or b""
                digits = _has_digit(data)
                base, more = base_spans(data, digits), []
                if weights is not None:
                    for s, e, k, _ in candidates(data, digits, base):
                        if k < 0 and 1 / (1 + np.exp(-(weights[features(data, s, e)].sum() + weights[-1]))) >= add_at:
                            more.append((s, e, 4))
                every = sorted(base + more, key=lambda x: (x[0], x[2]))
                if every:
                    point = np.append(0, np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80))
                    name = lambda x: f"{KINDS[x[2]]}:{point[x[0]]}:{point[x[1]]}"  # noqa: B023, E731
                rows.append((*[sum(b[2] == k for b in base) for k in range(4)], ",".join(map(name, base)) if base else "", ",".join(map(name, every)) if every else "", len(more)))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans", "n_other"])

    found = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(spans, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_other long")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_other")
