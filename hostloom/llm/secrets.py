"""Secret scan: fixed patterns, and a battery of randomness tests under false-discovery control.

Each token passes three tests, chi-squared uniformity, runs and serial correlation, twice: under "random" (symbols drawn
evenly from the token's encoding), which it must not fail, and under "written language", whose p-values are combined and
enter the false-discovery control. What written language looks like is counted on the corpus: letter pairs outside
all tokens that are tested.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.llm.common import apart_from, as_bytes

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24, "random": 20}
#: Share of false discoveries; least combined p of the tests; alphabets by what a token is written in.
FDR, LEAST_P = 0.01, 1e-3
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "UPPER": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Sum of squared and of cubed letter frequencies of ordinary words, for the null hypothesis "written language".
WORDS_P2, WORDS_P3 = 0.066, 0.0056
#: In written tokens: most neighbours of different kinds (case, digit, sign) where cases are mixed and where not, and the
#: least changes between vowels and consonants.
MIXED_CHANGES, PLAIN_CHANGES, VOWEL_CHANGES = 0.33, 0.15, 0.55
#: Bits by which a letter pair may surprise at most; factor on its spread, since words of other languages surprise more.
MOST_BITS, SPREAD = 10.0, 1.3
BINS, LENGTHS = 80, (24, 32, 48, 64)
#: Letter pairs that ordinary prose has.
USUAL_PAIRS = 400
#: Letters by falling frequency in European languages: what is known of pairs before any are counted.
LETTERS = "etaoinsrhldcumfpgwybvkxjqz"


def _lut(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


_HEX, _TOKEN = _lut(b"0123456789abcdef"), _lut(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")


def _kinds() -> np.ndarray:
    """Of each byte: 0 lower case, 1 upper case, 2 digit, 3 other."""
    kind = np.full(256, 3, dtype=np.int8)
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    return kind


_KIND = _kinds()
_LETTER = np.full(256, 26, dtype=np.int64)  # a letter's number in either case; 26: none
_LETTER[97:123] = _LETTER[65:91] = np.arange(26)
_VOWEL = np.isin(np.arange(27), [ord(c) - 97 for c in "aeiouy"])


def runs_of(buf: np.ndarray, lut: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of `least` or more bytes of a set."""
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = lut[buf]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def base_spans(data: bytes, buf: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes, in order of start, then kind."""
    found = []
    if b"=" in data or b":" in data:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(data) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in data:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(data) if len(m[0]) >= LEAST["access"]]
    found += [(s, e, 2) for s, e in runs_of(buf, _HEX, LEAST["hex"])]
    return sorted(found, key=lambda x: (x[0], x[2]))


def encoding(token: str) -> str | None:
    """The narrowest alphabet that holds the token; None for digits alone, which are numbers."""
    if token.isdigit():
        return None
    return next((name for name, chars in ALPHABETS.items() if not set(token) - set(chars)), None)


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def letter_pairs(buf: np.ndarray) -> np.ndarray:
    """27 x 27 counts of neighbouring letters in a text, tokens that are tested left out; 26 is what is no letter."""
    letter = _LETTER[buf]
    for s, e in runs_of(buf, _TOKEN, LEAST["random"]):
        letter[s:e] = 26
    return np.bincount(letter[:-1] * 27 + letter[1:], minlength=27 * 27) if len(buf) > 1 else np.zeros(27 * 27, dtype=np.int64)


def surprise(pairs: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(bits by which each of 26 x 26 letter pairs surprises, their mean and standard deviation in written language)."""
    share = np.zeros(26)
    share[[ord(c) - 97 for c in LETTERS]] = 1 / (np.arange(26) + 3.0)
    share /= share.sum()
    seen = pairs.reshape(27, 27)[:26, :26].astype(np.float64)
    known = min(1.0, (seen > 0).sum() / USUAL_PAIRS)  # a corpus with few different pairs says little about the others
    seen = known * seen / max(1.0, seen.sum()) + (1 - known + 0.01) * np.outer(share, share)
    after = seen / seen.sum(axis=1, keepdims=True)
    bits = np.minimum(-np.log2(after), MOST_BITS)
    weight = seen / seen.sum()
    mean = float((weight * bits).sum())
    return bits, mean, float(np.sqrt((weight * (bits - mean) ** 2).sum()))


def random_p(at: np.ndarray, k: int) -> float:
    """Fisher's combination of three tests of symbols drawn evenly from k: chi-squared, runs above and below the middle,
    serial correlation."""
    n, df = len(at), k - 1
    chi = float((np.bincount(at, minlength=k) ** 2).sum() * k / n - n)
    p_chi = _tail(((max(chi, 1e-9) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = at >= k / 2
    n1, n2 = int(high.sum()), int((~high).sum())
    if n1 and n2:
        mean = 2 * n1 * n2 / n + 1
        var = (mean - 1) * (mean - 2) / max(1, n - 1)
        p_runs = 2 * _tail(abs(int((high[1:] != high[:-1]).sum()) + 1 - mean) / math.sqrt(max(var, 1e-9)))
    else:
        p_runs = 2.0 ** (1 - n)
    spread = at - at.mean()
    square = float((spread**2).sum())
    p_serial = 2 * _tail(abs(float((spread[1:] * spread[:-1]).sum()) / square * math.sqrt(n))) if square else 0.0
    half = -sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    return math.exp(-half) * (1 + half + half * half / 2)  # chi-squared with 6 degrees of freedom


def written_p(token: str, alphabet: str, language: tuple[np.ndarray, float, float]) -> float:
    """The chance that written language of this length looks as random, by the same three tests turned to that side.

    Uniformity: letters of either case count as one symbol, and their squared frequencies sum to about WORDS_P2 (more in a
    narrow alphabet). Runs: changes between cases, digits and signs, in letters of one case between vowels and consonants.
    Serial correlation: bits by which letter pairs surprise one who knows the corpus. Written tokens that stand
    out by one test tend to by another, so Fisher's sum is scaled as for correlations of 0.3 (Brown): 4 degrees of freedom.
    """
    n, k = len(token), len(alphabet)
    share = Counter(c.lower() for c in alphabet)
    folded = sum(c * c * k / share[x] for x, c in Counter(token.lower()).items()) / n - n
    wide = k / max(share.values())
    p2 = max(WORDS_P2, 2.2 / wide)
    p3 = max(WORDS_P3 * (p2 / WORDS_P2) ** 1.5, p2 * p2 * 1.05)
    p_even = _tail((n * (wide * p2 - 1) + wide * (1 - p2) - folded) / (2 * wide * math.sqrt(n * (p3 - p2 * p2) + (p2 - 2 * p3 + p2 * p2) / 2)))
    buf = np.frombuffer(token.encode(), dtype=np.uint8)
    kind, letter = _KIND[buf], _LETTER[buf]
    kinds = set(kind.tolist())
    if len(kinds) == 1:
        rate, changes = VOWEL_CHANGES, -int((_VOWEL[letter][1:] != _VOWEL[letter][:-1]).sum())  # random letters change less often
    else:
        rate, changes = MIXED_CHANGES if {0, 1} <= kinds else PLAIN_CHANGES, int((kind[1:] != kind[:-1]).sum())
    p_runs = _tail((changes - math.copysign(rate, changes) * (n - 1)) / math.sqrt((n - 1) * rate * (1 - rate)))
    bits, mean, sd = language
    both = (letter[1:] < 26) & (letter[:-1] < 26)
    pairs = int(both.sum())
    told = float(bits[letter[:-1][both], letter[1:][both]].sum()) if pairs else 0.0
    p_serial = _tail((told - pairs * mean) / (SPREAD * sd * math.sqrt(pairs))) if pairs else 1.0
    x = -2 * sum(math.log(max(p, 1e-300)) for p in (p_even, p_runs, p_serial)) / 1.5
    return max(math.exp(-x / 2) * (1 + x / 2), 10.0 ** (-(BINS - 1) / 4))


def battery(token: str, name: str, language: tuple[np.ndarray, float, float]) -> tuple[float, float]:
    """(p if random, p if written) of a token in the encoding of that name."""
    alphabet = ALPHABETS[name]
    return random_p(np.array([alphabet.index(c) for c in token]), len(alphabet)), written_p(token, alphabet, language)


def pieces(data: bytes, s: int, e: int) -> set[tuple[int, int]]:
    """The tokens that a run may hold: what lies between its =, whole and cut at / and +, at - and _, and at all four,
    so neither a name nor a path in front hides a token, whichever base it is written in."""
    cuts = (rb"[^=]+", rb"[^=/+]+", rb"[^=_-]+", rb"[^=/+_-]+")
    return {(s + m.start(), s + m.end()) for cut in cuts for m in re.finditer(cut, data[s:e]) if len(m[0]) >= LEAST["random"]}


def candidates(data: bytes, buf: np.ndarray, base: list[tuple[int, int, int]], language: tuple[np.ndarray, float, float]) -> Iterator[tuple[int, int, str, int]]:
    """(start, end, stratum, bin of the p-value, -1 where it doesn't pass as random) of tokens apart from the base
    spans. They may overlap: a run is tested whole and in its pieces."""
    clear = apart_from(base)
    for run in runs_of(buf, _TOKEN, LEAST["random"]):
        for s, e in sorted(pieces(data, *run)):
            if not clear(s, e):
                continue
            token = data[s:e].decode()
            name = encoding(token)
            if name:
                even, written = battery(token, name, language)
                yield s, e, f"{name}:{sum(len(token) >= x for x in LENGTHS)}", int(-4 * math.log10(written)) if even >= LEAST_P else -1


def apart(found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of tokens that don't overlap, out of (start, end, bin): the surest first, of equals the shortest."""
    out: list[tuple[int, int]] = []  # in order
    for s, e, _ in sorted(found, key=lambda x: (-x[2], x[1] - x[0], x[0])):
        k = bisect_left(out, (e, 0))  # the first that starts at the end or behind it
        if not k or out[k - 1][1] <= s:
            out.insert(k, (s, e))
    return out


def cutoffs(hist: list[tuple[str, int, int]], fdr: float = FDR) -> dict[str, int]:
    """Benjamini-Hochberg in each stratum (encoding and length), on p-value bins rounded up: the least bin to report."""
    out = {}
    for stratum in {h[0] for h in hist}:
        n = Counter()
        for s, b, c in hist:
            if s == stratum:
                n[b] += c
        total, above = sum(n.values()), 0
        for b in range(BINS, -1, -1):
            above += n[b]
            if n[b] and total * 10.0 ** (-b / 4) <= fdr * above:
                out[stratum] = b
    return out


def scan(documents: DataFrame, fdr: float = FDR) -> DataFrame:
    """One row per document row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Base spans come from fixed patterns, leftmost and non-overlapping per kind. The battery adds `random` spans: tokens
    of 20 or more characters (runs of letters, digits and + / _ -, whole and in the pieces between these) that overlap no
    base span, whose symbols pass chi-squared uniformity, runs and serial-correlation tests in the encoding they seem to
    be in, and that stand out against written language, by the three tests combined, at the false-discovery rate
    within all tokens of their encoding and length in the corpus. Offsets are code points, end exclusive. Null counts as
    empty; texts of any length are scanned whole; repeated rows get equal results.
    """
    texts = documents.where(F.col("text").isNotNull()).select("text")

    def pairs(batches) -> Iterator[pa.RecordBatch]:
        n = np.zeros(27 * 27, dtype=np.int64)
        for batch in batches:
            for data in as_bytes(batch.column(0)):
                n += letter_pairs(np.frombuffer(data, dtype=np.uint8))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["pair", "n"])

    seen = np.zeros(27 * 27, dtype=np.int64)
    for pair, n in texts.mapInArrow(pairs, "pair int, n long").groupBy("pair").agg(F.sum("n")).collect():  # 729 at most
        seen[pair] = n
    language = surprise(seen)

    def tally(batches) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for data in as_bytes(batch.column(0)):
                buf = np.frombuffer(data, dtype=np.uint8)
                n.update((c[2], c[3]) for c in candidates(data, buf, base_spans(data, buf), language))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.int32()), pa.array(list(n.values()), pa.int64())], ["stratum", "bin", "n"])

    hist = texts.mapInArrow(tally, "stratum string, bin int, n long").groupBy("stratum", "bin").agg(F.sum("n")).collect()  # at most encodings x lengths x bins
    least = cutoffs([tuple(r) for r in hist], fdr)

    def spans(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in as_bytes(batch.column(1)):
                data = data or b""
                buf = np.frombuffer(data, dtype=np.uint8)
                base = base_spans(data, buf)
                more = [(s, e, 3) for s, e in apart([(s, e, b) for s, e, stratum, b in candidates(data, buf, base, language) if b >= least.get(stratum, BINS + 1)])]
                every = sorted(base + more, key=lambda x: (x[0], x[2]))
                if every:
                    point = np.append(0, np.cumsum((buf & 0xC0) != 0x80))
                    name = lambda x: f"{KINDS[x[2]]}:{point[x[0]]}:{point[x[1]]}"  # noqa: B023, E731
                rows.append((*[sum(b[2] == k for b in base) for k in range(3)], ",".join(map(name, base)) if base else "", ",".join(map(name, every)) if every else "", len(more)))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(6)]
            kinds = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans", "n_random"])

    found = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(spans, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string, n_random long")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_random")
