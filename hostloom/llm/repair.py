"""Conversation repair: cheapest edits that restore the order of roles, by a dynamic programme with stored checkpoints."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.llm.common import discard, settle

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Conversations of more rows or characters are cut into pieces; the pieces of PIECE rows are solved apart from each other.
ROWS, CHARS, PIECE = 1 << 14, 1 << 24, 1 << 16

# States: nothing yet, after a system turn, after a user turn, after an assistant turn. Only the first and the last may end.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The state after a user or assistant turn is put in, and its role: only one of the two fits each state.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = ("", "", "user", "assistant")
#: The state after a row is kept, by initial and state; -1 where it doesn't fit.
_KEPT = {"s": (_SYSTEM, -1, -1, -1), "u": (_USER, _USER, -1, _USER), "a": (-1, -1, _ASSISTANT, -1)}
_OTHER = (-1, -1, -1, -1)
_FAR = 1 << 60

# A row's code: its initial (0 none of the three, 1 s, 2 u, 3 a), plus 4 if it must go, plus 8 if it is truncated.
_INITIALS = ("", "s", "u", "a")
_GO, _CUT = 4, 8


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32(conv_id:turn) % 20 names; nulls in role, text and in the key are one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(key.cast("binary")) % 20).alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def faulty(rows: DataFrame) -> DataFrame:
    """Rows with `blank`, `cut` (the last character that isn't white space ends no sentence) and `initial`."""
    bare = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    return rows.select("*", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"), F.substring("role", 1, 1).alias("initial"))


# --- one stretch of rows ------------------------------------------------------------------------


def _relax(v: list[int]) -> list[int]:
    """Costs once turns may be put in before what follows. Two are enough: a third would come back to a state."""
    for _ in range(2):
        v = [min(v[q], INSERT + v[_NEXT[q]]) for q in range(4)]
    return v


#: Costs behind the last row.
END = _relax([0, _FAR, _FAR, 0])


def _back(code: int, v: list[int]) -> list[int]:
    """Costs before a row from the costs behind it."""
    if code & _GO:
        return _relax([DELETE + x for x in v])
    kept, extra = _KEPT.get(_INITIALS[code & 3], _OTHER), TRUNCATED if code & _CUT else 0
    out = []
    for q in range(4):
        best = min(DELETE + v[q], REROLE + extra + v[_NEXT[q]])
        out.append(min(best, KEEP + extra + v[kept[q]]) if kept[q] >= 0 else best)
    return _relax(out)


def costs(codes: bytes, behind: list[int]) -> list[int]:
    """Costs before the first row of a stretch, from the costs behind its last."""
    for code in reversed(codes):
        behind = _back(code, behind)
    return behind


def walk(codes: bytes, behind: list[int], state: int, last: bool) -> tuple[str, int, list[tuple[str, str]]]:
    """The ASCII-least edits among the cheapest, the state they end in, and for each row or insertion its edit and new role.

    Cost vectors are stored at every root of n rows only; on the way forward each block's vectors are computed again from
    the next checkpoint, so about 2 sqrt(n) vectors are held. At each step the least letter is taken whose edit is tight:
    its cost and the cost behind it add up to the cost here. Each state fits one role, so letters decide all.
    """
    n = len(codes)
    size = max(1, math.isqrt(n))
    stored = {n: behind}
    for at in range(n - 1, -1, -1):
        behind = _back(codes[at], behind)
        if at % size == 0:
            stored[at] = behind
    edits: list[tuple[str, str]] = []
    for start in range(0, n, size):
        end = min(start + size, n)
        block = [stored[end]]
        for at in range(end - 1, start - 1, -1):
            block.append(_back(codes[at], block[-1]))
        block.reverse()
        for at in range(start, end):
            here, then, code = block[at - start], block[at - start + 1], codes[at]
            extra = TRUNCATED if code & _CUT else 0
            while True:
                cost, put = here[state], _NEXT[state]
                if DELETE + then[state] == cost:
                    edits.append(("D", ""))
                    break
                if INSERT + here[put] == cost:
                    edits.append(("I", _ROLE[put]))
                    state = put
                    continue
                kept = _OTHER if code & _GO else _KEPT.get(_INITIALS[code & 3], _OTHER)
                if kept[state] >= 0 and KEEP + extra + then[kept[state]] == cost:
                    edits.append(("K", ""))
                    state = kept[state]
                else:
                    edits.append(("R", _ROLE[put]))
                    state = put
                break
    while last and state not in (_START, _ASSISTANT):
        state = _NEXT[state]
        edits.append(("I", _ROLE[state]))
    return "".join(e for e, _ in edits), state, edits


def _lines(edits: list[tuple[str, str]], rows: list[tuple[str, str]]) -> Iterator[str]:
    """The repaired rows as role:text."""
    at = iter(rows)
    for edit, role in edits:
        own, text = ("", "") if edit == "I" else next(at)
        if edit != "D":
            yield f"{role or own}:{text}"


# --- conversations that fit a task --------------------------------------------------------------

_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_OUT = f"conv_id long, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string"
_NOTHING = hashlib.sha256(b"").hexdigest()


def _solve(rows: list[tuple]) -> tuple:
    """The counts, audit and hash of one conversation: rows (turn, role, text, blank, cut, initial) in order."""
    seen, codes = set(), bytearray()
    blank = duplicate = truncated = illegal = 0
    before = None
    for _, role, text, is_blank, is_cut, initial in rows:
        known = (role, text) in seen
        seen.add((role, text))
        cut = is_cut and not is_blank and not known
        blank, duplicate, truncated = blank + is_blank, duplicate + (known and not is_blank), truncated + cut
        codes.append(_code(initial, is_blank or known, cut))
        illegal += before is not None and before + initial not in ("su", "ua", "au")
        before = initial
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost = costs(bytes(codes), END)[_START]
    audit, _, edits = walk(bytes(codes), END, _START, True)
    repaired = "\n".join(_lines(edits, [(r[1], r[2]) for r in rows]))
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256(repaired.encode("utf-8", "surrogatepass")).hexdigest()


def _code(initial: str, go: bool, cut: bool) -> int:
    return (_INITIALS.index(initial) if initial in ("s", "u", "a") else 0) + _GO * bool(go) + _CUT * bool(cut)


def _by_conversation(batches) -> Iterator[pa.RecordBatch]:
    """Solve conversation after conversation of rows in order; one is held at a time."""
    now, rows, out = None, [], []

    def close() -> None:
        if rows:
            out.append((now, *_solve(rows)))

    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            for conv, *row in zip(*[c.to_pylist() for c in batch.slice(start, 1024).columns], strict=True):
                if conv != now:
                    close()
                    now, rows = conv, []
                rows.append(tuple(row))
        if out:
            yield _batch(out)
            out = []
    close()
    if out:
        yield _batch(out)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["conv_id", *_COUNTS, "audit", "repaired_sha256"])


# --- longer ones --------------------------------------------------------------------------------


def _apart(rows: DataFrame, n: int, piece: int) -> DataFrame:
    """The same columns for conversations of any length, in pieces of about `piece` rows; `conv_id` is their number here.

    Rows are ranged by conversation and place, equal ones counted first, so that a piece never grows with one turn. A
    piece's cost vector before it is linear (least sum) in the one behind it: each piece gives a 4 by 4 table, the tables
    of a conversation are folded from its end, and the folded vectors are the checkpoints from which every piece is
    walked by itself, once from each state that it may be entered in. The entries are then chained from the start.
    """
    order = ["conv_id", "turn", "role", "text"]
    counted = rows.groupBy(*order, "blank", "cut", "initial").agg(F.count("*").alias("n"))
    ranged = counted.repartitionByRange(max(1, -(-n // piece)), *order).sortWithinPartitions(*order)
    sig = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256), 1, 40))
    placed = settle(ranged.select(F.spark_partition_id().alias("piece"), F.monotonically_increasing_id().alias("at"), *order, "blank", "cut", "initial", "n", sig.alias("sig")))

    # The first of equal rows is the one that isn't a duplicate; only texts that occur at several places need the look-up.
    first = placed.groupBy("conv_id", "sig").agg(F.min("at").alias("first"), F.count("*").alias("places")).where("places > 1").drop("places")
    light = placed.select("conv_id", "piece", "at", "turn", "blank", "cut", "initial", "n", "sig")
    marked = light.join(first, ["conv_id", "sig"], "left")
    marked = settle(marked.select("conv_id", "piece", "at", "turn", "blank", "cut", "initial", "n", (F.col("at") > F.col("first")).alias("known")).fillna(False, ["known"]))

    fresh_cut = F.col("cut") & ~F.col("blank") & ~F.col("known")
    sums = marked.groupBy("conv_id").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("n") - F.when(F.col("known"), 0).otherwise(1)).otherwise(0)).alias("duplicate"),
        F.sum(fresh_cut.cast("long")).alias("truncated"),
        (F.max("turn") - F.min("turn") + 1).alias("span"),
    )
    turns = marked.where("turn IS NOT NULL").select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.count("*").alias("turns"))

    def coded(group: pd.DataFrame) -> tuple[bytes, pd.DataFrame]:
        group = group.sort_values("at")
        codes = bytearray()
        for initial, blank, cut, known, n in zip(group.initial, group.blank, group.cut, group.known, group.n, strict=True):
            codes.append(_code(initial, blank or known, cut and not blank and not known))
            codes += bytes([_code(initial, True, False)]) * (n - 1)
        return bytes(codes), group

    def tables(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        codes, group = coded(group)
        first, rest, copies = group.initial.tolist(), group.initial.tolist()[1:], group.n.tolist()
        wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, rest, strict=False)) + sum(n - 1 for n in copies)
        unit = [[0 if i == j else _FAR for i in range(4)] for j in range(4)]
        table = [x for column in unit for x in costs(codes, _relax(column))]
        return pd.DataFrame([(key[0], key[1], table, first[0], first[-1], wrong)], columns=["conv_id", "piece", "table", "first", "last", "illegal"])

    pieces = settle(marked.groupBy("conv_id", "piece").applyInPandas(tables, "conv_id long, piece int, table array<long>, first string, last string, illegal long"))

    def fold(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece", ascending=False)
        behind, out, after, wrong = END, [], None, 0
        for piece, table, first, last, illegal in zip(group.piece, group.table, group["first"], group["last"], group.illegal, strict=True):
            wrong += illegal + (after is not None and last + after not in ("su", "ua", "au"))
            out.append((key[0], piece, list(behind), after is None))
            behind, after = [min(table[4 * j + q] + behind[j] for j in range(4)) for q in range(4)], first
        return pd.DataFrame([(*r, behind[_START], wrong) for r in out], columns=["conv_id", "piece", "behind", "final", "cost", "illegal"])

    folded = settle(pieces.groupBy("conv_id").applyInPandas(fold, "conv_id long, piece int, behind array<long>, final boolean, cost long, illegal long"))

    def ways(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        codes, _ = coded(left)
        r = right.iloc[0]
        out = []
        for entry in range(4):
            audit, leave, _ = walk(codes, [int(x) for x in r.behind], entry, bool(r.final))
            out.append((r.conv_id, r.piece, entry, leave, audit))
        return pd.DataFrame(out, columns=["conv_id", "piece", "entry", "leave", "audit"])

    walked = settle(marked.groupBy("conv_id", "piece").cogroup(folded.groupBy("conv_id", "piece")).applyInPandas(ways, "conv_id long, piece int, entry int, leave int, audit string"))

    def chain(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        leave = {(p, e): x for p, e, x in zip(group.piece, group.entry, group.leave, strict=True)}
        state, out = _START, []
        for piece in sorted(set(group.piece)):
            out.append((key[0], piece, state))
            state = leave[(piece, state)]
        return pd.DataFrame(out, columns=["conv_id", "piece", "entry"])

    entries = walked.select("conv_id", "piece", "entry", "leave").groupBy("conv_id").applyInPandas(chain, "conv_id long, piece int, entry int")
    chosen = settle(walked.join(entries, ["conv_id", "piece", "entry"]).select("conv_id", "piece", "entry", "audit"))

    # A text is hashed from its start to its end: one task reads a conversation's rows in order and holds an Arrow batch of them.
    texts = placed.select("conv_id", "piece", "at", "role", "text", "n", F.lit(None).cast("int").alias("entry"), F.lit(None).cast("string").alias("audit"))
    plans = chosen.select("conv_id", "piece", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("n"), "entry", "audit")
    stream = texts.unionByName(plans).repartition("conv_id").sortWithinPartitions("conv_id", "piece", "at")
    hashed = stream.mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    audits = chosen.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda p: p["audit"]), "").alias("audit"))
    heads = folded.groupBy("conv_id").agg(F.first("cost").alias("cost"), F.first("illegal").alias("illegal"))
    out = sums
    for other in (turns, heads, audits, hashed):
        out = out.join(other, "conv_id", "left")
    out = settle(out.select("conv_id", F.coalesce(F.col("span") - F.col("turns"), F.lit(0)).alias("gaps"), *_COUNTS[1:], "audit", "repaired_sha256"))
    discard(placed, marked, pieces, folded, walked, chosen)
    return out


def _hashed(batches) -> Iterator[pa.RecordBatch]:
    """(conv_id, hash of the repaired text), fed row by row; each piece starts with the row that holds its edits."""
    start = object()
    now, digest, edits, state, empty = start, None, iter(()), _START, True
    out: list[tuple] = []

    def feed(role: str, text: str) -> None:
        nonlocal empty
        digest.update(("" if empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        empty = False

    def take(role: str, text: str, n: int) -> None:
        """Use up the edits of n equal rows, and what is put in before each."""
        nonlocal state
        while n:
            edit = next(edits)
            if edit == "I":
                state = _NEXT[state]
                feed(_ROLE[state], "")
                continue
            n -= 1
            if edit == "K":
                state = _KEPT[role[:1]][state]
                feed(role, text)
            elif edit == "R":
                state = _NEXT[state]
                feed(_ROLE[state], text)

    def rest() -> None:
        nonlocal state
        for _ in edits:  # only turns put in behind the last row are left
            state = _NEXT[state]
            feed(_ROLE[state], "")

    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            for conv, _, at, role, text, n, entry, audit in zip(*[c.to_pylist() for c in batch.slice(k, 1024).columns], strict=True):
                if now is start or conv != now:
                    if now is not start:
                        rest()
                        out.append((now, digest.hexdigest()))
                    now, digest, edits, empty = conv, hashlib.sha256(), iter(()), True
                if at < 0:
                    rest()
                    edits, state = iter(audit), entry
                else:
                    take(role, text, n)
    if now is not start:
        rest()
        out.append((now, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string())], ["conv_id", "repaired_sha256"])


def repair(conversations: DataFrame, damaged: DataFrame, rows: int = ROWS, chars: int = CHARS, piece: int = PIECE) -> DataFrame:
    """One row per conv_id of `conversations`: what is wrong with its rows in `damaged`, and the cheapest repair of them.

    Rows are taken by turn, nulls first; rows of one turn by role and text, so equal rows are neighbours. A row's first
    fault counts (blank, duplicate, truncated). The audit holds the initials of the cheapest edits whose roles read
    (s?(ua)+)?, the ASCII-least where several cost the same; `repaired_sha256` is of the repaired role:text lines. An empty
    role has no initial, so it can't be kept. Null ids are one conversation. Conversations without rows have zeros, an empty
    audit and the hash of nothing; empty tables give none. Other columns are left out.

    Conversations of up to `rows` rows and `chars` characters are solved in one task each, one at a time; longer ones in
    pieces, with the same results. All texts are shuffled once.
    """
    ready = faulty(damaged.select("conv_id", "turn", "role", "text"))
    sizes = ready.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text") + F.length("role")).alias("chars"))
    long = settle(sizes.where((F.col("n") > rows) | (F.col("chars") > chars)).select("conv_id", "n", F.monotonically_increasing_id().alias("no")))
    n = long.agg(F.count("*"), F.sum("n")).first()
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    columns = ["turn", "role", "text", "blank", "cut", "initial"]
    parts = []
    if n[0]:
        match = ready.conv_id.eqNullSafe(long.conv_id)
        apart = _apart(ready.join(long, match).select(long.no.alias("conv_id"), *columns), n[1], piece)
        parts.append(apart.withColumnRenamed("conv_id", "no").join(long, "no").select("conv_id", *_COUNTS, "audit", "repaired_sha256"))
        ready = ready.join(long.select("conv_id"), match, "left_anti")
    whole = ready.select("conv_id", *columns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    solved = whole.mapInArrow(_by_conversation, _OUT)
    for part in parts:
        solved = solved.unionByName(part)
    found = ids.join(solved.withColumnRenamed("conv_id", "own"), F.col("conv_id").eqNullSafe(F.col("own")), "left")
    return found.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(_NOTHING)).alias("repaired_sha256"))
