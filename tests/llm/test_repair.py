"""Conversation repair against a search over all edits, and conversations in pieces against whole ones."""

import hashlib
import heapq
import math
import re
import zlib

import numpy as np
import pytest

from hostloom.llm import queries, repair
from hostloom.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, audit string, piece int, n string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        if kind:
            out += [(conv, turn, role, text)] * (1 + (kind == 3))
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def plain(rows):
    """One conversation's result by a search over (row, role initials' state) in order of cost, then of audit."""
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done, best = [(0, "", 0, "", ())], set(), None
    while heap:
        cost, audit, k, last, lines = heapq.heappop(heap)
        if (k, last) in done:
            continue
        done.add((k, last))
        if k == len(rows) and last in ("", "a"):
            best = cost, audit, lines
            break
        if k < len(rows):
            _, _, role, text = rows[k]
            heapq.heappush(heap, (cost + 4, audit + "D", k + 1, last, lines))
            if faults[k] not in ("blank", "duplicate"):
                extra = 3 * (faults[k] == "truncated")
                if role[:1] and role[:1] in legal[last]:
                    heapq.heappush(heap, (cost + extra, audit + "K", k + 1, role[:1], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if new[0] in legal[last]:
                        heapq.heappush(heap, (cost + extra + 3, audit + "R", k + 1, new[0], (*lines, f"{new}:{text}")))
        for new in ("user", "assistant"):
            if new[0] in legal[last]:
                heapq.heappush(heap, (cost + 3, audit + "I", k, new[0], (*lines, f"{new}:")))
    turns = {r[1] for r in rows if r[1] is not None}
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:], strict=False)]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest()


def expected(rows):
    by = {}
    for r in damaged(rows):
        by.setdefault(r[0], []).append(r)
    return {c: plain(by.get(c, [])) for c in {r[0] for r in rows}}


def found(df):
    out = df.collect()
    assert len({r.conv_id for r in out}) == len(out)
    return {r.conv_id: tuple(r)[1:] for r in out}


def made(seed, conversations=60, longest=14):
    rng = np.random.default_rng(seed)
    texts = ["Yes.", "No!", "Why?", "no end", " \t\n", "", "tail.  \n", None, "é.", "x" * 400]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for c in range(conversations):
        n = int(rng.integers(1, longest))
        for t in range(n):
            neat = rng.random() < 0.6
            role = ("user", "assistant")[t % 2] if neat else roles[int(rng.integers(0, len(roles)))]
            text = f"text {c} {t}." if neat else texts[int(rng.integers(0, len(texts)))]
            rows.append((c if c else None, None if rng.random() < 0.05 else int(t + 3 * (rng.random() < 0.1)), role, text))
    return rows + rows[: len(rows) // 9]


def run(spark, data, **sizes):
    df = spark.createDataFrame([(*r, "clash", 1, "z") for r in data], SCHEMA).repartition(3)
    return found(repair.repair(df, repair.damage(df), **sizes))


@pytest.mark.parametrize("seed", range(2))
def test_against_a_search(spark, seed):
    rows = made(seed)
    assert run(spark, rows) == expected(rows)


def test_long_conversations_in_pieces(spark):
    rows = made(7, 4, 5) + [(c, t, r, x) for c, t, r, x in made(9, 2, 120) if c != 0] + [(50, t // 3, ("user", "assistant", "system")[t % 3 if t % 7 else 0], f"t{t % 40}" + "." * (t % 5 > 0)) for t in range(150)]
    rows += [(51, 5, "user", "Again.")] * 40 + [(51, 6, "assistant", "Fine.")] + [(None, None, "assistant", None)] * 9
    want = expected(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, rows=3, piece=7) == want


def test_one_text_longer_than_a_task_takes(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], ("w " * 3000) + f"{t}.") for t in range(12)] + [(2, 1, "user", "Hi.")]
    assert run(spark, rows, chars=5000, piece=4) == expected(rows) == run(spark, rows)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repair.repair(df, repair.damage(df)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_checkpoints_give_what_one_table_gives():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 8, 9, 10, 100, 1000):
        codes = bytes(rng.choice([0, 1, 2, 3, 4, 6, 9, 10, 11], n).tolist())
        audit, state, edits = repair.walk(codes, repair.END, 0, True)
        price = {"D": 4, "I": 3, "R": 3, "K": 0}
        at, total = 0, 0
        for e in audit:
            total += price[e]
            if e != "I":
                total += 3 * (e != "D" and bool(codes[at] & 8))
                at += 1
        assert at == n and total == repair.costs(codes, repair.END)[0] and state in (0, 3)
        for cut in {0, n // 3, n // 2, n}:
            first = repair.walk(codes[:cut], repair.costs(codes[cut:], repair.END), 0, False)
            assert first[0] + repair.walk(codes[cut:], repair.END, first[1], True)[0] == audit
        assert math.isqrt(max(1, n)) >= 1


def test_the_query(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op11_conversation_repair(spark, SF)) == expected(rows)
