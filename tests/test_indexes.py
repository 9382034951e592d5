"""The literal index of block-list regexes, the deletion index of brand names, and digests of lists that are never held."""

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hostloom.operators import ingest, merge, score


def test_required_literals_are_in_every_match():
    cases = {
        r"^addon-1.*@example\.org$": "@example.org", r"^evil@a\.com$": "evil@a.com", r"colou?r@x\.org": "r@x.org", r"a(bcdef)?ghijk": "ghijk", r"abcd|efgh": None, r"(?i)abcdef": None, r"[abc]{3}longer+tail": "longer",
        r"x{2,}yyyyy": "yyyyy", r"\d+-suffix": "-suffix", r"\Qa.b\E": None, r"": None, r"ab*cdef": "cdef", r"(abcd|efgh)ij": "ij", r"[]abc]wxyz": "wxyz",
    }
    got = score.required_literal.func(pd.Series(list(cases)))
    assert dict(zip(cases, got.literal, strict=True)) == cases and got.valid.all()
    assert score.required_literal.func(pd.Series(["(", None])).valid.tolist() == [False, False]
    rng = np.random.default_rng(5)
    pieces = ["abc", "@x", r"\.", "[ab]", "(q|r)", "z?", "y*", "w+", ".", "k{2}"]
    for _ in range(300):
        p = "".join(rng.choice(pieces, 5))
        literal = score.required_literal.func(pd.Series([p])).literal[0]
        for t in ["".join(rng.choice(["abc", "@x", ".", "a", "q", "z", "y", "w", "kk", "ww"], 8)) for _ in range(60)]:
            m = re.search(p, t)
            assert not m or literal is None or literal in m[0]


def test_ten_thousand_regexes_meet_only_ids_with_their_literal(spark):
    n = 10_000
    patterns = spark.range(n).select(F.concat(F.lit("/^add"), "id", F.lit("on-.*@example\\.org$/")).alias("guid"), F.concat(F.lit("^add"), "id", F.lit("on-.*@example\\.org$")).alias("pattern"))
    ids = spark.range(0, 3 * n, 30).select(F.concat(F.lit("add"), "id", F.lit("on-x@example.org")).alias("extension_id"))
    found = score.matching_patterns(ids, patterns)
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted((f"add{i}on-x@example.org", f"/^add{i}on-.*@example\\.org$/") for i in range(0, n, 30))
    odd = spark.createDataFrame([("/(/", "("), ("/^.$/", "^.$"), ("/a|addon/", "a|addon"), ("/nowhere-at-all/", "nowhere-at-all")], "guid string, pattern string")
    few = spark.createDataFrame([("a",), ("addon",), ("zz",)], "extension_id string")
    assert sorted(tuple(r) for r in score.matching_patterns(few, odd).collect()) == [("a", "/^.$/"), ("a", "/a|addon/"), ("addon", "/a|addon/")]


def test_the_first_entry_that_blocks_counts(spark):
    ranges = lambda *p: [{"minVersion": a, "maxVersion": b} for a, b in p]
    listed = spark.createDataFrame(
        [("x@a.org", "exact", ranges(("1", "2"))), ("/^x@a/", "first regex", ranges(("5", "6"))), ("/a.org$/", "second regex", []), ("open@b.org", "open", ranges((None, "3"), ("*", "0"))), ("/bad(/", "never", [])],
        "guid string, why string, ranges array<struct<minVersion:string,maxVersion:string>>",
    )
    ids = [("x@a.org", ["1.5"]), ("x@a.org ", ["5.1"]), ("x@a.org", ["9"]), ("open@b.org", ["0.1"]), ("open@b.org", ["4"]), ("y@a.org", []), (None, ["1"]), (" ", None)]
    got = [[r.why for r in score.match_blocklist(spark.createDataFrame([i], "extension_id string, versions array<string>"), listed).collect()] for i in ids]
    assert got == [["exact"], ["first regex"], ["second regex"], ["open"], [], ["second regex"], [], []]


def test_brand_names_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    looks = list(dict.fromkeys(b.replace("0", "o").replace("1", "l").replace("rn", "m") for b in score.BRANDS))

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return a == b
        if len(a) == len(b):
            off = [k for k in range(len(a)) if a[k] != b[k]]
            return len(off) == 1 or len(off) == 2 and off[1] == off[0] + 1 and a[off[0]] == b[off[1]] and a[off[1]] == b[off[0]]
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    names = set()
    for b in looks:
        for _ in range(12):
            w = list(b)
            for _ in range(int(rng.integers(0, 3))):
                k = int(rng.integers(0, len(w)))
                w[k : k + 1] = [[], [w[k], "q"], ["z"], w[k : k + 2][::-1]][int(rng.integers(0, 4))]
            names.add("".join(w) + ["", "", "x", "ex", "pro", "s"][int(rng.integers(0, 6))])
    names = sorted(n for n in names if n)
    want = {}
    for n in names:
        for b in looks:
            if near(n, b):
                want[n] = ("typosquat-brand", b)
            elif n.startswith(b) and n[len(b) :] in ("x", "ex"):
                want[n] = ("brand-affix", b)
            if n in want:
                break
    hits = score._brand_hits(spark.createDataFrame([(n,) for n in names], "_c string"), score.BRANDS)
    got = {r["_c"]: (r["_hit"].code, next(b for b in looks if f"'{b}'" in r["_hit"].detail)) for r in hits.collect()}
    assert got == want and len(want) > 100
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_label_hashes_are_fed_in_order(spark):
    rows = [(1, 5), (1, 30), (1, 5), (1, 4), (2, None), (2, 7), (None, 1), (3, None)] + [(9, i) for i in range(25_000)]
    got = {r.label_id: r.hash for r in merge.label_member_hash(spark.createDataFrame(rows, "label_id long, host_id long").repartition(7)).collect()}
    text = {1: "[4,5,5,30]", 2: "[7]", None: "[1]", 9: "[" + ",".join(map(str, range(25_000))) + "]"}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in text.items()}
    assert merge.label_member_hash(spark.createDataFrame([], "label_id long, host_id long")).count() == 0


def test_case_variants_keep_every_version_once(spark):
    rows = [("Slack", "S", ["1", "2"], ["apps"]), ("slack", "T", ["2", None], None), ("SLACK", None, [], ["programs", "apps"]), ("zoom", None, None, None)]
    edges = spark.createDataFrame([("Slack", 1, "1", "2001-01-01", "2001-01-02")], "name string, host_id long, version string, first_seen string, last_seen string")
    merged, _ = ingest.merge_case_variants(spark.createDataFrame(rows, "name string, display_name string, versions array<string>, sources array<string>"), edges)
    assert sorted(map(tuple, merged.select("name", "display_name", F.array_join("versions", "|").alias("v"), F.array_join("sources", "|").alias("s")).collect())) == [("slack", "S", "1|2", "apps|programs"), ("zoom", None, "", "")]


def test_scores_read_settled_installs(spark):
    """The installs' edges are derived once: no plan of the scores goes back to the line items."""
    from hostloom.plans import queries_score
    from hostloom.plans.inventory import inventory

    read = queries_score.scored(inventory(spark, "/root/testdata/sf0.001")).inputFiles()
    assert read and not [f for f in read if "lineitem" in f]
