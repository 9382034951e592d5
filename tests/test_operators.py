"""Operators on small fixtures with known results."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from hostloom.functions import values
from hostloom.operators import categorize, detect, graph, ingest, merge, runs, scope, score, snapshot
from hostloom.plans.inventory import Inventory
from hostloom.sources import readers
from hostloom.streaming import inventory_stream


def one(spark, c, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()], F.lit(1).alias("_")).select(c.alias("x")).first().x


def test_version_orders(spark):
    order = ["", "0.9", "1.0rc1", "1.0", "1.0.0", "1.9", "1.10", "1.10.a", "12345678901234567890.1", "beta"]
    df = spark.createDataFrame([(v,) for v in reversed(order)], "v string")
    assert [r.v for r in df.orderBy(values.version_sort_key(F.col("v"))).collect()] == order
    compare = lambda a, b: one(spark, values.compare_versions(F.lit(a), F.lit(b)))
    assert [compare(a, b) for a, b in (("1.10", "1.9"), ("1.0", "1.0.0"), ("1.2.9", "1.2.*"), ("2.0a1", "2.0b1"), ("2.0b1", "2.0"), ("x", "0.x"))] == [1, 0, -1, -1, -1, -1]


def test_typed_ids_and_words(spark):
    df = spark.createDataFrame([(x,) for x in ("host_12", "host_x", "software_a_b", "user_", "team_1", None)], "v string")
    kind, key = values.split_typed_id(F.col("v"))
    assert [(r.kind, r.key) for r in df.select(kind.alias("kind"), key.alias("key")).collect()] == [("host", "12"), (None, None), ("software", "a_b"), (None, None), (None, None), (None, None)]
    words = spark.createDataFrame([("my mega app",), ("omega",), ("mega-x",), (None,), ("sync.com",), ("syncxcom",)], "v string")
    assert [r.x for r in words.select(values.word_match(F.col("v"), ("mega", "sync.com")).alias("x")).collect()] == [True, False, True, False, True, False]


def test_removal_support(spark):
    df = spark.createDataFrame([("Chrome", "a" * 32, "darwin"), ("firefox", "x@y.z", "ubuntu"), ("firefox", "@", "windows"), ("safari", "a.b.c", "darwin"), ("edge", "q" * 32, "ios"), ("edge", "a" * 32, "windows"), (None, None, None)], "s string, i string, p string")
    os = values.script_os(F.col("p"))
    got = [tuple(r) for r in df.select(values.removal_supported(F.col("s"), F.col("i")).alias("a"), os.alias("o"), values.can_block(os, F.col("s")).alias("b")).collect()]
    assert got == [(True, "darwin", False), (True, "linux", True), (False, "windows", False), (False, "darwin", False), (False, "none", False), (True, "windows", True), (False, "none", False)]


def test_block_list(spark):
    listed = readers.blocklist(spark.createDataFrame([("/^((evil@a\\.com)|(\\{0000-bad\\}))$/", "w", None), ("old@b.com", None, [("0", "1.2.*")]), ("old@b.com", None, [("2.0b1", "2.0")]), ("all@c.com", "", [("0", "*")])], "guid string, why string, versionRange array<struct<minVersion:string,maxVersion:string>>"))
    cases = {("evil@a.com", ()): True, ("evil@a.comx", ()): False, ("all@c.com", ("99.1",)): True, ("nobody@d.com", ("1",)): False}
    cases |= {("old@b.com", v): True for v in (("1.1",), ("1.2.9",), ("2.0b3",), ("3.0", "1.0"), ())} | {("old@b.com", (v,)): False for v in ("1.10", "2.0a1", "3.0")}
    for (i, v), blocked in cases.items():
        ext = spark.createDataFrame([(i, list(v))], "extension_id string, versions array<string>")
        assert bool(score.match_blocklist(ext, listed).collect()) == blocked, (i, v)


def listing(spark, **given):
    names = {"permissions": "array<string>", "optional_permissions": "array<string>", "host_permissions": "array<string>", "content_script_matches": "array<string>", "privacy_codes": "array<bigint>", "content_security_policy": "string", "status": "string", "reputable": "boolean", "users": "bigint", "rating": "double", "rating_count": "bigint", "developer_verified": "boolean", "established_publisher": "boolean", "featured": "boolean", "manifest_version": "bigint", "updated_at": "string", "crx_hash_verified": "boolean"}
    df = spark.createDataFrame([tuple(given.get(k) for k in names)], ", ".join(f"{k} {v}" for k, v in names.items()))
    return df.withColumn("updated_at", F.col("updated_at").cast("timestamp"))


def test_capability_arithmetic(spark):
    points = lambda **k: score.capability(score.permission_sets(listing(spark, **k))).first().capability_score
    assert points(permissions=["cookies"]) == 9
    assert points(permissions=["cookies"], content_script_matches=["https://example.com/*"]) == 20
    assert points(permissions=["storage"], host_permissions=["https://a/*"], optional_permissions=["debugger"]) == 4
    assert points(permissions=["cookies"], host_permissions=["https://a/*"], optional_permissions=["debugger"]) == 29
    assert points(host_permissions=["https://a/*"], privacy_codes=[4, 3, 5, 6]) - points(host_permissions=["https://a/*"]) == 8
    assert points() == 0


def test_trust_arithmetic(spark):
    points = lambda **k: score.trust(listing(spark, **k), "2002-01-01").first().trust_score
    assert points(status="public", manifest_version=3, featured=True) == 38
    assert points(status="unlisted") == 5
    assert points(status="removed", users=999_999_999) == 12
    assert points() == 8


def test_weak_policies(spark):
    weak = lambda csp: one(spark, score.weak_csp(F.lit(csp)))
    assert weak("default-src 'self'; script-src 'self'") is None and weak(None) is None
    assert "unsafe-eval" in weak("default-src 'unsafe-eval'")
    assert weak("script-src 'self'; script-src 'unsafe-eval'") is None
    assert weak("script-src 'self' https://a.b *").endswith("https://a.b, *")


def test_names(spark):
    given = ["1Passw0rd", "G00gle", "adgaurd", "1Password", "Motion", "My Notes", "", None, "a/b.crx", "gооgle docs", "honeyx", "Q" * 90, "a.b.c.d.e"]
    df = spark.createDataFrame([(n, n, False) for n in given] + [("Motion", "Motion", True)], "name string, display_name string, vouched boolean")
    got = {(r.name, r.vouched): (r.name_penalty, [s.code for s in r.name_signals]) for r in score.name_anomalies(df).collect()}
    assert {got[n, False][1][0] for n in ("1Passw0rd", "G00gle", "adgaurd", "Motion")} == {"typosquat-brand"}
    assert got["1Password", False] == got["My Notes", False] == (0, [])
    assert got["Motion", False][0] == 18 and got["Motion", True] == (0, ["brand-lookalike-vouched"])
    assert got["", False] == got[None, False] == (12, ["missing-name"])
    assert got["a/b.crx", False][0] == 12 and got["gооgle docs", False][0] == 20 and got["honeyx", False][0] == 18 and got["Q" * 90, False][0] == 6 and got["a.b.c.d.e", False][0] == 4


def test_install_paths(spark):
    i = "a" * 32
    rows = [("ok", f"C:\\Users\\x\\AppData\\Local\\Google\\Chrome\\User Data\\Default\\Extensions\\{i}", "windows"), ("ok", None, "chrome"), ("root", f"C:\\tmp\\{i}", "windows"), ("dots", f"/Library/Google/Chrome/../x/{i}", "darwin"), ("none", None, "darwin"), ("only", None, "chrome")]
    df = spark.createDataFrame([(k, "chrome", i, p, o) for k, p, o in rows], "key string, store string, extension_id string, path string, platform string")
    assert {r.key: r.verified for r in score.store_install_verified(df).collect()} == {"ok": True, "root": False, "dots": False, "none": False, "only": False}


def test_feeds_publishers_whitelist(spark, tmp_path):
    (tmp_path / "feed.csv").write_text("﻿id,why\n" + "\n".join(f"{c * 32},{w}" for c, w in (("a", "Adware"), ("a", "Malware"), ("b", "Adware"), ("c", "Policy Violation"))) + "\nnot-an-id,Malware\n", encoding="utf-8")
    feed = readers.read_threat_feed(spark, str(tmp_path / "feed.csv"), "f", columns={"reason": "why"})
    assert {(r.id[0], r.reason) for r in feed.collect()} == {("a", "Malware"), ("b", "Adware"), ("c", "Policy Violation")}
    ext = spark.createDataFrame([("vivaldi", "A" * 32), ("firefox", "b" * 32), ("chrome", "c" * 32)], "store string, extension_id string")
    hits = {r.extension_id[0]: (r.hits[0].severity, r.hits[0].threat) for r in score.match_feeds(ext, feed).collect()}
    assert hits == {"A": ("malicious", 100), "c": ("listed", 45)}
    entries = [{"name": "Good", "added_at": "2024-01-01", "apple_team_ids": ["ABCDE12345"], "amo_author_ids": [7]}, {"name": "NoDate", "apple_team_ids": ["ABCDE12345"]}, {"name": "Lower", "added_at": "2024-01-01", "apple_team_ids": ["abcde12345"]}]
    (tmp_path / "p.json").write_text(json.dumps(entries))
    assert {(r.name, r.kind, r.id) for r in readers.read_publishers(spark, str(tmp_path / "p.json")).collect()} == {("Good", "safari", "ABCDE12345"), ("Good", "firefox", "7")}
    (tmp_path / "w.json").write_text('[" Slack ", "slack", "", "Zoom"]')
    assert {r.entry for r in readers.read_whitelist(spark, str(tmp_path / "w.json")).collect()} == {"slack", "zoom"}


def test_host_documents(spark, tmp_path):
    docs = [
        {"id": 1, "computer_name": " ", "display_name": "Box", "users": ["bob", '{"username":"","email":"a@b"}'], "primary_user": "bob", "software": [
            {"name": "Slack", "version": "1", "source": "apps", "installed_paths": ["/Applications/W.app"], "bundle_identifier": "site.w", "signature_information": [{"installed_path": "/Applications/W.app", "team_identifier": "TEAM1"}]},
            {"name": "SLACK ", "version": "2", "source": "apps"}, {"name": "", "source": "apps"},
            {"name": "Wipr Extra", "source": "safari_extensions", "display_name": "Wipr Extra", "installed_paths": ["/Applications/W.app/Contents/PlugIns/X.appex"]},
            {"name": "com.1password.safari/1password.appex@2BUA8C4S2C", "source": "safari_extensions"}, {"name": "E", "source": "chrome_extensions", "installed_paths": ["/x/" + "a" * 32 + "/1"]}]},
        {"id": 2}, {"computer_name": "lost"}, {"id": 3, "hostname": "h", "users": []},
    ]
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, docs)) + "\nnot json\n")
    df = readers.read_host_documents(spark, str(tmp_path / "d.json"))
    assert {r.id: r.hostname for r in df.collect()} == {1: "Box", 2: "host-2", 3: "h"}
    users = {r.host_id: r.users for r in ingest.host_user_identifiers(df).collect()}
    assert users == {1: ["bob", "a@b"], 2: None, 3: []}
    rows = {r["name"]: r for r in ingest.explode_software(df).collect()}
    assert rows["slack"].version == "1" and set(rows) == {"slack", "wipr extra", "com.1password.safari/1password.appex@2bua8c4s2c", "e"}
    assert rows["wipr extra"].extension_key == "ext:safari:site.w/x.appex@team1" and rows["wipr extra"].display_name == "W › Wipr Extra"
    assert "@" not in rows["com.1password.safari/1password.appex@2bua8c4s2c"].extension_key
    assert rows["e"].extension_key == "ext:chrome:" + "a" * 32


def test_builtins_and_vulnerabilities(spark):
    b = lambda s, i, p: one(spark, ingest.is_builtin(F.lit(s), F.lit(i), F.array(F.lit(p))))
    assert b("chrome", None, "C:\\Program Files\\Google\\Chrome\\Application\\120.0\\resources\\x") and not b("chrome", None, "C:\\Users\\a\\Desktop\\Google\\Chrome\\Application\\x")
    assert not b("firefox", None, "/tmp/browser/features/a.xpi") and b("firefox", "x@Mozilla.org", "") and b("edge", "mhjfbmdgcfjbbpaeojofohoefgiehjai", "")
    v = spark.createDataFrame([([(None, "C1", 8.8, None, None, None), ("C2", None, None, 5.1, None, None)],), (None,)], "v array<struct<cve:string,cve_id:string,cvss_score:double,cvss:double,cvss_v3_score:double,epss_probability:double>>")
    assert [(r.s.vulnerability_count, r.s.max_cvss) for r in v.select(ingest.summarize_vulnerabilities(F.col("v")).alias("s")).collect()] == [(2, 8.8), (0, None)]


def fleet(spark):
    hosts = spark.createDataFrame([(i, f"h{i}", "darwin", 1, "t", None) for i in range(1, 9)], "host_id long, hostname string, platform string, team_id long, team_name string, last_seen timestamp")
    uses = spark.createDataFrame([("u1", 1), ("u1", 2), ("u2", 2), ("u2", 3), ("root", 1), ("root", 8), ("u3", 4)], "username string, host_id long")
    inst = spark.createDataFrame([("a", 1), ("b", 3), ("b", 4), ("c", 4), ("c", 5), ("c", 6)], "name string, host_id long").withColumns({"version": F.lit("1"), "source": F.lit("apps"), "extension_key": F.lit(None).cast("string"), "first_seen": F.lit("2001-01-01").cast("timestamp"), "last_seen": F.lit("2001-01-01").cast("timestamp")})
    soft = spark.createDataFrame([(n, n, ["apps"], ["x"]) for n in "abcd"], "name string, display_name string, sources array<string>, category array<string>")
    labels = spark.createDataFrame([(1, "L1"), (2, "L2")], "label_id long, name string")
    marked = spark.createDataFrame([(1, 1, "L1"), (1, 2, "L2"), (2, 1, "L1")], "host_id long, label_id long, label string")
    return Inventory(hosts, uses.select("username", F.col("username").alias("email")).distinct(), soft, labels, uses, inst, marked)


def test_blast_radius(spark):
    inv = fleet(spark)
    got = {r.seed: tuple(r)[1:] for r in graph.blast_radius(inv, "software", spark.createDataFrame([("a",), ("zzz",)], "seed string")).collect()}
    assert got == {"a": (1, 1, 1, 1, 1), "zzz": (0, 0, 0, 0, 0)}
    assert graph.blast_radius(inv, "user", spark.createDataFrame([("u1",)], "seed string")).first()[1:] == (2, 1, 1, 1, 1)


def test_shortest_paths_against_a_plain_search(spark):
    inv = fleet(spark)
    edges = graph.links(inv)
    near = {}
    for r in edges.collect():
        near.setdefault(r.src, set()).add(r.dst)
        near.setdefault(r.dst, set()).add(r.src)
    nodes = sorted(near)
    pairs = list(itertools.product(nodes, nodes))[::3]

    def search(a, b):
        paths = [[a]]
        for _ in range(7):
            done = [p for p in paths if p[-1] == b]
            if done:
                return min(done)
            paths = [[*p, n] for p in paths for n in near[p[-1]] if n not in p]
        return []

    got = {(r.a, r.b): r.nodes for r in graph.shortest_paths(spark.createDataFrame(pairs, "a string, b string"), edges).collect()}
    assert got == {p: search(*p) for p in pairs}
    assert all(not v or all(y in near[x] for x, y in itertools.pairwise(v)) for v in got.values())
    nodes_of, kept = graph.ego_network(spark.createDataFrame([("host_1",)], "seed string"), edges, 2, 3)
    assert [r.hop for r in nodes_of.orderBy("hop", "node").collect()] == [0, 1, 1] and nodes_of.first().truncated and kept.count() == 2


def test_scopes(spark):
    inv = fleet(spark)
    ids = lambda df: sorted(r.host_id for r in df.collect())
    assert ids(scope.host_scope(inv, labels=["L1", "L2"])) == [1] and ids(scope.host_scope(inv, labels=["L1", "L2"], op="or")) == [1, 2] and len(ids(scope.host_scope(inv, team="all"))) == 8
    assert ids(scope.composite_scope(inv, '{"op": "NOT", "args": [{"label": "L1"}]}')) == [3, 4, 5, 6, 7, 8]
    for bad in ("x", "[]", '{"op": "XOR", "args": [{"team": "1"}]}', '{"op": "NOT", "args": []}', '{"team": 1}', '{"what": "x"}', '{"op":"NOT","args":[' * 7 + '{"team":"1"}' + "]}" * 7):
        with pytest.raises(ValueError):
            scope.composite_scope(inv, bad)


def test_merges_are_idempotent_and_leave_no_dangling_edges(spark):
    inv = fleet(spark)
    columns = ["name", "host_id", "version", "source", "extension_key", "first_seen", "last_seen"]
    batch = inv.installed_on.where("host_id = 4 AND name = 'c'").withColumn("version", F.lit("2"))
    once = merge.upsert_installed_on(inv.installed_on, batch, batch.select("host_id"), "2002-01-01")
    twice = merge.upsert_installed_on(once, batch, batch.select("host_id"), "2002-01-01")
    assert sorted(map(repr, once.collect())) == sorted(map(repr, twice.collect()))
    assert {(r.name, r.version) for r in once.where("host_id = 4").collect()} == {("c", "2")} and once.columns == columns
    tables = {"hosts": inv.hosts, "users": inv.users, "software": inv.software, "labels": inv.labels, "uses": inv.uses, "installed_on": inv.installed_on, "has_label": inv.has_label}
    left = merge.reap_unattached(tables)
    assert {r.name for r in left["software"].collect()} == set("abc") and {r.label_id for r in left["labels"].collect()} == {1, 2} and 7 not in {r.host_id for r in left["hosts"].collect()}
    gone = merge.reap_stale_hosts(tables | {"hosts": inv.hosts.withColumn("last_ingest", F.when(F.col("host_id") == 4, F.lit("2000-01-01")).otherwise(F.lit("2002-01-01")).cast("timestamp"))}, "2001-01-01")
    assert gone["installed_on"].join(gone["hosts"], "host_id", "left_anti").count() == 0 and gone["hosts"].count() == 7
    assert merge.next_watermark("2002-01-01 00:00:00", 0, None) == "2001-12-31 23:55:00" and merge.next_watermark("2002-01-01 00:00:00", 1, "x") == "x"


def test_snapshots(spark, tmp_path):
    inv = fleet(spark)
    for ts in ("2001-01-01 00:00:00", "2001-02-01 00:00:00"):
        snapshot.write_snapshot(inv, ts, str(tmp_path))
    a, b = snapshot.read_snapshot(spark, str(tmp_path), "2001-01-01 00:00:00"), snapshot.read_snapshot(spark, str(tmp_path), "2001-02-01 00:00:00")
    assert a[0].count() == b[0].count() > 0
    for diff in (snapshot.diff_nodes(a[0], b[0]), snapshot.diff_properties(a[0], b[0]), snapshot.diff_edges(a[1], b[1])):
        assert diff.count() == 0
    noisy = inv.hosts.withColumn("last_seen", F.lit("2001-05-05").cast("timestamp"))
    renamed = noisy.withColumn("hostname", F.when(F.col("host_id") == 2, "new").otherwise(F.col("hostname")))
    c = snapshot.snapshot_nodes(Inventory(**(inv.__dict__ | {"hosts": renamed})), "x")
    assert [tuple(r) for r in snapshot.diff_properties(a[0], c).collect()] == [("host", "host_2", "hostname", "h2", "new")]
    snapshot.export(spark.createDataFrame([("x", ["a", "b"])], "n string, affected_users array<string>"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().user_count == "2"


def test_categories(spark):
    titles = ["Slack 4.2.1", "Zoom (64-bit)", "7-Zip 23.01 (x64 edition)", "Foo release 2.0", "git"]
    df = spark.createDataFrame([(t,) for t in titles], "name string")
    assert [r.x for r in df.select(categorize.normalize_title(F.col("name")).alias("x")).collect()] == ["slack", "zoom", "7-zip", "foo", "git"]
    texts = spark.createDataFrame([("A tool by J. Doe vs. Mr. X. Next one.",), ("no end",), (None,), ("x" * 400,)], "t string")
    assert [r.s and r.s[:40] for r in texts.select(categorize.first_sentence("t").alias("s")).collect()] == ["A tool by J. Doe vs. Mr. X. Next one.", "no end", None, "x" * 40]
    assert one(spark, categorize.infer_categories(F.lit("A password manager with a VPN"))) == ["Security Tool", "Password Manager", "Privacy Tool", "VPN"]


def test_predicates(spark):
    cases = {("libfoo", "apps"): True, ("app helper", "apps"): True, ("slack", "npm_packages"): True, ("slack", "deb_packages"): True, ("slack", "apps"): False, ("!!!", "apps"): True, ("", "npm_packages"): False, ("python 3.11.2 docs", "programs"): True}
    df = spark.createDataFrame([(n, [s]) for n, s in cases], "n string, s array<string>")
    assert [r.x for r in df.select(detect.is_system_package(F.col("n"), F.array().cast("array<string>"), F.col("s")).alias("x")).collect()] == list(cases.values())


def test_runs(spark):
    rows = [("k", 1, "a", "2001-01-01", 0, "FH_RESULT=error\n FH_RESULT=removed \nFH_REMOVED=3"), ("k", 1, "b", "2001-01-02", None, ""), ("k", 2, "a", "2001-01-01", -2, "x"), ("k", 3, "a", "2001-01-01", 5, "FH_RESULT=removed"), ("k", 4, "a", "2001-01-01", 0, None)]
    df = spark.createDataFrame(rows, "extension_key string, host_id long, execution_id string, requested_at string, exit_code long, output string")
    got = {(r.host_id, r.execution_id): (r.outcome, r.removed) for r in runs.parse_run_output(df).collect()}
    assert got == {(1, "a"): ("removed", 3), (1, "b"): ("queued", 0), (2, "a"): ("failed", 0), (3, "a"): ("failed", 0), (4, "a"): ("failed", 0)}
    assert {r.host_id: (r.execution_id, r.pending) for r in runs.latest_runs(df).collect()}[1] == ("b", 1)


def test_a_stream_comes_to_what_the_batch_does(spark, tmp_path):
    rows = [(i % 5, f"h{i}", "p", f"2001-01-0{1 + i % 3} 00:0{i % 10}:00") for i in range(40)]
    df = spark.createDataFrame(rows, "host_id long, hostname string, platform string, t string").select("host_id", "hostname", "platform", F.col("t").cast("timestamp").alias("updated_at"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    raw = stream.writeStream.foreachBatch(inventory_stream.merge_newest(str(tmp_path / "state"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    raw.awaitTermination()
    assert sorted(map(repr, inventory_stream.host_state(spark, str(tmp_path / "state")).collect())) == sorted(map(repr, inventory_stream.newest(df).collect()))
    q = inventory_stream.stream_host_state(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "s2"), str(tmp_path / "c2"))
    q.awaitTermination()
    state = inventory_stream.host_state(spark, str(tmp_path / "s2"))
    assert state.count() == 5 and inventory_stream.stale_hosts(state, "2001-02-01").count() == 5
    assert inventory_stream.host_state(spark, str(tmp_path / "nothing")).count() == 0


def test_titles_lose_every_suffix(spark):
    cases = {"Tool 1.2.3": "tool", "Tool" + " (a)" * 9 + " x64 (b) 64-bit": "tool", "Tool (x) Release 7 (y)": "tool", "": "", None: None, "a (b) c": "a (b) c", "(x)": ""}
    df = spark.createDataFrame([(n,) for n in cases], "n string")
    assert {r.n: r.t for r in df.select("n", categorize.normalize_title(F.col("n")).alias("t")).collect()} == cases


def test_lists_of_detections_are_bounded_and_counts_are_not(spark):
    inv = fleet(spark)
    wide = spark.range(100, 130).select(F.col("id").alias("host_id"), F.format_string("w%03d", "id").alias("hostname"), F.lit("p").alias("platform"))
    software = spark.createDataFrame([("teamviewer", "teamviewer", ["apps"], ["Tool"])], "name string, display_name string, sources array<string>, category array<string>")
    installed = wide.select(F.lit("teamviewer").alias("name"), "host_id", F.lit("1").alias("version"))
    uses = wide.select(F.concat(F.lit("u"), "hostname").alias("username"), "host_id")
    big = Inventory(**(inv.__dict__ | {"hosts": wide, "software": software, "installed_on": installed, "uses": uses}))
    row = detect.detections(big, wide, kind="high_risk", limit=5).collect()
    assert [(r.software_name, r.host_count, r.affected_hosts, r.affected_users) for r in row] == [("teamviewer", 30, [f"w{i}" for i in range(100, 105)], [f"uw{i}" for i in range(100, 105)])]
    on, of = detect.affected(big, detect.findings(big, wide, kinds=("high_risk",)), wide)
    assert on.count() == 30 and of.count() == 30
    assert detect.detections(big, wide, kind="outlier").count() == 0 and detect.detections(big, wide, kind="version_sprawl").count() == 0


def test_stream_state_rewrites_touched_buckets_only_and_takes_late_rows(spark, tmp_path):
    path = str(tmp_path / "state")
    make = lambda *rows: spark.createDataFrame(rows, "host_id long, hostname string, t string").select("host_id", "hostname", F.lit("p").alias("platform"), F.col("t").cast("timestamp").alias("updated_at"))
    step = inventory_stream.merge_newest(path, 8)
    step(make(*[(i, "first", "2001-01-02") for i in range(100)]), 0)
    for batch in range(1, 5):
        step(make((7, f"new{batch}", f"2001-01-0{2 + batch}"), (7, "old", "2000-01-01"), (1000, "late", "1999-01-01")), batch)
    step(make((7, "new4", "2001-01-06")), 4)  # runs again
    state = {r.host_id: r.hostname for r in inventory_stream.host_state(spark, path).collect()}
    assert state == {i: "first" for i in range(100)} | {7: "new4", 1000: "late"}
    held = inventory_stream._bucket_folders(spark, path)
    assert len(held) == 8 and all(len(v) <= 2 for v in held.values()) and sum(v == [0] for v in held.values()) >= 6
    step(make(), 5)
    assert {r.host_id: r.hostname for r in inventory_stream.host_state(spark, path).collect()} == state


def test_display_names_and_greatest_versions(spark):
    hosts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "host_id long, hostname string")
    assert {r.host_id: r.display_name for r in ingest.display_names(hosts).collect()} == {1: "a #1", 2: "a #2", 3: "b", 4: None, 5: None}
    df = spark.createDataFrame([("x", "9.0"), ("x", "10.0"), ("x", None), ("y", None)], "name string, version string")
    assert {r.name: r.v for r in df.groupBy("name").agg(values.greatest_version().alias("v")).collect()} == {"x": "10.0", "y": None}
