"""Blast radius over hub accounts, budgets of ego networks, early ends and dealt hubs of path searches."""

from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostloom.operators import graph
from hostloom.plans.inventory import Inventory


def edge_frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string, kind string")


def plain_paths(edges, a, b, hops):
    near = {}
    for s, d, _ in edges:
        near.setdefault(s, set()).add(d)
        near.setdefault(d, set()).add(s)
    level = {a: [a]}
    seen = {a}
    for _ in range(hops + 1):
        if b in level:
            return level[b]
        new = {}
        for node, path in level.items():
            for n in near.get(node, ()):
                if n not in seen:
                    new[n] = min(new.get(n, [*path, n]), [*path, n])
        seen |= set(new)
        level = new
    return []


def test_paths_over_dealt_hubs(spark):
    rng = np.random.default_rng(3)
    edges = [(f"user_{int(rng.integers(0, 25))}", f"host_{int(rng.integers(0, 60))}", "USES") for _ in range(70)]
    edges += [("software_hub", f"host_{i}", "INSTALLED_ON") for i in range(0, 60, 2)] + [(f"software_{i}", f"host_{i}", "INSTALLED_ON") for i in range(60)]
    pairs = [(f"user_{i}", f"software_{j}") for i in range(0, 25, 5) for j in (1, 2, 33, 58)] + [("host_0", "host_0"), ("host_1", "nowhere"), ("software_hub", "user_3")]
    frame = spark.createDataFrame(pairs, "a string, b string")
    for hops in (1, 3, 6):
        rows = graph.shortest_paths(frame, edge_frame(spark, edges), hops, block=4).collect()
        got = {(r.a, r.b): r.nodes for r in rows}
        assert len(rows) == len(pairs)
        want = {p: plain_paths(edges, *p, hops) for p in pairs}
        want[("host_1", "nowhere")] = []
        assert got == want


def test_the_search_ends_with_the_longest_path(spark, monkeypatch):
    edges = [("user_a", "host_1", "USES"), ("software_x", "host_1", "INSTALLED_ON"), ("user_far", "host_9", "USES")]
    frame = spark.createDataFrame([("user_a", "host_1"), ("user_a", "user_far")], "a string, b string")
    hops = []
    real = graph.neighbours
    monkeypatch.setattr(graph, "neighbours", lambda *a: hops.append(1) or real(*a))
    got = {(r.a, r.b): r.nodes for r in graph.shortest_paths(frame, edge_frame(spark, edges)).collect()}
    assert got == {("user_a", "host_1"): ["user_a", "host_1"], ("user_a", "user_far"): []}
    assert len(hops) <= 6  # two ends a hop; six hops would be twelve


def plain_ego(edges, seed, depth, cap):
    near = {}
    for s, d, _ in edges:
        near.setdefault(s, set()).add(d)
        near.setdefault(d, set()).add(s)
    hop, queue = {seed: 0}, deque([seed])
    while queue:
        node = queue.popleft()
        if hop[node] < depth:
            for n in near.get(node, ()):
                if n not in hop:
                    hop[n] = hop[node] + 1
                    queue.append(n)
    ranked = sorted(hop.items(), key=lambda e: (e[1], e[0]))
    return {n: h for n, h in ranked[:cap]}, len(ranked) > cap


def test_ego_networks_of_hubs_stay_within_their_budget(spark, monkeypatch):
    edges = [("software_all", f"host_{i:04d}", "INSTALLED_ON") for i in range(1500)] + [(f"user_{i % 40}", f"host_{i:04d}", "USES") for i in range(0, 1500, 3)] + [("software_solo", "host_0003", "INSTALLED_ON")]
    seeds = ["software_solo", "user_1", "host_0003", "software_all", "gone"]
    sizes = []
    real = graph.settle

    def counted(df):
        out = real(df)
        if out.columns == ["seed", "node", "hop"]:
            sizes.append(out.groupBy("seed").count().agg(F.max("count")).first()[0] or 0)
        return out

    monkeypatch.setattr(graph, "settle", counted)
    for depth, cap in ((1, 10), (2, 10), (3, 25), (3, 4)):
        nodes, links = graph.ego_network(spark.createDataFrame([(s,) for s in seeds], "seed string"), edge_frame(spark, edges), depth, cap)
        got = {}
        for r in nodes.collect():
            got.setdefault(r.seed, [{}, r.truncated])[0][r.node] = r.hop
        for s in seeds:
            want, more = plain_ego(edges, s, depth, cap)
            assert (got[s][0], got[s][1]) == (want, more)
        kept = {(r.seed, r.src, r.dst) for r in links.collect()}
        assert kept == {(s, a, b) for s in seeds for a, b, _ in edges if a in got[s][0] and b in got[s][0]}
        assert max(sizes) <= cap + 1
        sizes.clear()


def plain_blast(seed, edges, uses, hosts, scope):
    own = {h for s, h in edges if s == seed and h in scope}
    users = {u for u, h in uses if h in own and u not in (seed, "Root")}
    lateral = {h for u, h in uses if u in users and h in hosts} - own
    return len(own), len({hosts[h][0] for h in own} - {None}), len({hosts[h][1] for h in own} - {None}), len(users), len(lateral)


@pytest.mark.parametrize("hub", [1, 3, 1000])
def test_blast_radius_by_bitmaps_and_by_pairs(spark, hub):
    rng = np.random.default_rng(hub)
    hosts = {h: (("darwin", "windows", None)[h % 3], h % 5 or None) for h in range(80)}
    uses = [(f"u{int(rng.integers(0, 40))}", int(rng.integers(0, 90))) for _ in range(90)] + [("svc", h) for h in range(0, 90, 2)] + [("Root", h) for h in range(80)] + [("u1", 5), ("u1", 5), (None, 7)]
    installs = [(f"t{int(rng.integers(0, 30))}", int(rng.integers(0, 90))) for _ in range(70)] + [("t1", 5), ("t1", 5), ("rare", 1)]
    inv = Inventory(
        hosts=spark.createDataFrame([(h, *v) for h, v in hosts.items()], "host_id long, platform string, team_id long"), users=None, software=None, labels=None, has_label=None,
        uses=spark.createDataFrame(uses, "username string, host_id long"), installed_on=spark.createDataFrame(installs, "name string, host_id long"),
    )
    named = [(u, h) for u, h in uses if u is not None]
    for kind, edges, names in (("software", installs, [f"t{i}" for i in range(30)] + ["rare", "none"]), ("user", named, [f"u{i}" for i in range(40)] + ["svc"])):
        for scope in (set(hosts), {h for h in hosts if h % 4}):
            seeds = spark.createDataFrame([(n,) for n in names], "seed string")
            got = {r.seed: tuple(r)[1:] for r in graph.blast_radius(inv, kind, seeds, inv.hosts.where(F.col("host_id").isin(*scope)), hub=hub).collect()}
            assert got == {n: plain_blast(n, edges, named, hosts, scope) for n in names}


@pytest.mark.parametrize("hub, listed", [(3, 6), (1000, 12)])
def test_blast_radius_by_lists_and_by_pairs(spark, hub, listed):
    rng = np.random.default_rng(listed)
    hosts = {h: (("darwin", "windows", None)[h % 3], h % 5 or None) for h in range(60)}
    uses = [(f"u{int(rng.integers(0, 30))}", int(rng.integers(0, 70))) for _ in range(60)] + [("svc", h) for h in range(0, 70, 2)] + [("Root", h) for h in range(60)]
    installs = [(f"t{int(rng.integers(0, 25))}", int(rng.integers(0, 70))) for _ in range(40)] + [("every", h) for h in range(70)]
    inv = Inventory(
        hosts=spark.createDataFrame([(h, *v) for h, v in hosts.items()], "host_id long, platform string, team_id long"), users=None, software=None, labels=None, has_label=None,
        uses=spark.createDataFrame(uses, "username string, host_id long"), installed_on=spark.createDataFrame(installs, "name string, host_id long"),
    )
    for kind, edges, names in (("software", installs, [f"t{i}" for i in range(25)] + ["every", "none"]), ("user", uses, [f"u{i}" for i in range(30)] + ["svc"])):
        for scope in (set(hosts), {h for h in hosts if h % 4}):
            seeds = spark.createDataFrame([(n,) for n in names], "seed string")
            got = {r.seed: tuple(r)[1:] for r in graph.blast_radius(inv, kind, seeds, inv.hosts.where(F.col("host_id").isin(*scope)), hub=hub, listed=listed).collect()}
            assert got == {n: plain_blast(n, edges, uses, hosts, scope) for n in names}


def test_blast_radius_shuffles_lists_of_hosts_and_not_pairs(spark):
    titles, users, each = 100, 50, 60  # every title is on ten hosts of ten users: 60,000 pairs of a title and a host
    uses = [(f"u{u}", u * each + i) for u in range(users) for i in range(each)]
    installs = [(f"t{t}", ((t + 5 * k) % users) * each + t % each) for t in range(titles) for k in range(10)]
    hosts = spark.range(users * each).select(F.col("id").alias("host_id"), F.lit("darwin").alias("platform"), F.lit(1).cast("long").alias("team_id"))
    inv = Inventory(hosts, None, None, None, spark.createDataFrame(uses, "username string, host_id long"), spark.createDataFrame(installs, "name string, host_id long"), None)
    sc = spark.sparkContext

    def shuffled():
        listed = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        found = (listed.apply(i) for i in range(listed.size()))
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in found}

    before = shuffled()
    rows = graph.blast_radius(inv, "software", spark.createDataFrame([(f"t{t}",) for t in range(titles)], "seed string")).collect()
    written = sum(n for at, n in shuffled().items() if at not in before)
    assert {tuple(r)[1:] for r in rows} == {(10, 1, 1, 10, 10 * each - 10)} and len(rows) == titles
    assert 0 < written < 30_000


def test_numbers_of_hosts_are_their_own(spark):
    rows = graph.numbered(spark.range(5000).select(F.col("id").alias("host_id")), per_part=700).collect()
    assert len(rows) == 5000 == len({(r.bucket, r.bit) for r in rows})


def test_adjacency_reads_its_edges_once_and_keeps_the_least_kind(spark, tmp_path, monkeypatch):
    rows = [("a", "b", "X"), ("b", "a", "W"), ("b", "c", "X"), ("c", "c", "X"), (None, "a", "X"), ("a", None, "X")]
    spark.createDataFrame(rows, "src string, dst string, kind string").write.parquet(str(tmp_path / "edges"))
    settle, read = graph.settle, []

    def told(df):
        read.append(any("/edges/" in f for f in df.inputFiles()))
        return settle(df)

    monkeypatch.setattr(graph, "settle", told)
    blocks, hubs = graph.adjacency(spark.read.parquet(str(tmp_path / "edges")), 10)
    assert sum(read) == 1
    assert sorted(tuple(r) for r in blocks.collect()) == [("a", 0, "b", "W"), ("b", 0, "a", "W"), ("b", 0, "c", "X"), ("c", 0, "b", "X"), ("c", 0, "c", "X")]
    assert hubs.count() == 0
