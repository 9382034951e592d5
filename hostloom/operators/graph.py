"""Reachability and graph extracts over USES and INSTALLED_ON edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostloom.functions.shared import discard, settle, shared_dir
from hostloom.functions.values import typed_id
from hostloom.plans.inventory import Inventory

#: Accounts that are on every host and say nothing about reach.
DEFAULT_ACCOUNTS = ("root", "administrator", "admin", "guest", "defaultaccount", "wdagutilityaccount")
MAX_HOPS, EGO_HOPS, EGO_CAP, GRAPH_TITLES = 6, 3, 500, 50
#: Neighbours of a node that one block of its adjacency holds, about.
ADJACENT = 10_000
#: Hosts from which on a user's hosts are held as a bitmap (4 KB for 32,768 hosts).
HUB_HOSTS = 1024
#: Hosts up to which the lists of a seed's users are merged in one group (128 KB of numbers).
LISTED_HOSTS = 16_384


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() to the shared folder that the session names."""
    at, sc = shared_dir(df.sparkSession), df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return df.checkpoint()


def numbered(hosts: DataFrame, per_part: int = 1 << 20) -> DataFrame:
    """(host_id, bucket, bit): a place of its own in fixed-size bitmaps for each host; settled, so that it stays. Numbers run
    on within a part of about `per_part` hosts, so all buckets but the parts' last are full."""
    parts = hosts.select("host_id").distinct()
    number = F.monotonically_increasing_id() + 1
    parts = parts.repartition(max(1, -(-parts.count() // per_part)), "host_id").select("host_id", number.alias("n"))
    return settle(parts.select("host_id", F.bitmap_bucket_number("n").alias("bucket"), F.bitmap_bit_position("n").alias("bit")))


def blast_radius(inv: Inventory, kind: str, seeds: DataFrame, hosts: DataFrame | None = None, excluded: tuple[str, ...] = DEFAULT_ACCOUNTS, hub: int = HUB_HOSTS, listed: int = LISTED_HOSTS) -> DataFrame:
    """(seed, host_reach, platforms, teams, user_impact, lateral): what each seed reaches; seeds: (seed), titles or users.

    Hosts of the seed in scope; users of those hosts, but for the seed and default accounts; other hosts of those
    users, anywhere. All seeds go together. Hosts that a seed reaches in all, less those of its own, are the lateral ones.
    Users with one host lead to no other. Users with more than `hub` hosts are held as bitmaps, which are merged for the seeds
    that reach them. Of the other seeds, those whose users have at most `listed` hosts in all (their own counted too) merge
    lists of hosts, a list a user; beyond that hosts are counted as distinct pairs, which no group has to hold.
    """
    if kind not in ("software", "user"):
        raise ValueError("kind is software or user")
    known = settle(inv.hosts.select("host_id", "platform", "team_id"))
    hosts = known if hosts is None else hosts
    edges = inv.installed_on.select(F.col("name").alias("seed"), "host_id") if kind == "software" else inv.uses.select(F.col("username").alias("seed"), "host_id")
    # numbers stand for the seeds between the first step and the last: pairs of them are narrow and cheap to hash
    seeds = settle(seeds.select("seed").distinct().withColumn("s", F.monotonically_increasing_id()))
    reach = edges.join(seeds, "seed").join(hosts.select("host_id"), "host_id", "left_semi").select("s", "host_id").distinct()
    # all three joins by host share one shuffle of the pairs
    reach = settle(reach.join(known.withColumn("known", F.lit(True)), "host_id", "left"))
    # pairs are distinct, and platforms and teams few: one pass counts all three
    few = lambda c, name: F.size(F.collect_set(c)).cast("long").alias(name)
    by_host = reach.where("known").groupBy("s").agg(F.count("*").alias("host_reach"), few("platform", "platforms"), few("team_id", "teams"))
    uses = settle(inv.uses.where(~F.lower("username").isin(*excluded)).select("username", "host_id").distinct())
    counted = settle(uses.groupBy("username").agg(F.count("*").alias("n")).withColumn("u", F.monotonically_increasing_id()))
    uses = uses.join(counted, "username").select("u", "host_id", "n")
    impact = reach.join(uses, "host_id").select("s", "u", "n").distinct()
    if kind == "user":
        impact = impact.join(seeds.join(counted, F.col("seed") == F.col("username")).select("s", "u"), ["s", "u"], "left_anti")
    impact = settle(impact)
    users = impact.groupBy("s").agg(F.count("*").alias("user_impact"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("led_to"), F.max("n").alias("most"))
    zero = F.lit(0).cast("long")
    weight = F.coalesce("host_reach", zero) + F.coalesce("led_to", zero)
    way = F.when(F.col("most") > hub, "bitmaps").when(weight <= listed, "lists").otherwise("pairs")
    sizes = settle(by_host.join(users, "s", "full").withColumn("way", way))
    in_all = reached(reach.where("known").select("s", "host_id"), impact, uses, known, sizes.select("s", "way"), hub)
    out = seeds.join(sizes, "s", "left").join(in_all, "s", "left")
    out = out.withColumn("lateral", F.col("in_all") - F.col("host_reach"))
    return out.select("seed", *[F.coalesce(c, zero).alias(c) for c in ("host_reach", "platforms", "teams", "user_impact", "lateral")])


def reached(own: DataFrame, impact: DataFrame, uses: DataFrame, hosts: DataFrame, ways: DataFrame, hub: int) -> DataFrame:
    """(s, in_all): distinct hosts that are a seed's own or a host of its users. own: (s, host_id), impact: (s, u, n), uses:
    (u, host_id, n), all distinct; n: hosts of the user u; ways: (s, way), how a seed's hosts are counted."""
    taken = {r.way for r in ways.select("way").distinct().collect()}
    of = lambda df, way: df if taken <= {way} else df.join(ways.where(F.col("way") == way).select("s"), "s", "left_semi")
    roaming = uses.where((F.col("n") > 1) & (F.col("n") <= hub)).join(hosts.select("host_id"), "host_id", "left_semi").select("u", "host_id")
    led = impact.where((F.col("n") > 1) & (F.col("n") <= hub)).select("s", "u")
    pairs = lambda way: of(own, way).unionByName(of(led, way).join(roaming, "u").select("s", "host_id"))
    # a list a user and not a row a host: a row of a list takes a fraction of a pair's room, and its group is merged in one array
    lists = of(led, "lists").join(roaming.groupBy("u").agg(F.collect_list("host_id").alias("hosts")), "u").select("s", "hosts")
    lists = of(own, "lists").select("s", F.array("host_id").alias("hosts")).unionByName(lists).repartition("s")
    parts = [lists.groupBy("s").agg(F.size(F.array_distinct(F.flatten(F.collect_list("hosts")))).cast("long").alias("in_all"))]
    if "pairs" in taken:
        parts.append(pairs("pairs").groupBy("s").agg(F.count_distinct("host_id").alias("in_all")))
    if "bitmaps" in taken:
        number = numbered(hosts)
        bits = F.bitmap_construct_agg("bit").alias("bits")
        by_hub = settle(uses.where(F.col("n") > hub).join(number, "host_id").groupBy("u", "bucket").agg(bits))
        plain = pairs("bitmaps").join(number, "host_id").groupBy("s", "bucket").agg(bits)
        hubs = impact.where(F.col("n") > hub).join(by_hub, "u").select("s", "bucket", "bits")
        merged = plain.unionByName(hubs).groupBy("s", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        parts.append(merged.groupBy("s").agg(F.sum(F.bitmap_count("bits")).alias("in_all")))
    return reduce(DataFrame.unionByName, parts)


def blast_scores(metrics: DataFrame, inv: Inventory, hosts: DataFrame | None = None) -> DataFrame:
    """Adds host_score, user_score, lateral_score, platform_score: whole percents, at most 100. Hosts and users against
    the scope's totals, lateral hosts against all, platforms against 3; a total of 0 counts as 1."""
    hosts = inv.hosts if hosts is None else hosts
    one = lambda df, c, name: df.agg(F.greatest(F.count_distinct(c), F.lit(1)).alias(name))
    totals = one(hosts, "host_id", "t_hosts").crossJoin(one(inv.uses.join(hosts.select("host_id"), "host_id", "left_semi"), "username", "t_users")).crossJoin(one(inv.hosts, "host_id", "t_all"))
    percent = lambda n, d: F.least((F.col(n) * 100 / d).cast("int"), F.lit(100))
    return metrics.crossJoin(F.broadcast(totals)).select(metrics["*"], percent("host_reach", F.col("t_hosts")).alias("host_score"), percent("user_impact", F.col("t_users")).alias("user_score"), percent("lateral", F.col("t_all")).alias("lateral_score"), percent("platforms", F.lit(3)).alias("platform_score"))


def links(inv: Inventory, hosts: DataFrame | None = None) -> DataFrame:
    """(src, dst, kind): user -> host and software -> host, typed ids, hosts in scope."""
    hosts = (inv.hosts if hosts is None else hosts).select("host_id")

    def part(edges: DataFrame, kind: str, key: str, name: str) -> DataFrame:
        pairs = edges.join(hosts, "host_id", "left_semi").select(key, "host_id").distinct()  # before ids are made: narrower
        return pairs.select(typed_id(kind, F.col(key)).alias("src"), typed_id("host", F.col("host_id")).alias("dst"), F.lit(name).alias("kind"))

    return part(inv.uses, "user", "username", "USES").unionByName(part(inv.installed_on, "software", "name", "INSTALLED_ON"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "kind").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind"))


def adjacency(edges: DataFrame, block: int = ADJACENT) -> tuple[DataFrame, DataFrame]:
    """(blocks, hubs). blocks: (src, block, dst, kind), both directions, one row for each pair of neighbours with its least
    kind; hubs: (src, blocks) of nodes with more than `block` neighbours, which are dealt over that many blocks, so that no
    task joins a whole hub. Edges are settled first, so that the tasks which sort them hold nothing else; pairs are made
    distinct in one direction, settled, then turned. Edges without an end lead nowhere."""
    edges = settle(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", "kind"))
    ends = [F.col("src"), F.col("dst")]
    pairs = settle(edges.groupBy(F.least(*ends).alias("x"), F.greatest(*ends).alias("y")).agg(F.min("kind").alias("kind")))
    both = pairs.select(F.col("x").alias("src"), F.col("y").alias("dst"), "kind").unionByName(pairs.where("x <> y").select(F.col("y").alias("src"), F.col("x").alias("dst"), "kind"))
    hubs = settle(both.groupBy("src").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1"))
    number = F.pmod(F.xxhash64("dst"), F.coalesce("blocks", F.lit(1))).cast("int")
    blocks = settle(both.join(hubs, "src", "left").select("src", number.alias("block"), "dst", "kind"))
    discard(edges, pairs)
    return blocks, hubs


def neighbours(front: DataFrame, blocks: DataFrame, hubs: DataFrame) -> DataFrame:
    """front(node, ...) with `dst` and `kind` of each neighbour; a hub's row meets each of its blocks by itself."""
    dealt = front.join(hubs.select(F.col("src").alias("node"), "blocks"), "node", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    return dealt.join(blocks.withColumnRenamed("src", "node"), ["node", "block"]).drop("block")


def shortest_paths(pairs: DataFrame, edges: DataFrame, max_hops: int = MAX_HOPS, block: int = ADJACENT) -> DataFrame:
    """(a, b, nodes, kinds): a shortest undirected path of at most `max_hops` between each pair; of several the one
    whose node ids come first. a == b: the node alone; no path: empty arrays. pairs: (a, b).

    Two searches, from either end, one hop at a time for all pairs together (a loop over hops, never over rows). Each pair
    goes on from the end that has the fewer nodes to go on from. After every hop the two fronts are joined: pairs whose
    fronts meet are done and leave, as do pairs with an empty front, so the loop ends with the longest path that there is.
    Fronts hold the least path to each node, from a or to b, in the order from a to b, so the least halves make the least
    whole: a shortest path crosses both fronts in one node.
    """
    if not 1 <= max_hops <= MAX_HOPS:
        raise ValueError(f"1 to {MAX_HOPS} hops")
    blocks, hubs = adjacency(edges, block)
    ask = settle(pairs.select("a", "b").distinct())
    none = F.array().cast("array<string>")
    start = lambda end: settle(ask.select("a", "b", F.col(end).alias("node"), F.array(end).alias("nodes"), none.alias("kinds")))
    front = {end: start(end) for end in ("a", "b")}
    seen = {end: front[end].select("a", "b", "node") for end in ("a", "b")}
    found, old = [], []

    def go_on(end: str, chosen: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The front of `end` after a hop of the chosen pairs, with that of the others; the nodes seen so far. Pairs that are done drop out."""
        ahead = end == "a"
        going = front[end].join(chosen, ["a", "b"], "left_semi")
        nodes = F.concat("nodes", F.array("dst")) if ahead else F.concat(F.array("dst"), "nodes")
        kinds = F.concat("kinds", F.array("kind")) if ahead else F.concat(F.array("kind"), "kinds")
        step = neighbours(going, blocks, hubs).select("a", "b", F.col("dst").alias("node"), F.struct(nodes.alias("nodes"), kinds.alias("kinds")).alias("p"))
        step = step.join(seen[end], ["a", "b", "node"], "left_anti").groupBy("a", "b", "node").agg(F.min("p").alias("p")).select("a", "b", "node", "p.*")
        new = settle(step)
        rest = front[end].join(others, ["a", "b"], "left_semi")
        return settle(rest.unionByName(new)), settle(seen[end].unionByName(new.select("a", "b", "node")))

    for hop in range(max_hops + 1):
        back = front["b"].select("a", "b", "node", F.col("nodes").alias("back"), F.col("kinds").alias("back_kinds"))
        met = front["a"].join(back, ["a", "b", "node"]).select("a", "b", F.concat("nodes", F.slice("back", 2, 2 * MAX_HOPS)).alias("nodes"), F.concat("kinds", "back_kinds").alias("kinds"))
        found.append(settle(met.groupBy("a", "b").agg(F.min(F.struct("nodes", "kinds")).alias("p"))))
        sizes = [front[end].groupBy("a", "b").agg(F.count("*").alias(f"n_{end}")) for end in ("a", "b")]
        left = settle(sizes[0].join(sizes[1], ["a", "b"]).join(found[-1], ["a", "b"], "left_anti"))
        if hop == max_hops or left.isEmpty():
            break
        old += [front["a"], front["b"], seen["a"], seen["b"], left]
        few, many = (left.where(c).select("a", "b") for c in ("n_a <= n_b", "n_a > n_b"))
        (front["a"], seen["a"]), (front["b"], seen["b"]) = go_on("a", few, many), go_on("b", many, few)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    out = settle(ask.join(out, ["a", "b"], "left").select("a", "b", F.coalesce("p.nodes", none).alias("nodes"), F.coalesce("p.kinds", none).alias("kinds")))
    discard(blocks, hubs, ask, *found, *old, *front.values(), *seen.values())
    return out


def ego_network(seeds: DataFrame, edges: DataFrame, depth: int = 1, cap: int = EGO_CAP) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) around each seed. nodes: (seed, node, hop, truncated), at most `cap` a seed, nearest hop first,
    then by id; `truncated` tells that the seed has more. links: (seed, src, dst, kind) with both ends kept.

    A seed has a budget of cap + 1 nodes: each hop takes the least new ids that are left of it, and a seed without budget
    leaves the front. So only the cap + 1 least neighbours of a node can matter (the ones seen before are among the
    budget), and the adjacency is cut to these before any hop, on the map side first; hubs are never expanded whole.
    Links are looked up from their hosts' ends: a host's list is bounded, the hosts of a title are not.
    """
    if not 1 <= depth <= EGO_HOPS:
        raise ValueError(f"depth is 1 to {EGO_HOPS}")
    edges = settle(edges.select("src", "dst", "kind").distinct())
    both = both_ways(edges).select("src", "dst").distinct()
    near = settle(both.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("r") <= cap + 1).select(F.col("src").alias("node"), "dst"))
    front = seeds.select("seed").distinct().select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"))
    seen = settle(front)
    front, parts = seen, []
    for hop in range(1, depth + 1):
        step = front.join(near, "node").select("seed", F.col("dst").alias("node")).distinct().join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        spent = seen.groupBy("seed").agg(F.count("*").alias("spent"))
        ranked = step.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy("node"))).where(F.col("r") <= cap + 1)
        front = settle(ranked.join(spent, "seed").where(F.col("r") + F.col("spent") <= cap + 1).select("seed", "node", F.lit(hop).alias("hop")))
        parts += [seen, front]
        if front.isEmpty():
            break
        seen = settle(seen.unionByName(front))
    ranked = seen.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy("hop", "node")))
    sizes = seen.groupBy("seed").agg((F.count("*") > cap).alias("truncated"))
    nodes = settle(ranked.where(F.col("r") <= cap).join(sizes, "seed").select("seed", "node", "hop", "truncated"))
    kept = nodes.select("seed", F.col("node").alias("dst")).join(edges, "dst").join(nodes.select("seed", F.col("node").alias("src")), ["seed", "src"]).select("seed", "src", "dst", "kind")
    discard(near, *parts, seen)
    return nodes, kept


def user_graph(inv: Inventory) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): hosts that have users, those users, and the USES links."""
    return _induced(inv, links(inv).where("kind = 'USES'"))


def _induced(inv: Inventory, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return _named(inv).join(ids, "id", "left_semi"), edges


def _named(inv: Inventory) -> DataFrame:
    """(id, kind, label, team_name, category): all nodes."""
    none = F.lit(None).cast("string")
    hosts = inv.hosts.select(typed_id("host", F.col("host_id")).alias("id"), F.lit("host").alias("kind"), F.col("hostname").alias("label"), "team_name", none.alias("category"))
    users = inv.users.select(typed_id("user", F.col("username")).alias("id"), F.lit("user").alias("kind"), F.col("username").alias("label"), none.alias("team_name"), none.alias("category"))
    titles = inv.software.select(typed_id("software", F.col("name")).alias("id"), F.lit("software").alias("kind"), F.col("display_name").alias("label"), none.alias("team_name"), F.get("category", 0).alias("category"))
    return hosts.unionByName(users).unionByName(titles)


def full_graph(inv: Inventory, hosts: DataFrame | None = None, titles: int = GRAPH_TITLES) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): hosts in scope with any edge, their users, the `titles` titles on most hosts (ties by name), and the links among them."""
    edges = links(inv, hosts)
    top = edges.where("kind = 'INSTALLED_ON'").groupBy("src").agg(F.count_distinct("dst").alias("n")).orderBy(F.desc("n"), "src").limit(titles).select("src")
    kept = edges.where("kind = 'USES'").unionByName(edges.where("kind = 'INSTALLED_ON'").join(F.broadcast(top), "src", "left_semi"))
    ends = edges.select(F.col("dst").alias("id")).unionByName(kept.select(F.col("src").alias("id"))).distinct()
    return _named(inv).join(ends, "id", "left_semi"), kept


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree)."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def sample_graph(nodes: DataFrame, edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): about n nodes, each kind its n / kinds of highest degree, the rest by degree over all, ties by id; links with both ends kept."""
    ranked = nodes.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    kinds = nodes.agg(F.greatest(F.count_distinct("kind"), F.lit(1)).alias("kinds"))
    by_kind = _top_ranks(ranked, ["kind"], n).crossJoin(F.broadcast(kinds)).withColumn("first", F.col("r") <= F.floor(F.lit(n) / F.col("kinds"))).drop("r", "kinds")
    kept = by_kind.orderBy(F.desc("first"), F.desc("degree"), "id").limit(n).drop("first")
    return kept, _among(edges, kept)


def _top_ranks(ranked: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rank by degree within a key, at most n of each: a local cut in salted buckets comes first, so a kind that holds
    most nodes isn't sorted in one task."""
    order = [F.desc("degree"), "id"]
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    local = ranked.withColumn("salt", salt).withColumn("r", F.row_number().over(Window.partitionBy(*keys, "salt").orderBy(*order))).where(F.col("r") <= n)
    return local.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("r") <= n).drop("salt")


def _among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "kind")


def cap_graph(nodes: DataFrame, edges: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): the `budget` nodes of highest degree, ties by id, and the links among them."""
    kept = nodes.join(degrees(edges), "id", "left").orderBy(F.desc(F.coalesce("degree", F.lit(0))), "id").limit(budget).select(nodes.columns)
    return kept, _among(edges, kept)


def software_graph(inv: Inventory, name: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): one title, its hosts and their users."""
    hosts = inv.hosts.join(inv.installed_on.where(F.col("name") == name).select("host_id"), "host_id", "left_semi")
    edges = links(inv, hosts).where((F.col("kind") == "USES") | (F.col("src") == f"software_{name}"))
    return _induced(inv, edges)


def host_graph(inv: Inventory, host: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): one host by id or hostname (any case; the latest seen, then the least id), its users and software."""
    fits = (F.col("host_id").cast("string") == host) | (F.lower("hostname") == host.lower())
    one = inv.hosts.where(fits).orderBy(F.desc_nulls_last("last_seen"), "host_id").limit(1)
    return _induced(inv, links(inv, one))


def relationships(inv: Inventory, limit: int = 500) -> DataFrame:
    """(kind, source, hostname): both kinds of edges in order, half the limit each."""
    named = inv.hosts.select("host_id", "hostname")
    a = inv.uses.join(named, "host_id").select(F.lit("USES").alias("kind"), F.col("username").alias("source"), "hostname").orderBy("source", "hostname").limit(limit // 2)
    b = inv.installed_on.join(named, "host_id").select(F.lit("INSTALLED_ON").alias("kind"), F.col("name").alias("source"), "hostname").orderBy("source", "hostname").limit(limit // 2)
    return a.unionByName(b)


def cluster_keys(nodes: DataFrame) -> DataFrame:
    """(cluster, nodes): hosts by team, software by its first category, users together."""
    key = F.when(F.col("kind") == "host", F.concat(F.lit("team:"), F.coalesce("team_name", F.lit("none")))).when(F.col("kind") == "software", F.concat(F.lit("category:"), F.coalesce("category", F.lit("none")))).otherwise("users")
    return nodes.groupBy(key.alias("cluster")).agg(F.count("*").alias("nodes"))
