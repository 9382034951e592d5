"""Snapshots of the graph: writing, retention, and differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostloom.functions.values import typed_id
from hostloom.operators.graph import links
from hostloom.plans.inventory import Inventory

# Properties that change without meaning.
NOISY = ("last_seen", "last_ingest", "first_seen", "last_synced", "last_attempt", "attempts", "host_count", "software_synced", "scored_at")


def props_of(df: DataFrame, without: Sequence[str]) -> Column:
    """Columns as a map of text, nulls left out; arrays as text joined by |."""
    text = [(c, F.array_join(c, "|") if t.startswith("array") else F.col(c).cast("string")) for c, t in df.dtypes if c not in without]
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c, _ in text]), F.array(*[v for _, v in text])), lambda k, v: v.isNotNull())


def node_hash(props: Column) -> Column:
    """SHA-256 of the properties without the noisy ones, in order of their names."""
    kept = F.map_filter(props, lambda k, v: ~k.isin(*NOISY))
    return F.sha2(F.to_json(F.array_sort(F.transform(F.map_entries(kept), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))), 256)


def snapshot_nodes(inv: Inventory, ts: str) -> DataFrame:
    """(snapshot_ts, kind, id, props, hash) of all hosts, users, software and labels."""
    return _unhashed_nodes(inv, ts).withColumn("hash", node_hash(F.col("props")))


def _unhashed_nodes(inv: Inventory, ts: str) -> DataFrame:
    parts = []
    for kind, df, key in (("host", inv.hosts, "host_id"), ("user", inv.users, "username"), ("software", inv.software, "name"), ("label", inv.labels, "label_id")):
        parts.append(df.select(F.lit(ts).alias("snapshot_ts"), F.lit(kind).alias("kind"), typed_id(kind, F.col(key)).alias("id"), props_of(df, ()).alias("props")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def snapshot_edges(inv: Inventory, ts: str) -> DataFrame:
    """(snapshot_ts, label, src, dst)."""
    labelled = inv.has_label.select(typed_id("host", F.col("host_id")).alias("src"), typed_id("label", F.col("label_id")).alias("dst"), F.lit("HAS_LABEL").alias("kind"))
    return links(inv).unionByName(labelled.distinct()).select(F.lit(ts).alias("snapshot_ts"), F.col("kind").alias("label"), "src", "dst")


def write_snapshot(inv: Inventory, ts: str, path: str, buckets: int = 64) -> None:
    """Nodes and edges under the path, partitioned by snapshot, kind and a bucket of their key, and a digest of every bucket
    (`digests`). A snapshot that is written again replaces itself only. A large bucket is dealt over several tasks and files."""
    spark = inv.hosts.sparkSession
    for name, df in (("nodes", _unhashed_nodes(inv, ts)), ("edges", snapshot_edges(inv, ts))):
        kind, key, _ = _FORMS[name]
        rows = df.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).hint("rebalance", kind, "bucket")
        if name == "nodes":  # hashed where rows are dealt evenly, not where a small file is read by one task
            rows = rows.withColumn("hash", node_hash(F.col("props")))
        _replace(rows, f"{path}/{name}", ["snapshot_ts", kind, "bucket"])
    parts = [bucket_digests(_partition(spark, path, name, ts), name) for name in _FORMS]
    _replace(parts[0].unionByName(parts[1]).withColumn("snapshot_ts", F.lit(ts)).coalesce(1), f"{path}/digests", ["snapshot_ts"])


#: Of nodes and edges: the column that names the kind, the key, and what the digest covers.
_FORMS = {"nodes": ("kind", ("kind", "id"), ("id", "hash")), "edges": ("label", ("label", "src", "dst"), ("src", "dst"))}


def _replace(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _partition(spark: SparkSession, path: str, name: str, ts: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").withColumn("snapshot_ts", F.col("snapshot_ts").cast("string")).where(F.col("snapshot_ts") == ts)


def bucket_digests(rows: DataFrame, part: str) -> DataFrame:
    """(part, kind, bucket, n, digest): of every bucket its rows and what they hash to, in any order: two independent XORs.
    Combined before the shuffle, and small: kinds times buckets."""
    kind, _, covered = _FORMS[part]
    digest = F.struct(*[F.bit_xor(F.xxhash64(F.lit(seed), *covered)).alias(f"x{seed}") for seed in (1, 2)])
    return rows.groupBy(F.lit(part).alias("part"), F.col(kind).alias("kind"), "bucket").agg(F.count("*").alias("n"), digest.alias("digest"))


def changed_buckets(spark: SparkSession, path: str, a: str, b: str) -> DataFrame:
    """(part, kind, bucket) of two written snapshots whose digests differ, or that only one has."""
    old, new = (_partition(spark, path, "digests", ts).select("part", "kind", "bucket", F.struct("n", "digest").alias(side)) for ts, side in ((a, "was"), (b, "now")))
    return old.join(new, ["part", "kind", "bucket"], "full_outer").where(~F.col("was").eqNullSafe(F.col("now"))).select("part", "kind", "bucket")


def changed_rows(spark: SparkSession, path: str, a: str, b: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """nodes and edges of two written snapshots, of the buckets whose digests differ; other buckets hold the same in both and
    aren't read. The `diff_*` functions give the same for these rows as for whole snapshots."""
    found: dict[str, dict[str, list[int]]] = {name: {} for name in _FORMS}
    for r in changed_buckets(spark, path, a, b).collect():  # at most kinds times buckets
        found[r.part].setdefault(r.kind, []).append(r.bucket)
    out = {}
    for name, kinds in found.items():
        column = _FORMS[name][0]
        test = F.lit(False)
        for kind, buckets in kinds.items():
            test = test | ((F.col(column) == kind) & F.col("bucket").isin(sorted(buckets)))
        out[name] = tuple(_partition(spark, path, name, ts).where(test).drop("bucket") for ts in (a, b))
    return out


def read_snapshot(spark: SparkSession, path: str, ts: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one snapshot; only its partition is read."""
    nodes, edges = (_partition(spark, path, n, ts).drop("bucket") for n in ("nodes", "edges"))
    return nodes, edges


def list_snapshots(nodes: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    """(snapshot_ts, hosts, users, software, labels, edges), newest first."""
    count = lambda k, name: F.count_if(F.col("kind") == k).alias(name)
    n = nodes.groupBy("snapshot_ts").agg(count("host", "hosts"), count("user", "users"), count("software", "software"), count("label", "labels"))
    e = edges.groupBy("snapshot_ts").agg(F.count("*").alias("edges"))
    return n.join(e, "snapshot_ts", "left").na.fill(0, ["edges"]).orderBy(F.desc("snapshot_ts")).limit(limit)


def retained_snapshots(listing: DataFrame, now: str, days: int, most: int) -> DataFrame:
    """Snapshots to keep: not older than `days`, then the newest `most`."""
    fresh = listing.where(F.to_timestamp("snapshot_ts") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    return fresh.orderBy(F.desc("snapshot_ts")).limit(most)


def snapshot_deltas(listing: DataFrame) -> DataFrame:
    """Adds d_hosts, d_users, d_software, d_edges: the change against the snapshot before; null for the first."""
    w = Window.orderBy("snapshot_ts")
    return listing.select("*", *[(F.col(c) - F.lag(c).over(w)).alias(f"d_{c}") for c in ("hosts", "users", "software", "edges")])


def _last(nodes: DataFrame) -> DataFrame:
    """One row per id; of repeated ids the greatest hash, so that reruns agree."""
    return nodes.groupBy("kind", "id").agg(F.max("hash").alias("hash"), F.max_by("props", "hash").alias("props"))


def diff_nodes(a: DataFrame, b: DataFrame, compat: bool = False) -> DataFrame:
    """(bucket, kind, id): added and removed ids; compat leaves out software and labels. Only ids are shuffled."""
    x, y = a.select("kind", "id").distinct().withColumn("a", F.lit(1)), b.select("kind", "id").distinct().withColumn("b", F.lit(1))
    out = x.join(y, ["kind", "id"], "full_outer").where(F.col("a").isNull() | F.col("b").isNull()).select(F.when(F.col("a").isNull(), "added").otherwise("removed").alias("bucket"), "kind", "id")
    return out.where(F.col("kind").isin("host", "user")) if compat else out


def diff_properties(a: DataFrame, b: DataFrame) -> DataFrame:
    """(kind, id, prop, old, new): changed properties of ids in both, noisy ones left out. Hashes are compared before properties are unfolded."""
    x, y = _last(a).alias("x"), _last(b).alias("y")
    both = x.join(y, ["kind", "id"]).where(F.col("x.hash") != F.col("y.hash"))
    names = F.array_union(F.map_keys("x.props"), F.map_keys("y.props"))
    rows = both.select("kind", "id", F.explode(names).alias("prop"), F.col("x.props").alias("p"), F.col("y.props").alias("q"))
    rows = rows.where(~F.col("prop").isin(*NOISY)).select("kind", "id", "prop", F.try_element_at("p", F.col("prop")).alias("old"), F.try_element_at("q", F.col("prop")).alias("new"))
    return rows.where(~F.col("old").eqNullSafe(F.col("new")))


def diff_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """(bucket, label, src, dst): added and removed edges, in one shuffle."""
    keys = ["label", "src", "dst"]
    both = a.select(*keys, F.lit(1).alias("side")).unionByName(b.select(*keys, F.lit(2).alias("side")))
    return both.groupBy(*keys).agg(F.bit_or("side").alias("sides")).where("sides < 3").select(F.when(F.col("sides") == 2, "added").otherwise("removed").alias("bucket"), *keys)


def export_rows(df: DataFrame) -> DataFrame:
    """A table for CSV: arrays joined by `; `, with a count of users where there is a list of them."""
    out = df.withColumn("user_count", F.size("affected_users")) if "affected_users" in df.columns else df
    return out.select(*[F.array_join(c, "; ").alias(c) if t.startswith("array<string") else F.col(c) for c, t in out.dtypes])


def export(df: DataFrame, path: str, form: str = "csv") -> None:
    """Writes a table as CSV with a header, or as JSON lines."""
    if form == "csv":
        export_rows(df).write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").json(path)
