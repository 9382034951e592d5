"""Installs as one row a host in a bucketed table: a batch meets its hosts' rows where they lie."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.functions.values import greatest_version

TITLE = ("name", "version", "source", "extension_key", "first_seen", "last_seen")


def titles_by_host(edges: DataFrame) -> DataFrame:
    """(host_id, titles): a host's installs as a list in order of name; a host's titles are bounded, a title's hosts are not."""
    return edges.groupBy("host_id").agg(F.array_sort(F.collect_list(F.struct(*TITLE))).alias("titles"))


def save_titles(by_host: DataFrame, table: str, buckets: int) -> None:
    """Writes (host_id, titles) as a table bucketed by host_id."""
    by_host.repartition(buckets, "host_id").write.bucketBy(buckets, "host_id").sortBy("host_id").mode("overwrite").saveAsTable(table)


def upsert_titles(state: DataFrame, batch: DataFrame, hosts: DataFrame, seen_at: str) -> DataFrame:
    """(host_id, titles) after a batch of full lists for `hosts`: the rules of merge.upsert_installed_on.

    State and batch are joined by host alone. Where the state is a bucketed table, only the batch is shuffled, into the
    state's buckets; the state is read where it lies, bucket by bucket.
    """
    touched = hosts.select("host_id").distinct()
    at = F.lit(seen_at).cast("timestamp")
    one = batch.join(touched, "host_id", "left_semi").groupBy("host_id", "name").agg(greatest_version().alias("version"), F.max("source").alias("source"), F.max("extension_key").alias("extension_key"))
    lists = one.groupBy("host_id").agg(F.array_sort(F.collect_list(F.struct("name", "version", "source", "extension_key"))).alias("new"))
    sent = touched.join(lists, "host_id", "left").select("host_id", F.coalesce("new", F.array().cast(lists.schema["new"].dataType)).alias("new"))
    both = state.select("host_id", F.col("titles").alias("old")).join(sent, "host_id", "full_outer")
    old = F.coalesce("old", F.array().cast(state.schema["titles"].dataType))
    stored = F.map_from_entries(F.transform(old, lambda t: F.struct(t["name"], t)))

    def merged(n):
        was = F.try_element_at(stored, n["name"])
        kept = [F.coalesce(n[c], was[c]).alias(c) for c in ("version", "source", "extension_key")]
        return F.struct(n["name"].alias("name"), *kept, F.coalesce(was["first_seen"], at).alias("first_seen"), at.alias("last_seen"))

    names, keys = F.transform("new", lambda n: n["name"]), F.filter(F.transform("new", lambda n: n["extension_key"]), lambda k: k.isNotNull())
    by_key = F.filter(old, lambda t: ~F.array_contains(names, t["name"]) & F.coalesce(F.array_contains(keys, t["extension_key"]), F.lit(False)))
    after = F.when(F.col("new").isNull(), F.col("old")).otherwise(F.array_sort(F.concat(F.transform("new", merged), by_key)))
    return both.select("host_id", after.alias("titles")).where(F.size("titles") > 0)


def edges_of(by_host: DataFrame) -> DataFrame:
    """(name, host_id, version, source, extension_key, first_seen, last_seen), one row each."""
    return by_host.select("host_id", F.explode("titles").alias("t")).select("t.name", "host_id", *[f"t.{c}" for c in TITLE[1:]])

