"""Merges of new batches into stored tables, deletion of what is stale, and label membership."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.functions.values import greatest_version, version_sort_key

STALE_DAYS, SKEW_MINUTES, ORPHANS_SHOWN = 7, 5, 50


def upsert(state: DataFrame, batch: DataFrame, keys: list[str], keep_null: bool = False) -> DataFrame:
    """MERGE: rows of the batch replace or join those of the state; keep_null: a null in the batch keeps the stored value.

    One full outer join by the keys. Several rows of a key in the batch: the greatest in column order wins, so that
    reruns agree. Columns are the state's."""
    rest = [c for c in state.columns if c not in keys]
    one = batch.groupBy(*keys).agg(F.max(F.struct(*[F.col(c) for c in rest if c in batch.columns])).alias("new"))
    joined = state.select(*keys, F.struct(*rest).alias("old")).join(one, keys, "full_outer")
    pick = lambda c: F.coalesce(f"new.{c}", f"old.{c}") if keep_null else F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
    return joined.select(*keys, *[(pick(c) if c in batch.columns else F.col(f"old.{c}")).alias(c) for c in rest])


def upsert_hosts(state: DataFrame, batch: DataFrame) -> DataFrame:
    """MERGE by host_id; the batch's attributes win, nulls too."""
    return upsert(state, batch, ["host_id"])


def upsert_users(state: DataFrame, batch: DataFrame) -> DataFrame:
    """MERGE by username."""
    return upsert(state, batch, ["username"])


def prune_stale_uses(uses: DataFrame, batch: DataFrame) -> DataFrame:
    """USES after a batch (host_id, users): hosts that sent a list keep and gain exactly its users; hosts whose list is
    missing (null) and hosts not in the batch keep what they have."""
    sent = batch.where(F.col("users").isNotNull())
    kept = uses.join(sent.select("host_id").distinct(), "host_id", "left_anti").select("username", "host_id")
    return kept.unionByName(sent.select(F.explode("users").alias("username"), "host_id")).distinct()


def upsert_software(state: DataFrame, batch: DataFrame, seen_at: str) -> DataFrame:
    """MERGE titles by name. state: (name, versions, sources, first_version, last_version, first_seen, last_seen,
    display_name, is_builtin, app_team_id). batch: rows (name, version, source, display_name, kind, is_builtin, app_team_id).

    Unseen versions and sources are appended in order; first_* stays; last_version is the greatest in version order of
    stored and new ones; a null attribute keeps the stored one, but is_builtin and app_team_id follow the batch where
    kind is set. Versions are ordered per distinct title and version, not per install.
    """
    one = batch.groupBy("name").agg(
        F.array_sort(F.collect_set(F.nullif("version", F.lit("")))).alias("b_versions"), F.array_sort(F.collect_set(F.nullif("source", F.lit("")))).alias("b_sources"), F.max("display_name").alias("b_display_name"),
        F.max("kind").alias("b_kind"), F.max("is_builtin").alias("b_is_builtin"), F.max("app_team_id").alias("b_app_team_id"),
    )
    none = F.array().cast("array<string>")
    m = state.join(one, "name", "full_outer")
    grow = lambda old, new: F.concat(F.coalesce(old, none), F.array_except(F.coalesce(new, none), F.coalesce(old, none)))
    best = F.array_max(F.transform(F.filter(F.concat(F.coalesce("b_versions", none), F.array("last_version")), lambda v: v.isNotNull() & (v != "unknown")), lambda v: F.struct(version_sort_key(v).alias("k"), v.alias("v"))))["v"]
    new, at = F.col("b_versions").isNotNull(), F.lit(seen_at).cast("timestamp")
    follow = lambda c: F.when(F.col("b_kind").isNotNull(), F.col(f"b_{c}")).otherwise(F.coalesce(f"b_{c}", c)).alias(c)
    return m.select(
        "name", grow(F.col("versions"), F.col("b_versions")).alias("versions"), grow(F.col("sources"), F.col("b_sources")).alias("sources"),
        F.coalesce("first_version", F.get("b_versions", 0)).alias("first_version"), F.coalesce(best, "last_version").alias("last_version"), F.coalesce("first_seen", at).alias("first_seen"),
        F.when(new, at).otherwise(F.col("last_seen")).alias("last_seen"), F.coalesce("b_display_name", "display_name").alias("display_name"), follow("is_builtin"), follow("app_team_id"),
    )


def latest_version(rows: DataFrame) -> DataFrame:
    """(name, last_version): the greatest version of each title in version order; rows: (name, version)."""
    distinct = rows.where(F.coalesce("version", F.lit("")) != "").select("name", "version").distinct()
    return distinct.groupBy("name").agg(F.max(F.struct(version_sort_key(F.col("version")).alias("k"), "version")).alias("m")).select("name", F.col("m.version").alias("last_version"))


def upsert_installed_on(state: DataFrame, batch: DataFrame, hosts: DataFrame, seen_at: str) -> DataFrame:
    """Edges after a batch of full lists for `hosts`: (name, host_id, version, source, extension_key, first_seen, last_seen).

    Only those hosts' edges are touched: an edge goes if the host reports neither its name nor its extension key;
    reported ones are created or updated (first_seen on creation only, null properties keep the stored value).
    """
    touched = hosts.select("host_id").distinct()
    apart = state.join(touched, "host_id", "left_anti")
    old = state.join(touched, "host_id", "left_semi")
    by_name = old.join(batch.select("host_id", "name").distinct(), ["host_id", "name"], "left_semi")
    by_key = old.join(batch.select("host_id", "name").distinct(), ["host_id", "name"], "left_anti").join(batch.select("host_id", "extension_key").where(F.col("extension_key").isNotNull()).distinct(), ["host_id", "extension_key"], "left_semi").select(state.columns)
    at = F.lit(seen_at).cast("timestamp")
    now = batch.join(touched, "host_id", "left_semi").groupBy("name", "host_id").agg(greatest_version().alias("version"), F.max("source").alias("source"), F.max("extension_key").alias("extension_key")).withColumns({"first_seen": at, "last_seen": at})
    a, b = by_name.alias("a"), now.alias("b")
    merged = b.join(a, ["name", "host_id"], "left").select("name", "host_id", *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in ("version", "source", "extension_key")], F.coalesce("a.first_seen", "b.first_seen").alias("first_seen"), "b.last_seen")
    columns = ["name", "host_id", "version", "source", "extension_key", "first_seen", "last_seen"]
    return apart.select(columns).unionByName(merged.select(columns)).unionByName(by_key.select(columns))


def hosts_needing_software(docs: DataFrame, state: DataFrame, edges: DataFrame, identity_version: str = "1") -> DataFrame:
    """(host_id, stamp, action): what to do with a host's software list. docs: (host_id, software_updated_at, n_software).

    skip: the stored stamp is the same and the host has edges; clear: an empty list with a moved stamp; keep: an empty
    list without a move; write: all others. The stamp is <software_updated_at>|<identity version>.
    """
    stamp = F.concat(F.coalesce("software_updated_at", F.lit("")), F.lit(f"|{identity_version}"))
    have = edges.select("host_id").distinct().withColumn("has_edges", F.lit(True))
    j = docs.withColumn("stamp", stamp).join(state.select("host_id", "software_synced"), "host_id", "left").join(have, "host_id", "left")
    same = F.coalesce(F.col("software_synced") == F.col("stamp"), F.lit(False))
    empty = F.coalesce("n_software", F.lit(0)) == 0
    action = F.when(same & F.coalesce("has_edges", F.lit(False)), "skip").when(empty & same, "keep").when(empty & F.col("software_updated_at").isNull(), "keep").when(empty, "clear").otherwise("write")
    return j.select("host_id", "stamp", action.alias("action"))


def delta_hosts(docs: DataFrame, watermarks: DataFrame, since: str | None = None) -> DataFrame:
    """Documents newer than the later of the global and their team's watermark; those without updated_at always.
    watermarks: (team_id, watermark), one row a team."""
    floor = F.greatest(F.coalesce("watermark", F.lit("1970-01-01").cast("timestamp")), F.lit(since or "1970-01-01").cast("timestamp"))
    return docs.join(watermarks, "team_id", "left").where(F.col("updated_at").isNull() | (F.col("updated_at") > floor)).select(docs.columns)


def next_watermark(now: str, failures: int, current: str | None) -> str | None:
    """Now minus the clock skew; the current one if anything failed."""
    from datetime import datetime, timedelta

    return current if failures else (datetime.fromisoformat(now) - timedelta(minutes=SKEW_MINUTES)).isoformat(sep=" ")


def reap_stale_hosts(tables: dict[str, DataFrame], cutoff: str, teams: list[int] | None = None) -> dict[str, DataFrame]:
    """Tables without hosts last ingested before the cutoff (in the given teams; null is team 0), and without their edges."""
    stale = tables["hosts"].where(F.col("last_ingest") < F.lit(cutoff).cast("timestamp"))
    if teams is not None:
        stale = stale.where(F.coalesce("team_id", F.lit(0)).isin(teams))
    gone = stale.select("host_id")
    return {k: df.join(gone, "host_id", "left_anti") if "host_id" in df.columns else df for k, df in tables.items()}


def reap_unattached(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables without software, labels and users that no host has, then without hosts that have no edge at all."""
    hosts = tables["hosts"].select("host_id")
    edges = {k: tables[k].join(hosts, "host_id", "left_semi") for k in ("uses", "installed_on", "has_label")}
    out = tables | edges
    out["software"] = tables["software"].join(edges["installed_on"].select("name").distinct(), "name", "left_semi")
    out["labels"] = tables["labels"].join(edges["has_label"].select("label_id").distinct(), "label_id", "left_semi")
    out["users"] = tables["users"].join(edges["uses"].select("username").distinct(), "username", "left_semi")
    held = edges["uses"].select("host_id").unionByName(edges["installed_on"].select("host_id")).unionByName(edges["has_label"].select("host_id")).distinct()
    out["hosts"] = tables["hosts"].join(held, "host_id", "left_semi")
    return out


def reaped_counts(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(kind, removed) for software, labels, users, hosts."""
    parts = [before[k].agg(F.count("*").alias("b")).crossJoin(after[k].agg(F.count("*").alias("a"))).select(F.lit(k).alias("kind"), (F.col("b") - F.col("a")).alias("removed")) for k in ("software", "labels", "users", "hosts")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def orphan_members(members: DataFrame, hosts: DataFrame) -> DataFrame:
    """(label_id, orphans, shown, truncated): members without a host: how many distinct, the first 50 in order, whether there are more."""
    lost = members.select("label_id", "host_id").distinct().join(hosts.select("host_id"), "host_id", "left_anti")
    # ids are cut to the first 50 of each salted part before they meet
    part = lost.groupBy("label_id", F.pmod(F.xxhash64("host_id"), F.lit(64)).alias("salt")).agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_list("host_id")), 1, ORPHANS_SHOWN).alias("ids"))
    out = part.groupBy("label_id").agg(F.sum("n").alias("orphans"), F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, ORPHANS_SHOWN).alias("shown"))
    return out.withColumn("truncated", F.col("orphans") > ORPHANS_SHOWN)


def sync_label_membership(prior: DataFrame, current: DataFrame, hosts: DataFrame) -> DataFrame:
    """(label_id, host_id, change): edges to add and to remove. Labels without any row in `current` keep their edges;
    members without a host are left out."""
    now = current.select("label_id", "host_id").distinct().join(hosts.select("host_id"), "host_id", "left_semi").select("label_id", "host_id")
    was = prior.select("label_id", "host_id").distinct()
    added = now.join(was, ["label_id", "host_id"], "left_anti").withColumn("change", F.lit("add"))
    listed = current.select("label_id").distinct()
    removed = was.join(listed, "label_id", "left_semi").join(now, ["label_id", "host_id"], "left_anti").select("label_id", "host_id").withColumn("change", F.lit("remove"))
    return added.unionByName(removed)


def membership_summary(prior: DataFrame, current: DataFrame, hosts: DataFrame) -> DataFrame:
    """(label_id, added, removed, unchanged) for labels in prior or current."""
    change = sync_label_membership(prior, current, hosts).groupBy("label_id").agg(F.count_if(F.col("change") == "add").alias("added"), F.count_if(F.col("change") == "remove").alias("removed"))
    was = prior.select("label_id", "host_id").distinct().groupBy("label_id").agg(F.count("*").alias("n"))
    return was.join(change, "label_id", "full_outer").select("label_id", F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("removed", F.lit(0)).alias("removed"), (F.coalesce("n", F.lit(0)) - F.coalesce("removed", F.lit(0))).alias("unchanged"))


def label_member_hash(members: DataFrame) -> DataFrame:
    """(label_id, hash): SHA-256 of the sorted id list as compact JSON, repeats kept, null ids left out.

    A label's ids pass one task in order and are fed to the hash as they come; no list of them is ever held. Such a hash
    can only be computed from its start: `label_member_digest` is the form that is combined from parts."""
    ids = members.where(F.col("host_id").isNotNull()).select(F.col("label_id").cast("string").alias("label_id"), F.col("host_id").cast("string").alias("id"), "host_id")
    ordered = ids.repartition("label_id").sortWithinPartitions("label_id", "host_id").select("label_id", "id")
    hashed = ordered.mapInArrow(_digests, "label_id string, hash string")
    return hashed.select(F.col("label_id").cast(members.schema["label_id"].dataType).alias("label_id"), "hash")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label_id, hash) of rows (label_id, id) that stand in order."""
    now, digest, out = None, None, []

    def close() -> None:
        if digest is not None:
            digest.update(b"]")
            out.append((now, digest.hexdigest()))

    for batch in batches:
        labels, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        start = 0
        while start < len(ids):
            end = next((k for k in range(start, len(ids)) if labels[k] != labels[start]), len(ids))
            fresh = digest is None or labels[start] != now
            if fresh:
                close()
                now, digest = labels[start], hashlib.sha256(b"[")
            digest.update((("" if fresh else ",") + ",".join(ids[start:end])).encode())
            start = end
    close()
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in (0, 1)], ["label_id", "hash"])


def label_member_digest(members: DataFrame) -> DataFrame:
    """(label_id, members, digest): a count and the XOR of hashed ids; combined before the shuffle, nothing is gathered."""
    return members.groupBy("label_id").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("host_id")).alias("digest"))


def upsert_labels(state: DataFrame, batch: DataFrame) -> DataFrame:
    """MERGE by label_id."""
    return upsert(state, batch, ["label_id"])


def reap_stale_labels(labels: DataFrame, present: DataFrame, cutoff: str) -> DataFrame:
    """Labels but those that are absent from the payload and were last synced before the cutoff."""
    gone = labels.join(present.select("label_id"), "label_id", "left_anti").where(F.col("last_synced") < F.lit(cutoff).cast("timestamp")).select("label_id")
    return labels.join(gone, "label_id", "left_anti")
