"""Continuous ingest of nested host documents: hosts, users, software and edges move together, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hostloom.operators import ingest, merge
from hostloom.streaming.state_tables import StateTables

TABLES = {
    "hosts": ("host_id bigint, hostname string, platform string, team_id bigint, updated_at timestamp, last_ingest timestamp, software_synced string", "host_id"),
    "users": ("username string, email string, fullname string", "username"),
    "uses": ("username string, host_id bigint", "host_id"),
    "software": ("name string, versions array<string>, sources array<string>, first_version string, last_version string, first_seen timestamp, last_seen timestamp, display_name string, is_builtin boolean, app_team_id string", "name"),
    "installed_on": ("name string, host_id bigint, version string, source string, extension_key string, first_seen timestamp, last_seen timestamp", "host_id"),
}


def state_tables(spark: SparkSession, path: str, buckets: int = 64) -> StateTables:
    return StateTables(spark, path, TABLES, buckets)


def inventory_tables(spark: SparkSession, path: str, buckets: int = 64) -> dict[str, DataFrame]:
    """hosts, users, uses, software, installed_on as of the last committed batch."""
    return state_tables(spark, path, buckets).current()


def newest_documents(docs: DataFrame) -> DataFrame:
    """One document per id: the greatest updated_at (null is least), then the greatest content by hash, so that reruns agree."""
    whole = F.struct(*docs.columns)
    content = [F.xxhash64(F.lit(seed), *docs.columns) for seed in (1, 2)]
    return docs.groupBy("id").agg(F.max_by(whole, F.struct("updated_at", *content)).alias("d")).select("d.*")


def merge_documents(path: str, known_users: DataFrame | None = None, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step over named host documents (readers.named_hosts).

    Of a host the newest document counts, within a batch and against the stored row; one without updated_at always does.
    Software lists follow `hosts_needing_software`: unmoved ones are skipped, emptied ones clear the host's edges. Seen
    times are the batch's greatest updated_at, so a batch that runs again writes what it wrote before. `known_users`
    (username, email, fullname) has the attributes of users. Only buckets that the batch's hosts, users and titles fall
    into are read and written.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        tables = state_tables(batch.sparkSession, path, buckets)
        done = [b for b in tables.committed() if b <= batch_id]
        if batch_id in done or batch.isEmpty():
            return
        base = tables.manifest(done[-1] if done else None)
        docs = newest_documents(batch).persist()
        written = {}

        here = tables.touched("hosts", docs.select(F.col("id").alias("host_id")))
        old_hosts = tables.read("hosts", base, here)
        stored = old_hosts.select(F.col("host_id").alias("id"), F.col("updated_at").alias("_stored"))
        # what is held of the documents that count is narrow; their lists are read from `docs` where they are unfolded
        n_software = F.coalesce(F.size("software"), F.lit(0)).alias("n_software")
        heads = docs.select("id", "hostname", "platform", "team_id", "updated_at", "software_updated_at", n_software)
        taken = heads.join(stored, "id", "left").where(F.col("updated_at").isNull() | F.col("_stored").isNull() | (F.col("updated_at") > F.col("_stored"))).drop("_stored").persist()
        seen_at = taken.agg(F.date_format(F.max("updated_at"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0] or "1970-01-01 00:00:00"

        old_edges = tables.read("installed_on", base, here)
        lists = taken.select(F.col("id").alias("host_id"), "software_updated_at", "n_software")
        action = merge.hosts_needing_software(lists, old_hosts, old_edges).persist()
        moved = action.where("action IN ('write', 'clear')").select("host_id")
        rows = ingest.explode_software(docs.select("id", "software").join(action.where("action = 'write'").select(F.col("host_id").alias("id")), "id", "left_semi"))
        kind = F.when(F.col("store").isNotNull(), "extension").alias("kind")
        rows = rows.select(F.col("key").alias("name"), "host_id", "version", "source", "extension_key", "display_name", kind, "is_builtin", "app_team_id").persist()
        edges = merge.upsert_installed_on(old_edges, rows.select("name", "host_id", "version", "source", "extension_key"), moved, seen_at)
        written["installed_on"] = tables.write("installed_on", edges, batch_id, here)

        titles = tables.touched("software", rows)
        batch_titles = rows.select("name", "version", "source", "display_name", "kind", "is_builtin", "app_team_id")
        written["software"] = tables.write("software", merge.upsert_software(tables.read("software", base, titles), batch_titles, seen_at), batch_id, titles)

        named = ingest.host_user_identifiers(docs.select("id", "users", "primary_user", "owner").join(taken.select("id"), "id", "left_semi")).persist()
        written["uses"] = tables.write("uses", merge.prune_stale_uses(tables.read("uses", base, here), named), batch_id, here)
        names = named.select(F.explode("users").alias("username")).distinct()
        people = tables.touched("users", names)
        if known_users is None:
            found = names.select("username", *[F.lit(None).cast("string").alias(c) for c in ("email", "fullname")])
        else:
            found = ingest.known_users(names, known_users.select("username", "email", "fullname"))
        written["users"] = tables.write("users", merge.upsert_users(tables.read("users", base, people), found), batch_id, people)

        synced = action.select(F.col("host_id").alias("id"), F.when(F.col("action") != "keep", F.col("stamp")).alias("software_synced"))
        columns = ["host_id", "hostname", "platform", "team_id", "updated_at", "last_ingest", "software_synced"]
        new_hosts = taken.join(synced, "id").select(F.col("id").alias("host_id"), "hostname", "platform", "team_id", "updated_at", F.lit(seen_at).cast("timestamp").alias("last_ingest"), "software_synced")
        keep = old_hosts.select("host_id", F.col("updated_at").alias("_at"), F.col("software_synced").alias("_synced"))
        new_hosts = new_hosts.join(keep, "host_id", "left").withColumns({"updated_at": F.coalesce("updated_at", "_at"), "software_synced": F.coalesce("software_synced", "_synced")}).select(columns)
        written["hosts"] = tables.write("hosts", merge.upsert_hosts(old_hosts, new_hosts), batch_id, here)

        tables.commit(batch_id, base, written)
        for df in (docs, taken, action, rows, named):
            df.unpersist()

    return step


def stream_inventory(docs: DataFrame, path: str, checkpoint: str, known_users: DataFrame | None = None, buckets: int = 64) -> StreamingQuery:
    """Starts the ingest of a stream of named host documents into the tables under `path`; available input is processed,
    then the query ends. A failed batch neither advances the checkpoint nor changes any table."""
    return docs.writeStream.foreachBatch(merge_documents(path, known_users, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
