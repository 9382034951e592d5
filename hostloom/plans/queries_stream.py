"""Queries of the streams that keep state, with their SQL: what they come to after all input."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostloom.functions.shared import settle
from hostloom.operators import host_titles, snapshot
from hostloom.plans.inventory import SQL, Inventory, inventory
from hostloom.plans.queries_core import flat
from hostloom.plans.queries_score import _scratch, _stream
from hostloom.plans.queries_state import ORACLE_SQL as STATE_SQL
from hostloom.plans.queries_state import STATES, host_documents, states
from hostloom.sources import readers
from hostloom.streaming import inventory_stream, inventory_tables, last_seen

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

FIRST, SECOND, STALE = "2001-01-01", "2002-01-01", "2000-01-01"


def installs_once(inv: Inventory) -> Inventory:
    """The inventory with its installs settled: queries that read them several times derive them once."""
    return replace(inv, installed_on=settle(inv.installed_on))


def _landed(inv: Inventory, edges: DataFrame, day: str) -> DataFrame:
    """Host documents over some installs, all fetched on one day."""
    own = Inventory(inv.hosts, inv.users, inv.software, inv.labels, inv.uses, edges, inv.has_label)
    return host_documents(own).withColumn("updated_at", F.lit(day).cast("timestamp")).withColumn("software_updated_at", F.lit(day))


def waves(inv: Inventory) -> tuple[DataFrame, DataFrame]:
    """Documents of all hosts over the first state, and later ones: of hosts with installs in the second state (those on
    Windows with another user), of chrome hosts with an emptied list, and outdated ones of rhel hosts."""
    a, b = states(inv)
    later = _landed(inv, b, SECOND)
    sent = later.where("size(software) > 0 OR platform = 'chrome'")
    sent = sent.withColumn("software", F.when(F.col("platform") == "chrome", F.slice("software", 1, 0)).otherwise(F.col("software")))
    sent = sent.withColumn("users", F.when(F.col("platform") == "windows", F.array(F.lit("renter"))).otherwise(F.col("users")))
    return _landed(inv, a, FIRST), sent.withColumn("updated_at", F.when(F.col("platform") == "rhel", F.lit(STALE).cast("timestamp")).otherwise(F.col("updated_at")))


def tagged(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables as rows of one form: (kind, k1, k2, v1, v2)."""
    day = lambda c: F.col(c).cast("date").cast("string")
    none = F.lit(None).cast("string")
    text = lambda c: F.col(c).cast("string")
    forms = {
        "hosts": (text("host_id"), none, F.col("hostname"), day("updated_at")),
        "users": (F.col("username"), none, F.col("email"), none),
        "uses": (F.col("username"), text("host_id"), none, none),
        "software": (F.col("name"), none, F.array_join(F.array_sort("versions"), "|"), F.concat_ws("|", "last_version", day("first_seen"), day("last_seen"))),
        "installed_on": (F.col("name"), text("host_id"), F.col("version"), F.concat_ws("|", day("first_seen"), day("last_seen"))),
    }
    out = None
    for kind, form in forms.items():
        rows = tables[kind].select(F.lit(kind).alias("kind"), *[c.alias(n) for c, n in zip(form, ("k1", "k2", "v1", "v2"), strict=True)])
        out = rows if out is None else out.unionByName(rows)
    return out


def str1_stream_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host documents that land in two waves, ingested in micro-batches; all tables after the last one."""
    inv, out = installs_once(inventory(spark, sf_dir)), _scratch(spark)
    for wave in waves(inv):
        wave.write.mode("append").json(f"{out}/landing")
        docs = readers.stream_host_documents(spark, f"{out}/landing")
        inventory_tables.stream_inventory(docs, f"{out}/state", f"{out}/checkpoint", inv.users.withColumn("fullname", F.lit(None).cast("string")), 8).awaitTermination()
    return flat(tagged(inventory_tables.inventory_tables(spark, f"{out}/state", 8)))


def str3_host_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that events come from: the last record of each, and whether it was a week old when the stream ended."""
    out = _scratch(spark)
    docs = _stream(spark, sf_dir, "events").select((F.col("event_id") % 700).alias("host_id"), F.concat(F.lit("host-"), "user_id").alias("hostname"), F.col("event_type").alias("platform"), F.col("ts").cast("timestamp").alias("updated_at"))
    last_seen.stream_host_last_seen(docs, f"{out}/state", f"{out}/checkpoint", buckets=8).awaitTermination()
    state = inventory_stream.host_state(spark, f"{out}/state", last_seen.COLUMNS)
    return state.select("host_id", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"), "stale")


def src1_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed host documents of which every tenth is cut off, has no id or has text for one: how many are read and how many
    lie in quarantine, by cause and by whether the record still names its host."""
    inv, out = inventory(spark, sf_dir), _scratch(spark)
    line = F.to_json(F.struct("*"))
    kind = F.col("id") % 10
    broken = F.when(kind == 0, F.substring(line, 1, 40)).when(kind == 1, F.regexp_replace(line, '"id":[0-9]+,', "")).when(kind == 2, F.regexp_replace(line, '"id":([0-9]+),', '"id":"no $1",')).otherwise(line)
    host_documents(inv).select(broken.alias("value")).write.text(f"{out}/landing")
    good = readers.read_host_documents(spark, f"{out}/landing").select(F.lit("read").alias("cause"), F.startswith("hostname", F.lit("host-")).alias("named"))
    bad = readers.quarantine(spark, f"{out}/landing").select("cause", F.col("record").contains('"hostname":"host-').alias("named"))
    return good.unionByName(bad).groupBy("cause", "named").agg(F.count("*").alias("n"))


def set2_diff_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots written with digests; their differences from the buckets that changed, and how many of these there are."""
    inv, out = inventory(spark, sf_dir), _scratch(spark)
    installs = settle(inv.installed_on.select("name", "host_id", "first_seen"))
    inv = replace(inv, installed_on=installs, hosts=settle(inv.hosts), uses=settle(inv.uses), has_label=settle(inv.has_label))
    a, b = states(inv)
    later = inv.hosts.withColumn("platform", F.when(F.col("host_id") % 100 == 0, "fedora").otherwise(F.col("platform")))
    for ts, hosts, edges in (("2001-01-01", inv.hosts, a), ("2001-02-01", later, b)):
        snapshot.write_snapshot(Inventory(hosts, inv.users, inv.software, inv.labels, inv.uses, edges, inv.has_label), ts, f"{out}/snapshots", 16)
    rows = snapshot.changed_rows(spark, f"{out}/snapshots", "2001-01-01", "2001-02-01")
    nodes = snapshot.diff_properties(*rows["nodes"]).select(F.lit("changed").alias("bucket"), "kind", F.col("id").alias("src"), F.concat_ws(" ", "prop", "old", "new").alias("dst"))
    edges = snapshot.diff_edges(*rows["edges"]).select("bucket", F.col("label").alias("kind"), "src", "dst")
    same = snapshot.changed_buckets(spark, f"{out}/snapshots", "2001-01-01", "2001-02-01").where("kind IN ('user', 'software', 'label', 'USES', 'HAS_LABEL')")
    return nodes.unionByName(edges).unionByName(same.select(F.lit("unexpected").alias("bucket"), "kind", F.lit("").alias("src"), F.lit("").alias("dst")))


def mrg6_bucketed_installs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch of mrg6 merged into a table that is bucketed by host."""
    inv, table = inventory(spark, sf_dir), f"hostloom_installs_{uuid.uuid4().hex}"
    a, b = states(inv)
    columns = ["name", "host_id", "version", "source", "extension_key", "first_seen", "last_seen"]
    host_titles.save_titles(host_titles.titles_by_host(a.select(columns)), table, 8)
    after = settle(host_titles.upsert_titles(spark.table(table), b.select(columns), b.select("host_id"), "2002-01-01"))
    spark.sql(f"DROP TABLE {table}")
    return flat(host_titles.edges_of(after).select("name", "host_id", "version", "first_seen", "last_seen"))


QUERIES |= {"mrg6_bucketed_installs": mrg6_bucketed_installs, "set2_diff_written": set2_diff_written, "str1_stream_inventory": str1_stream_inventory, "str3_host_last_seen": str3_host_last_seen, "src1_quarantine": src1_quarantine}

_WAVES = f"""{STATES}, sent AS (SELECT host_id, platform FROM hosts WHERE platform NOT IN ('rhel', 'chrome') AND host_id IN (SELECT host_id FROM eb)),
keyed AS (SELECT host_id, coalesce(extension_key, name) AS name, version FROM ea), later AS (SELECT host_id, coalesce(extension_key, name) AS name, version FROM eb SEMI JOIN sent USING (host_id)),
edges AS (SELECT name, host_id, version, '2001-01-01' AS first_seen, '2001-01-01' AS last_seen FROM keyed WHERE host_id NOT IN (SELECT host_id FROM sent) AND host_id IN (SELECT host_id FROM hosts WHERE platform <> 'chrome')
  UNION ALL SELECT l.name, l.host_id, l.version, CASE WHEN k.name IS NULL THEN '2002-01-01' ELSE '2001-01-01' END, '2002-01-01' FROM later l LEFT JOIN keyed k ON k.name = l.name AND k.host_id = l.host_id),
used AS (SELECT username, host_id FROM uses SEMI JOIN hosts USING (host_id) WHERE host_id NOT IN (SELECT host_id FROM sent WHERE platform = 'windows') UNION SELECT 'renter', host_id FROM sent WHERE platform = 'windows'),
every AS (SELECT name, version, 1 AS wave FROM keyed UNION ALL SELECT name, version, 2 FROM later)"""

ORACLE_SQL |= {
    "mrg6_bucketed_installs": STATE_SQL["mrg6_upsert_installs"],
    "str1_stream_inventory": f"""{SQL}{_WAVES}
SELECT 'hosts' AS kind, CAST(host_id AS VARCHAR) AS k1, NULL AS k2, hostname AS v1, CASE WHEN platform = 'chrome' OR host_id IN (SELECT host_id FROM sent) THEN '2002-01-01' ELSE '2001-01-01' END AS v2 FROM hosts
UNION ALL SELECT 'users', username, NULL, email, NULL FROM users WHERE username IN (SELECT username FROM uses SEMI JOIN hosts USING (host_id)) UNION ALL SELECT DISTINCT 'users', 'renter', NULL, NULL, NULL FROM used WHERE username = 'renter'
UNION ALL SELECT 'uses', username, CAST(host_id AS VARCHAR), NULL, NULL FROM used
UNION ALL SELECT 'software', name, NULL, string_agg(DISTINCT version, '|' ORDER BY version), arg_max(version, CAST(split_part(version, '.', 1) AS INTEGER) * 100000 + CAST(split_part(version, '.', 2) AS INTEGER)) || '|' || CASE min(wave) WHEN 1 THEN '2001-01-01' ELSE '2002-01-01' END || '|' || CASE max(wave) WHEN 1 THEN '2001-01-01' ELSE '2002-01-01' END FROM every GROUP BY name
UNION ALL SELECT 'installed_on', name, CAST(host_id AS VARCHAR), version, first_seen || '|' || last_seen FROM edges""",
    "str3_host_last_seen": """SELECT event_id % 700 AS host_id, strftime(date_trunc('second', max(ts)), '%Y-%m-%d %H:%M:%S') AS updated_at, max(ts) + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 5 MINUTE FROM events) AS stale FROM events GROUP BY 1""",
    "set2_diff_written": f"""{SQL}{STATES} SELECT 'changed' AS bucket, 'host' AS kind, 'host_' || host_id AS src, 'platform ' || platform || ' fedora' AS dst FROM hosts WHERE host_id % 100 = 0
UNION ALL SELECT CASE WHEN ea.name IS NULL THEN 'added' ELSE 'removed' END, 'INSTALLED_ON', 'software_' || coalesce(ea.name, eb.name), 'host_' || coalesce(ea.host_id, eb.host_id)
  FROM (SELECT name, host_id FROM ea SEMI JOIN hosts USING (host_id)) ea FULL JOIN (SELECT name, host_id FROM eb SEMI JOIN hosts USING (host_id)) eb ON ea.name = eb.name AND ea.host_id = eb.host_id WHERE ea.name IS NULL OR eb.name IS NULL""",
    "src1_quarantine": f"""{SQL} SELECT CASE host_id % 10 WHEN 0 THEN 'malformed' WHEN 1 THEN 'no id' WHEN 2 THEN 'malformed' ELSE 'read' END AS cause, host_id % 10 <> 0 AS named, count(*) AS n FROM hosts GROUP BY 1, 2""",
}
