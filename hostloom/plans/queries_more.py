"""Queries of scalar functions, readers' rules and the remaining operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostloom.functions import values
from hostloom.operators import categorize, ingest, score, snapshot
from hostloom.plans.inventory import SQL, inventory
from hostloom.plans.queries_core import approved, flat
from hostloom.plans.queries_score import listings
from hostloom.plans.queries_state import host_documents
from hostloom.sources import readers
from hostloom.streaming import inventory_stream

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: flat(f(inventory(spark, sf_dir)))
        if sql:
            ORACLE_SQL[key] = SQL + sql
        return f

    return register


_V = "CAST(split_part({0}, '.', 1) AS BIGINT) * 1000 + CAST(split_part({0}, '.', 2) AS BIGINT)"


@query(f" SELECT name, version, dense_rank() OVER (PARTITION BY name ORDER BY {_V.format('version')}) AS place FROM (SELECT DISTINCT name, version FROM installed_on)")
def fn1_version_order(inv):
    from pyspark.sql import Window

    distinct = inv.installed_on.select("name", "version").distinct().withColumn("k", values.version_sort_key(F.col("version")))
    return distinct.select("name", "version", F.dense_rank().over(Window.partitionBy("name").orderBy("k")).alias("place"))


@query(f" SELECT name, host_id, sign({_V.format('version')} - 3020) AS side FROM installed_on")
def fn2_compare_versions(inv):
    return inv.installed_on.select("name", "host_id", values.compare_versions(F.col("version"), F.lit("3.20.0")).alias("side"))


@query(" SELECT name, regexp_matches(name, '(^|[^a-z0-9])(slack|new|mega)($|[^a-z0-9])') AS hit FROM software")
def fn3_word_match(inv):
    return inv.software.select("name", values.word_match(F.col("name"), ("slack", "new", "mega")).alias("hit"))


@query(" SELECT 'software_' || name AS id, 'software' AS kind, name AS \"key\" FROM software UNION ALL SELECT 'host_' || host_id, 'host', CAST(host_id AS VARCHAR) FROM hosts")
def fn4_typed_ids(inv):
    ids = inv.software.select(values.typed_id("software", F.col("name")).alias("id")).unionByName(inv.hosts.select(values.typed_id("host", F.col("host_id")).alias("id")))
    kind, key = values.split_typed_id(F.col("id"))
    return ids.select("id", kind.alias("kind"), key.alias("key"))


@query(" SELECT host_id, CASE platform WHEN 'darwin' THEN 'darwin' WHEN 'windows' THEN 'windows' WHEN 'chrome' THEN 'none' ELSE 'linux' END AS os FROM hosts")
def fn5_script_os(inv):
    return inv.hosts.select("host_id", values.script_os(F.col("platform")).alias("os"))


@query(" SELECT name, store IS NOT NULL AS supported, coalesce(store = 'chrome', false) AS on_windows FROM software")
def fn6_removal_support(inv):
    return inv.software.select("name", values.removal_supported(F.col("store"), F.col("extension_id")).alias("supported"), values.can_block(F.lit("windows"), F.col("store")).alias("on_windows"))


@query(" SELECT username, email, sha256('[{\"key\":\"email\",\"value\":\"' || email || '\"},{\"key\":\"username\",\"value\":\"' || username || '\"}]') AS hash FROM users")
def set1_node_hash(inv):
    marked = inv.users.withColumn("last_seen", F.rand().cast("string"))  # a noisy property, which the hash leaves out
    return marked.select("username", "email", snapshot.node_hash(snapshot.props_of(marked, ())).alias("hash"))


@query(" SELECT kind, count(*) AS n FROM (SELECT 'host' AS kind FROM hosts UNION ALL SELECT 'user' FROM users UNION ALL SELECT 'software' FROM software UNION ALL SELECT 'label' FROM inv_labels) GROUP BY kind")
def snk1_snapshot_nodes(inv):
    return snapshot.snapshot_nodes(inv, "2001-01-01 00:00:00").groupBy("kind").agg(F.count_distinct("id").alias("n"))


@query(" SELECT hosts.host_id, string_agg(username, '; ' ORDER BY username) AS affected_users, count(*) AS user_count FROM hosts JOIN uses USING (host_id) GROUP BY 1")
def snk4_export_rows(inv):
    lists = inv.uses.join(inv.hosts, "host_id", "left_semi").groupBy("host_id").agg(F.array_sort(F.collect_list("username")).alias("affected_users"))
    return snapshot.export_rows(lists).withColumn("user_count", F.col("user_count").cast("long"))


@query(" SELECT name AS username, name || '@x.org' AS email, display_name AS fullname FROM (SELECT CASE WHEN length(username) % 2 = 0 THEN username ELSE email END AS name, username AS display_name FROM users)")
def src2_users(inv):
    even = F.length("username") % 2 == 0
    key = values.first_filled(F.when(even, F.col("username")).otherwise(F.lit(" ")), F.col("email"))
    return inv.users.select(key.alias("username"), F.concat(key, F.lit("@x.org")).alias("email"), F.col("username").alias("fullname"))


@query(" SELECT translate(md5(name), '0123456789abcdef', 'abcdefghijklmnop') AS id, CASE WHEN p_size % 2 = 0 THEN 'Malware' ELSE 'listed by threat feed' END AS reason FROM software")
def src4_feed_rows(inv):
    letters = F.translate(F.md5(F.col("name").cast("binary")), "0123456789abcdef", "abcdefghijklmnop")
    row = lambda n, i, reason: inv.software.select(F.lit(n).cast("long").alias("row"), i.alias("id"), reason.alias("reason"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("date"))
    said = F.when(F.col("p_size") % 2 == 0, "Malware")
    raw = row(1, F.upper(letters), F.lit("older")).unionByName(row(2, letters, said)).unionByName(row(3, F.col("name"), said))
    return readers.feed_rows(raw, "f", "chromium").select("id", "reason")


@query(" SELECT extension_id AS guid, 'w' AS why, 2 AS n FROM software WHERE store = 'firefox'")
def src5_blocklist(inv):
    r = inv.software.where("store = 'firefox'").select(F.col("extension_id").alias("guid"), F.lit("w").alias("why"), F.array(F.struct(F.lit("0").alias("minVersion"), F.lit("*").alias("maxVersion"))).alias("versionRange"))
    return readers.blocklist(r.unionByName(r)).select("guid", "why", F.size("ranges").alias("n"))


@query(" SELECT name, 'safari' AS kind, upper(substr(md5(name), 1, 10)) AS id FROM software WHERE p_size % 3 <> 0")
def src6_publishers(inv):
    team = F.array(F.upper(F.substring(F.md5(F.col("name").cast("binary")), 1, 10)), F.when(F.col("p_size") % 3 == 0, "short"))
    none = F.lit(None).cast("array<string>")
    e = inv.software.select("name", none.alias("match_names"), F.lit("2024-01-01").alias("added_at"), none.alias("chrome_publisher_ids"), none.alias("amo_author_ids"), none.alias("edge_extension_ids"), F.filter(team, lambda x: x.isNotNull()).alias("apple_team_ids"))
    return readers.publishers(e)


@query(" SELECT name AS entry FROM software WHERE vendor = 'Brand#11'")
def src7_whitelist(inv):
    raw = approved(inv).select(F.concat(F.lit(" "), F.upper("entry")).alias("entry"))
    return raw.unionByName(raw).select(F.lower(F.trim("entry")).alias("entry")).where("entry <> ''").distinct()


@query(" SELECT host_id, 'ext:safari:site.w/x.appex@' || CASE WHEN team_id % 2 = 0 THEN 'team1' ELSE 'unsigned' END AS extension_key, 'W › Wipr' AS display_name FROM hosts")
def ing5_safari_apps(inv):
    none = F.lit(None).cast("string")
    signed = F.array(F.struct(F.lit("/Applications/W.app").alias("installed_path"), F.when(F.col("team_id") % 2 == 0, "TEAM1").alias("team_identifier")))
    base = lambda name, source, path, bundle, sign: inv.hosts.select("host_id", F.lit(name).alias("name"), F.lit(name).alias("display_name"), F.lit(source).alias("source"), none.alias("extension_id"), none.alias("browser"), none.alias("extension_for"), F.array(F.lit(path)).alias("installed_paths"), F.lit(bundle).cast("string").alias("bundle_identifier"), sign.alias("signature_information"))
    rows = base("W", "apps", "/Applications/W.app", "site.w", signed).unionByName(base("Wipr", "safari_extensions", "/Applications/W.app/Contents/PlugIns/X.appex", None, signed))
    return ingest.bind_safari_apps(ingest.extension_identity(rows)).where("source = 'safari_extensions'").select("host_id", "extension_key", "display_name")


_MANIFEST = ", l AS (SELECT extension_id, p_size AS s FROM software WHERE store IS NOT NULL)"


@query(_MANIFEST + """ SELECT extension_id, CASE WHEN s % 2 = 0 THEN 'cookies|storage' ELSE 'tabs|debugger|https://a/*' END AS permissions, CASE WHEN s % 4 = 0 THEN 'https://x/*' ELSE '' END AS content_script_matches,
CASE WHEN s % 10 = 0 THEN 'default-src ''none''; script-src ''self'' ''unsafe-eval''' WHEN s % 7 = 0 THEN 'script-src https://cdn.example.org' END AS content_security_policy, 2 + s % 2 AS manifest_version FROM l""")
def s1_manifest_fields(inv):
    l = listings(inv)  # noqa: E741
    csp = F.when(F.col("p_size") % 2 == 0, F.to_json(F.struct(F.col("content_security_policy").alias("extension_pages")))).otherwise(F.col("content_security_policy"))
    json = F.to_json(F.struct("permissions", "optional_permissions", "host_permissions", F.array(F.struct(F.col("content_script_matches").alias("matches"))).alias("content_scripts"), csp.alias("content_security_policy"), "manifest_version"))
    m = score.manifest_fields(json)
    return l.select("extension_id", m["permissions"].alias("permissions"), m["content_script_matches"].alias("content_script_matches"), F.nullif(m["content_security_policy"], F.lit("")).alias("content_security_policy"), m["manifest_version"].alias("manifest_version"))


@query(_MANIFEST + """ SELECT extension_id, CASE WHEN s % 2 = 0 THEN 'cookies|storage' ELSE 'debugger|tabs' END AS perms, concat_ws('|', CASE WHEN s % 3 = 0 THEN '<all_urls>' END, CASE WHEN s % 2 = 1 THEN 'https://a/*' END) AS hosts,
CASE WHEN s % 2 = 0 THEN 'history|proxy' ELSE 'cookies|history|proxy' END AS optional FROM l""")
def s2_permission_sets(inv):
    return score.permission_sets(listings(inv)).select("extension_id", "perms", "hosts", "optional")


@query(" SELECT name, p_size % 2 = 0 AS gate FROM software")
def cat3_software_gate(inv):
    return inv.software.select("name", categorize.software_gate(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Free Plug-In for "), "vendor")).otherwise(F.concat(F.lit("a toolbox by the river "), "vendor"))).alias("gate"))


@query(" SELECT name, 'Made by Dr. ' || vendor || ' Inc.' AS sentence FROM software")
def cat5_first_sentence(inv):
    return inv.software.select("name", F.concat(F.lit("Made  by Dr. "), "vendor", F.lit(" Inc. It sells. More.")).alias("t")).select("name", categorize.first_sentence("t").alias("sentence"))


def win2_recent_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("cycle"), F.col("o_orderdate").alias("started_at"))
    return flat(readers.newest_cycles(orders, 100))


def str2_stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events sent twice, deduplicated by a stream within its watermark."""
    from hostloom.plans.queries_score import _scratch, _stream

    out = _scratch(spark)
    docs = _stream(spark, sf_dir, "events").select(F.col("event_id").alias("host_id"), F.lit("h").alias("hostname"), F.col("event_type").alias("platform"), F.col("ts").cast("timestamp").alias("updated_at"))
    twice = docs.select(F.explode(F.array(F.struct("*"), F.struct("*"))).alias("d")).select("d.*")
    inventory_stream.stream_dedupe(twice).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return flat(spark.read.parquet(f"{out}/rows").select("host_id", "platform", "updated_at"))


QUERIES |= {"win2_recent_cycles": win2_recent_cycles, "str2_stream_dedupe": str2_stream_dedupe}
ORACLE_SQL |= {"win2_recent_cycles": "SELECT o_orderkey AS cycle, CAST(o_orderdate AS DATE) AS started_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100", "str2_stream_dedupe": "SELECT event_id AS host_id, event_type AS platform, CAST(ts AS DATE) AS updated_at FROM events"}


@query(" SELECT host_id AS id, hostname, len AS n FROM hosts JOIN (SELECT hosts.host_id, count(name) AS len FROM hosts LEFT JOIN installed_on USING (host_id) GROUP BY 1) USING (host_id)")
def src1_host_documents(inv):
    return host_documents(inv).select("id", "hostname", F.coalesce(F.size("software"), F.lit(0)).alias("n"))


@query(" SELECT label_id, name, 'regular' AS label_type FROM inv_labels WHERE name <> '5-LOW'")
def src3_labels(inv):
    raw = inv.labels.select(F.col("label_id").alias("id"), F.when(F.col("name") == "5-LOW", "All Hosts").otherwise(F.col("name")).alias("name"), F.lit(None).cast("string").alias("description"), F.lit(" Regular").alias("label_type"), F.lit(None).cast("string").alias("label_membership_type"), F.lit(None).cast("string").alias("query"), F.lit(0).cast("long").alias("host_count"))
    return readers.labels(raw).select("label_id", "name", "label_type")
