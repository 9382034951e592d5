"""Queries of ingest, merges and snapshots, with their SQL. Host documents are folded from the inventory's edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.operators import ingest, merge, snapshot
from hostloom.plans.inventory import SNAPSHOT_A, SNAPSHOT_B, SQL, Inventory, inventory
from hostloom.plans.queries_core import flat
from hostloom.sources.readers import named_hosts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
GONE = "Brand#23"  # the vendor whose titles are gone from the second state


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: flat(f(inventory(spark, sf_dir)))
        if sql:
            ORACLE_SQL[key] = SQL + STATES + sql
        return f

    return register


STATES = f""", ea AS (SELECT * FROM installed_on WHERE first_seen < DATE '{SNAPSHOT_A}'), eb AS (SELECT i.* FROM installed_on i JOIN software s USING (name) WHERE first_seen < DATE '{SNAPSHOT_B}' AND vendor <> '{GONE}')"""


def states(inv: Inventory) -> tuple[DataFrame, DataFrame]:
    """Installs as of two dates; the second lacks a vendor's titles."""
    kept = inv.software.where(F.col("vendor") != GONE).select("name")
    return inv.installed_on.where(F.col("first_seen") < F.lit(SNAPSHOT_A).cast("date")), inv.installed_on.where(F.col("first_seen") < F.lit(SNAPSHOT_B).cast("date")).join(kept, "name", "left_semi")


def host_documents(inv: Inventory) -> DataFrame:
    """Nested documents, one per host: users as JSON objects or bare text by turns, software as a list (at most a host's titles)."""
    software = inv.installed_on.join(inv.software.select("name", "display_name", "extension_id", "vendor"), "name").groupBy("host_id").agg(
        F.array_sort(F.collect_list(F.struct(F.upper("name").alias("name"), "version", "source", "display_name", "extension_id", "vendor"))).alias("software"))
    users = inv.uses.groupBy("host_id").agg(F.array_sort(F.collect_list(F.when(F.length("username") % 2 == 0, F.to_json(F.struct("username"))).otherwise(F.col("username")))).alias("users"))
    none = F.lit(None).cast("string")
    docs = inv.hosts.join(software, "host_id", "left").join(users, "host_id", "left")
    full = lambda s: F.transform("software", lambda x: F.struct(x["name"].alias("name"), x["version"].alias("version"), x["source"].alias("source"), x["display_name"].alias("display_name"), none.alias("bundle_identifier"), x["extension_id"].alias("extension_id"), none.alias("browser"), none.alias("extension_for"), x["vendor"].alias("vendor"), F.array().cast("array<string>").alias("installed_paths"), F.array().cast("array<struct<installed_path:string,team_identifier:string>>").alias("signature_information")))
    return named_hosts(docs.select(F.col("host_id").alias("id"), none.alias("computer_name"), F.lit(" ").alias("display_name"), "hostname", "platform", "team_id", F.col("last_seen").alias("updated_at"), none.alias("primary_user"), none.alias("owner"), "users", full(None).alias("software")))


@query(" SELECT host_id AS id, hostname FROM hosts")
def src1_named_hosts(inv):
    return host_documents(inv).select("id", "hostname")


@query(" SELECT host_id, coalesce((SELECT string_agg(username, '|' ORDER BY username) FROM uses u WHERE u.host_id = hosts.host_id), NULL) AS users FROM hosts")
def ing1_host_users(inv):
    return ingest.host_user_identifiers(host_documents(inv)).withColumn("users", F.array_sort("users"))


@query(" SELECT DISTINCT username, host_id FROM uses SEMI JOIN hosts USING (host_id)")
def ing2_uses_edges(inv):
    return ingest.uses_edges(host_documents(inv))


@query(" SELECT i.host_id, name, version, source, store, extension_id, i.extension_key FROM installed_on i JOIN (SELECT name, store, extension_id FROM software) USING (name) SEMI JOIN hosts USING (host_id)")
def ing3_software_rows(inv):
    return ingest.explode_software(host_documents(inv)).select("host_id", "name", "version", "source", "store", "extension_id", "extension_key")


@query(" SELECT upper(substr(name, 1, 1)) || substr(name, 2) AS name, store, extension_id, extension_key FROM software WHERE store IS NOT NULL")
def ing4_extension_identity(inv):
    rows = inv.software.select("name", "source", "display_name", "extension_id").withColumns({c: F.lit(None).cast("string") for c in ("browser", "extension_for")}).withColumn("installed_paths", F.array().cast("array<string>"))
    return ingest.extension_identity(rows).where("store IS NOT NULL").select(F.concat(F.upper(F.substring("name", 1, 1)), F.substring("name", 2, 500)).alias("name"), "store", "extension_id", "extension_key")


@query(" SELECT name, store IN ('chrome') AND p_size > 40 OR store = 'firefox' AND p_size > 40 AS is_builtin FROM software WHERE store IS NOT NULL")
def ing6_builtins(inv):
    paths = F.array(F.when(F.col("p_size") > 40, F.when(F.col("store") == "chrome", F.lit("C:\\Program Files\\Google\\Chrome\\Application\\120.0\\x")).otherwise(F.lit("/Applications/Firefox.app/Contents/Resources/browser/features/a.xpi"))).otherwise(F.lit("C:\\Users\\a\\Desktop\\Google\\Chrome\\Application\\x")))
    return inv.software.where("store IS NOT NULL").select("name", ingest.is_builtin(F.col("store"), F.col("extension_id"), paths).alias("is_builtin"))


@query(" SELECT name, CAST(2 AS BIGINT) AS vulnerability_count, greatest(p_size / 5.0, 5.1) AS max_cvss FROM software")
def ing7_vulnerabilities(inv):
    none = F.lit(None).cast("double")
    v = F.array(*[F.struct(F.lit("CVE-1").alias("cve"), F.lit(None).cast("string").alias("cve_id"), a.alias("cvss_score"), b.alias("cvss"), none.alias("cvss_v3_score"), none.alias("epss_probability")) for a, b in ((F.col("p_size") / 5.0, none), (none, F.lit(5.1)))])
    s = ingest.summarize_vulnerabilities(v)
    return inv.software.select("name", s["vulnerability_count"].alias("vulnerability_count"), s["max_cvss"].alias("max_cvss"))


@query(" SELECT name, host_id, version, CAST(first_seen AS DATE) AS first_seen, CAST(last_seen AS DATE) AS last_seen FROM installed_on")
def ing8_case_variants(inv):
    upper = inv.installed_on.withColumn("name", F.initcap("name"))
    titles = inv.software.select("name", "display_name", F.array("vendor").alias("versions"), "sources")
    return ingest.merge_case_variants(titles.unionByName(titles.withColumn("name", F.initcap("name"))), inv.installed_on.unionByName(upper))[1]


@query(" SELECT extension_key AS name, host_id, version, CAST(first_seen AS DATE) AS first_seen, CAST(last_seen AS DATE) AS last_seen FROM installed_on WHERE extension_key IS NOT NULL")
def ing9_extension_keys(inv):
    return ingest.merge_extension_keys(inv.software, inv.installed_on.unionByName(inv.installed_on.withColumn("name", F.concat(F.lit("/"), "name"))))[1]


@query(" SELECT count(*) AS pairs, count(*) AS extras FROM ea SEMI JOIN hosts USING (host_id)")
def ing10_dedupe_edges(inv):
    a, _ = states(inv)
    return ingest.dedupe_edges(a.unionByName(a), inv.hosts)[1]


@query(" SELECT host_id, CASE WHEN count(*) OVER (PARTITION BY hostname) > 1 THEN hostname || ' #' || host_id ELSE hostname END AS display_name FROM hosts")
def ing11_display_names(inv):
    return ingest.display_names(inv.hosts).select("host_id", "display_name")


@query(" SELECT host_id, 'moved-' || hostname AS hostname, platform, CAST(NULL AS DATE) AS last_seen FROM hosts WHERE platform = 'windows' UNION ALL SELECT host_id, hostname, platform, CAST(last_seen AS DATE) FROM hosts WHERE platform <> 'windows'")
def mrg1_upsert_hosts(inv):
    state = inv.hosts.select("host_id", "hostname", "platform", "last_seen")
    moved = state.where("platform = 'windows'").withColumn("hostname", F.concat(F.lit("moved-"), "hostname")).withColumn("last_seen", F.lit(None).cast("timestamp"))
    return merge.upsert_hosts(state, moved)


@query(" SELECT username, CASE WHEN length(username) > 6 THEN 'new' ELSE email END AS email FROM users")
def mrg2_upsert_users(inv):
    return merge.upsert_users(inv.users, inv.users.where(F.length("username") > 6).withColumn("email", F.lit("new")))


@query(""" SELECT DISTINCT username, host_id FROM uses WHERE host_id NOT IN (SELECT host_id FROM hosts WHERE platform = 'windows') UNION SELECT 'renter', host_id FROM hosts WHERE platform = 'windows'""")
def mrg3_prune_uses(inv):
    sent = inv.hosts.select("host_id", F.when(F.col("platform") == "windows", F.array(F.lit("renter"))).alias("users"))
    return merge.prune_stale_uses(inv.uses, sent)


@query(""", sa AS (SELECT name, list_sort(list(DISTINCT version)) AS v FROM ea GROUP BY name), sb AS (SELECT name, list_sort(list(DISTINCT version)) AS v, any_value(source) AS source FROM eb GROUP BY name)
SELECT name, array_to_string(coalesce(sa.v, []) || list_filter(coalesce(sb.v, []), lambda x: NOT list_contains(coalesce(sa.v, []), x)), '|') AS versions, coalesce(sa.v[1], sb.v[1]) AS first_version,
CASE WHEN sa.name IS NULL THEN DATE '2002-01-01' ELSE DATE '2001-01-01' END AS first_seen, CASE WHEN sb.name IS NULL THEN DATE '2001-01-01' ELSE DATE '2002-01-01' END AS last_seen FROM sa FULL JOIN sb USING (name)""")
def mrg4_upsert_software(inv):
    a, b = states(inv)
    none = lambda t: F.lit(None).cast(t)
    empty = a.limit(0).select("name", F.array("version").alias("versions"), F.array("source").alias("sources"), none("string").alias("first_version"), none("string").alias("last_version"), none("timestamp").alias("first_seen"), none("timestamp").alias("last_seen"), none("string").alias("display_name"), none("boolean").alias("is_builtin"), none("string").alias("app_team_id"))
    batch = lambda df: df.select("name", "version", "source", none("string").alias("display_name"), none("string").alias("kind"), none("boolean").alias("is_builtin"), none("string").alias("app_team_id"))
    state = merge.upsert_software(empty, batch(a), "2001-01-01")
    return merge.upsert_software(state, batch(b), "2002-01-01").select("name", "versions", "first_version", "first_seen", "last_seen")


@query(" SELECT name, arg_max(version, CAST(split_part(version, '.', 1) AS INTEGER) * 100000 + CAST(split_part(version, '.', 2) AS INTEGER)) AS last_version FROM installed_on GROUP BY name")
def mrg5_latest_version(inv):
    return merge.latest_version(inv.installed_on)


@query(""", hb AS (SELECT DISTINCT host_id FROM eb) SELECT name, host_id, version, CAST(first_seen AS DATE) AS first_seen, CAST(last_seen AS DATE) AS last_seen FROM ea ANTI JOIN hb USING (host_id)
UNION ALL SELECT eb.name, eb.host_id, eb.version, CASE WHEN ea.name IS NULL THEN DATE '2002-01-01' ELSE CAST(ea.first_seen AS DATE) END, DATE '2002-01-01' FROM eb LEFT JOIN ea ON ea.name = eb.name AND ea.host_id = eb.host_id""")
def mrg6_upsert_installs(inv):
    a, b = states(inv)
    columns = ["name", "host_id", "version", "source", "extension_key", "first_seen", "last_seen"]
    return merge.upsert_installed_on(a.select(columns), b.select(columns), b.select("host_id"), "2002-01-01").select("name", "host_id", "version", "first_seen", "last_seen")


@query(""" SELECT h.host_id, last_seen || '|1' AS stamp, CASE WHEN platform = 'windows' AND n > 0 THEN 'skip' WHEN n = 0 AND platform = 'windows' THEN 'keep' WHEN n = 0 AND last_seen IS NULL THEN 'keep' WHEN n = 0 THEN 'clear' ELSE 'write' END AS action
FROM (SELECT host_id, platform, coalesce(CAST(CAST(last_seen AS DATE) AS VARCHAR), '') AS last_seen0, CAST(CAST(last_seen AS DATE) AS VARCHAR) AS last_seen1 FROM hosts) h JOIN (SELECT host_id, coalesce(CAST(CAST(last_seen AS DATE) AS VARCHAR), '') AS last_seen FROM hosts) USING (host_id) JOIN (SELECT hosts.host_id, count(name) AS n FROM hosts LEFT JOIN ea USING (host_id) GROUP BY 1) USING (host_id)""".replace("last_seen IS NULL", "last_seen1 IS NULL"))
def mrg7_hosts_needing_software(inv):
    a, _ = states(inv)
    moved = F.col("last_seen").cast("date").cast("string")
    docs = inv.hosts.join(a.groupBy("host_id").agg(F.count("*").alias("n_software")), "host_id", "left").select("host_id", moved.alias("software_updated_at"), "n_software")
    stored = inv.hosts.select("host_id", F.when(F.col("platform") == "windows", F.concat(F.coalesce(moved, F.lit("")), F.lit("|1"))).alias("software_synced"))
    return merge.hosts_needing_software(docs, stored, a)


@query(" SELECT host_id FROM hosts WHERE last_seen IS NULL OR last_seen > greatest(TIMESTAMP '1998-01-01', CASE WHEN team_id < 10 THEN TIMESTAMP '1998-06-01' ELSE TIMESTAMP '1970-01-01' END)")
def mrg8_delta_hosts(inv):
    marks = inv.hosts.where("team_id < 10").select("team_id").distinct().withColumn("watermark", F.lit("1998-06-01").cast("timestamp"))
    return merge.delta_hosts(inv.hosts.withColumn("updated_at", F.col("last_seen")), marks, "1998-01-01").select("host_id")


def _tables(inv: Inventory) -> dict[str, DataFrame]:
    return {"hosts": inv.hosts, "users": inv.users, "software": inv.software, "labels": inv.labels, "uses": inv.uses, "installed_on": inv.installed_on, "has_label": inv.has_label}


@query(" SELECT name, host_id FROM installed_on WHERE host_id NOT IN (SELECT host_id FROM hosts WHERE last_seen < TIMESTAMP '1998-01-01' AND team_id IN (1, 2, 3))")
def mrg9_reap_stale_hosts(inv):
    tables = _tables(inv) | {"hosts": inv.hosts.withColumn("last_ingest", F.col("last_seen"))}
    return merge.reap_stale_hosts(tables, "1998-01-01", [1, 2, 3])["installed_on"].select("name", "host_id")


@query(""", hu AS (SELECT host_id FROM uses UNION SELECT host_id FROM ea UNION SELECT host_id FROM has_label WHERE label = '1-URGENT')
SELECT 'software' AS kind, count(*) FILTER (name NOT IN (SELECT name FROM ea SEMI JOIN hosts USING (host_id))) AS removed FROM software UNION ALL SELECT 'labels', count(*) FILTER (name <> '1-URGENT') FROM inv_labels
UNION ALL SELECT 'users', count(*) FILTER (username NOT IN (SELECT username FROM uses SEMI JOIN hosts USING (host_id))) FROM users UNION ALL SELECT 'hosts', count(*) FILTER (host_id NOT IN (SELECT host_id FROM hu)) FROM hosts""")
def mrg10_reap_unattached(inv):
    before = _tables(inv) | {"installed_on": states(inv)[0], "has_label": inv.has_label.where("label = '1-URGENT'")}
    return merge.reaped_counts(before, merge.reap_unattached(before))


@query(""", lost AS (SELECT DISTINCT label_id, host_id FROM has_label WHERE host_id NOT IN (SELECT host_id FROM hosts WHERE team_id < 15))
SELECT label_id, count(*) AS orphans, array_to_string(list_slice(list_sort(list(host_id)), 1, 50), '|') AS shown, count(*) > 50 AS truncated FROM lost GROUP BY label_id""")
def mrg11_orphan_members(inv):
    return merge.orphan_members(inv.has_label, inv.hosts.where("team_id < 15")).withColumn("shown", F.col("shown").cast("array<string>"))


@query(""", p AS (SELECT label_id, host_id FROM has_label JOIN hosts USING (host_id) WHERE platform <> 'rhel'), c AS (SELECT label_id, host_id FROM has_label JOIN hosts USING (host_id) WHERE platform <> 'darwin' AND label_id <> 5)
SELECT label_id, host_id, 'add' AS change FROM c ANTI JOIN p USING (label_id, host_id) UNION ALL SELECT label_id, host_id, 'remove' FROM p ANTI JOIN c USING (label_id, host_id) WHERE label_id <> 5""")
def mrg12_label_sync(inv):
    named = inv.has_label.join(inv.hosts.select("host_id", "platform"), "host_id")
    return merge.sync_label_membership(named.where("platform <> 'rhel'"), named.where("platform <> 'darwin' AND label_id <> 5"), inv.hosts)


@query(" SELECT label_id, sha256('[' || string_agg(CAST(host_id AS VARCHAR), ',' ORDER BY host_id) || ']') AS hash FROM has_label GROUP BY label_id")
def mrg13_label_hash(inv):
    return merge.label_member_hash(inv.has_label)


@query(" SELECT label_id, name FROM inv_labels WHERE label_id < 4", "mrg14_reap_labels")
def _labels(inv):
    stored = merge.upsert_labels(inv.labels, inv.labels).withColumn("last_synced", F.lit("2001-01-01").cast("timestamp"))
    return merge.reap_stale_labels(stored, inv.labels.where("label_id < 4"), "2001-06-01").select("label_id", "name")


def _snapshots(inv: Inventory):
    a, b = states(inv)
    made = []
    for ts, edges, hosts in (("2001-01-01 00:00:00", a, inv.hosts), ("2001-02-01 00:00:00", b, inv.hosts.withColumn("platform", F.when(F.col("platform") == "rhel", "fedora").otherwise(F.col("platform"))).where("team_id <> 7"))):
        part = Inventory(hosts, inv.users, inv.software.join(edges.select("name").distinct(), "name", "left_semi"), inv.labels, inv.uses, edges, inv.has_label)
        made.append((snapshot.snapshot_nodes(part, ts), snapshot.snapshot_edges(part, ts)))
    return made


COUNTS = """, sn AS (SELECT '2001-01-01 00:00:00' AS snapshot_ts, (SELECT count(*) FROM hosts) AS hosts, (SELECT count(*) FROM users) AS users, (SELECT count(DISTINCT name) FROM ea) AS software, (SELECT count(*) FROM inv_labels) AS labels,
(SELECT count(*) FROM uses SEMI JOIN hosts USING (host_id)) + (SELECT count(*) FROM ea SEMI JOIN hosts USING (host_id)) + (SELECT count(*) FROM has_label) AS edges
UNION ALL SELECT '2001-02-01 00:00:00', (SELECT count(*) FROM hosts WHERE team_id <> 7), (SELECT count(*) FROM users), (SELECT count(DISTINCT name) FROM eb), (SELECT count(*) FROM inv_labels),
(SELECT count(*) FROM uses JOIN hosts USING (host_id) WHERE team_id <> 7) + (SELECT count(*) FROM eb JOIN hosts USING (host_id) WHERE team_id <> 7) + (SELECT count(*) FROM has_label))"""


@query(COUNTS + " SELECT * FROM sn")
def snk2_list_snapshots(inv):
    (na, ea), (nb, eb) = _snapshots(inv)
    return snapshot.list_snapshots(na.unionByName(nb), ea.unionByName(eb))


@query(COUNTS + " SELECT snapshot_ts FROM sn ORDER BY 1 DESC LIMIT 1", "snk3_retained")
def _retained(inv):
    return snapshot.retained_snapshots(snk2_list_snapshots(inv), "2001-03-01", 60, 1).select("snapshot_ts")


@query(COUNTS + " SELECT snapshot_ts, hosts - lag(hosts) OVER w AS d_hosts, users - lag(users) OVER w AS d_users, software - lag(software) OVER w AS d_software, edges - lag(edges) OVER w AS d_edges FROM sn WINDOW w AS (ORDER BY snapshot_ts)")
def win1_snapshot_deltas(inv):
    return snapshot.snapshot_deltas(snk2_list_snapshots(inv)).select("snapshot_ts", "d_hosts", "d_users", "d_software", "d_edges")


@query(""" SELECT 'added' AS bucket, 'software' AS kind, 'software_' || name AS id FROM (SELECT DISTINCT name FROM eb ANTI JOIN ea USING (name)) UNION ALL SELECT 'removed', 'software', 'software_' || name FROM (SELECT DISTINCT name FROM ea ANTI JOIN eb USING (name))
UNION ALL SELECT 'removed', 'host', 'host_' || host_id FROM hosts WHERE team_id = 7""")
def set2_diff_nodes(inv):
    (a, _), (b, _) = _snapshots(inv)
    return snapshot.diff_nodes(a, b)


@query(" SELECT 'host' AS kind, 'host_' || host_id AS id, 'platform' AS prop, 'rhel' AS old, 'fedora' AS \"new\" FROM hosts WHERE platform = 'rhel' AND team_id <> 7")
def set3_diff_properties(inv):
    (a, _), (b, _) = _snapshots(inv)
    return snapshot.diff_properties(a, b)


EDGE_DIFF = """, l1 AS (SELECT 'INSTALLED_ON' AS label, 'software_' || name AS src, 'host_' || host_id AS dst FROM ea SEMI JOIN hosts USING (host_id) UNION SELECT 'USES', 'user_' || username, 'host_' || host_id FROM uses SEMI JOIN hosts USING (host_id)),
l2 AS (SELECT 'INSTALLED_ON' AS label, 'software_' || name AS src, 'host_' || host_id AS dst FROM eb JOIN hosts USING (host_id) WHERE team_id <> 7 UNION SELECT 'USES', 'user_' || username, 'host_' || host_id FROM uses JOIN hosts USING (host_id) WHERE team_id <> 7),
dd AS (SELECT 'added' AS bucket, * FROM (SELECT * FROM l2 EXCEPT SELECT * FROM l1) UNION ALL SELECT 'removed', * FROM (SELECT * FROM l1 EXCEPT SELECT * FROM l2))"""


@query(EDGE_DIFF + " SELECT * FROM dd")
def set4_diff_edges(inv):
    (_, a), (_, b) = _snapshots(inv)
    return snapshot.diff_edges(a, b)


@query(EDGE_DIFF + ", n AS (SELECT bucket, label AS kind, count(*) AS n FROM dd GROUP BY ROLLUP (bucket, label)) SELECT bucket, kind, n, n / (SELECT max(n) FROM n) AS share FROM n")
def agg14_diff_counts(inv):
    from hostloom.operators.aggregate import diff_counts

    return diff_counts(set4_diff_edges(inv).withColumnRenamed("label", "kind"))


@query(EDGE_DIFF + " SELECT bucket, label AS kind, src AS id FROM dd WHERE bucket = 'added' AND contains(src, 'slack')")
def flt7_filter_changes(inv):
    from hostloom.operators.scope import filter_changes

    return filter_changes(set4_diff_edges(inv).select("bucket", F.col("label").alias("kind"), F.col("src").alias("id")), "SLACK", buckets=["added"], kinds=["INSTALLED_ON"])
