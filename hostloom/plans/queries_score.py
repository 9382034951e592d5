"""Queries of extension scoring, categories, removal runs and streams, with their SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostloom.functions.shared import settle, shared_dir
from hostloom.operators import aggregate, categorize, runs, scope, score
from hostloom.plans.inventory import SQL, Inventory, inventory
from hostloom.plans.queries_core import flat
from hostloom.streaming import inventory_stream

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = "2002-01-01"


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: flat(f(inventory(spark, sf_dir)))
        if sql:
            ORACLE_SQL[key] = SQL + sql
        return f

    return register


# --- tables derived from `part`, in both languages -------------------------------------------------


def _size(n: int):
    return F.col("p_size") % n == 0


def listings(inv: Inventory) -> DataFrame:
    """Store listings of the extensions, by the size of their part."""
    none = F.array().cast("array<string>")
    text = lambda *xs: F.array(*map(F.lit, xs))
    s = F.col("p_size")
    return inv.software.where("store IS NOT NULL").select(
        "store", "extension_id", "p_size",
        F.element_at(text("public", "unlisted", "removed", "not_found", "public"), (s % 5 + 1).cast("int")).alias("status"), (s * s * s).cast("long").alias("users"), (1 + (s % 9) * 0.5).alias("rating"), (s * 10).cast("long").alias("rating_count"),
        F.when(_size(2), text("cookies", "storage")).otherwise(text("tabs", "debugger", "https://a/*")).alias("permissions"), text("proxy", "history", "cookies").alias("optional_permissions"),
        F.when(_size(3), text("<all_urls>")).otherwise(none).alias("host_permissions"), F.when(_size(4), text("https://x/*")).otherwise(none).alias("content_script_matches"),
        F.when(_size(6), F.array(F.lit(4), F.lit(5), F.lit(3)).cast("array<bigint>")).alias("privacy_codes"), F.when(_size(10), "default-src 'none'; script-src 'self' 'unsafe-eval'").when(_size(7), "script-src https://cdn.example.org").alias("content_security_policy"),
        (2 + s % 2).cast("long").alias("manifest_version"), _size(7).alias("featured"), _size(11).alias("developer_verified"), F.lit(False).alias("established_publisher"), _size(8).alias("crx_hash_verified"),
        F.date_sub(F.lit("2001-12-01").cast("date"), s * 30).cast("timestamp").alias("updated_at"), F.lit(None).cast("string").alias("manifest_error"), F.when(_size(9), "too large").alias("manifest_unavailable"),
        F.lit(None).cast("string").alias("publisher_id"), F.array().cast("array<bigint>").alias("author_ids"),
    )


def feeds(inv: Inventory) -> DataFrame:
    ext = inv.software.where("store = 'chrome'")
    return ext.where(_size(13)).select(F.lit("a").alias("feed"), F.lit("chromium").alias("platform"), F.col("extension_id").alias("id"), F.lit("Malware").alias("reason")).unionByName(
        ext.where(_size(9)).select(F.lit("b").alias("feed"), F.lit("chromium").alias("platform"), F.col("extension_id").alias("id"), F.lit("Adware bundle").alias("reason")))


def block_list(inv: Inventory) -> DataFrame:
    """Exact guids with a range up to version 3, and one pattern without a range."""
    ranges = F.array(F.struct(F.lit("0").alias("minVersion"), F.lit("3.*").alias("maxVersion")))
    exact = inv.software.where((F.col("store") == "firefox") & (F.col("p_size") % 2 == 0)).select(F.col("extension_id").alias("guid"), F.lit("exact").alias("why"), ranges.alias("ranges"))
    pattern = inv.hosts.select(F.lit("/^addon-1.*@example\\.org$/").alias("guid"), F.lit("pattern").alias("why"), F.array().cast("array<struct<minVersion:string,maxVersion:string>>").alias("ranges")).distinct()
    return exact.unionByName(pattern)


def groups(inv: Inventory) -> DataFrame:
    """Extensions with their hosts and versions, by key."""
    seen = inv.installed_on.where(F.col("extension_key").isNotNull()).groupBy("extension_key").agg(F.count_distinct("host_id").alias("host_count"), F.array_sort(F.collect_set("version")).alias("versions"))
    return inv.software.where("store IS NOT NULL").join(seen, "extension_key", "left").select(
        F.col("extension_key").alias("key"), "name", "display_name", "store", "extension_id", F.coalesce("host_count", F.lit(0)).alias("host_count"), F.coalesce("versions", F.array().cast("array<string>")).alias("versions"),
        F.array().cast("array<string>").alias("installed_paths"), F.lit(None).cast("string").alias("app_team_id"), F.when(_size(5), F.col("p_size") / 5.0).alias("max_cvss"))


def installs(inv: Inventory) -> DataFrame:
    """One row per install; larger parts lie in the store's directory."""
    root = F.when(F.col("store") == "chrome", F.lit("/Users/a/Library/Application Support/Google/Chrome/Default/Extensions/")).otherwise(F.lit("/home/a/.mozilla/firefox/x/extensions/"))
    path = F.when(F.col("p_size") > 20, F.concat(root, "extension_id")).otherwise(F.lit("/tmp/unpacked"))
    e = inv.installed_on.select("p_partkey", "host_id").join(inv.software.where("store IS NOT NULL").drop("p_brand"), "p_partkey").join(inv.hosts.select("host_id", "platform"), "host_id")
    return e.select(F.col("extension_key").alias("key"), "store", "extension_id", path.alias("path"), "platform")


def scored(inv: Inventory) -> DataFrame:
    # groups and installs both read the extensions' installs, which are few of all: these are derived once
    held = inv.installed_on.where(F.col("extension_key").isNotNull()).select("p_partkey", "host_id", "version", "extension_key")
    inv = replace(inv, installed_on=settle(held))
    none = inv.software.sparkSession.createDataFrame([], "name string, kind string, id string")
    return score.score_extensions(groups(inv), listings(inv), block_list(inv), feeds(inv), none, installs(inv), inv.hosts.agg(F.count("*").alias("fleet_hosts")), AS_OF)


LIST = """, li AS (SELECT extension_key AS key, name, display_name, store, extension_id, p_size AS s, p_partkey, CASE p_size % 5 WHEN 0 THEN 'public' WHEN 1 THEN 'unlisted' WHEN 2 THEN 'removed' WHEN 3 THEN 'not_found' ELSE 'public' END AS status,
CAST(p_size AS BIGINT) * p_size * p_size AS users, 1 + (p_size % 9) * 0.5 AS rating, p_size * 10 AS rating_count FROM software WHERE store IS NOT NULL),
hosts_of AS (SELECT key, (SELECT count(DISTINCT host_id) FROM installed_on i WHERE i.extension_key = li.key) AS hosts, (SELECT count(DISTINCT version) FROM installed_on i WHERE i.extension_key = li.key) AS versions FROM li),
cap AS (SELECT key, CAST(least(100, CASE WHEN s % 2 = 0 AND s % 3 <> 0 AND s % 4 <> 0 THEN round_even(pts * 0.6, 0) ELSE pts END + CASE WHEN s % 10 = 0 OR s % 7 = 0 THEN 15 ELSE 0 END) AS INTEGER) AS capability_score
  FROM (SELECT key, s, CASE WHEN s % 2 = 0 THEN 16 + 14 ELSE 25 + 8 + 4 + 10 END + CASE WHEN s % 3 = 0 THEN 20 WHEN s % 2 = 1 THEN 2 ELSE 0 END + CASE WHEN s % 4 = 0 THEN 5 ELSE 0 END + CASE WHEN s % 6 = 0 THEN 8 ELSE 0 END AS pts FROM li)),
tru AS (SELECT key, CAST(least(100, CASE status WHEN 'public' THEN 25 WHEN 'unlisted' THEN 5 ELSE 0 END + CASE WHEN s % 11 = 0 THEN 10 ELSE 0 END + CASE WHEN s % 7 = 0 THEN 5 ELSE 0 END + CASE WHEN s % 2 = 1 THEN 8 ELSE 0 END
  + CASE WHEN 31 + s * 30 <= 365 THEN 10 WHEN 31 + s * 30 <= 730 THEN 4 ELSE 0 END + CASE WHEN users > 0 THEN least(12, floor(log10(users + 1) * 4 + 1e-12)) ELSE 0 END + CASE WHEN rating >= 4 AND rating_count >= 100 THEN 5 ELSE 0 END + CASE WHEN s % 8 = 0 THEN 5 ELSE 0 END) AS INTEGER) AS trust_score FROM li),
blk AS (SELECT key, CASE WHEN store = 'firefox' AND s % 2 = 0 AND (NOT EXISTS (SELECT 1 FROM installed_on i WHERE i.extension_key = li.key) OR EXISTS (SELECT 1 FROM installed_on i WHERE i.extension_key = li.key AND CAST(split_part(version, '.', 1) AS INTEGER) <= 3)) THEN 'exact'
  WHEN regexp_matches(extension_id, '^addon-1.*@example\\.org$') THEN 'pattern' END AS why FROM li),
thr AS (SELECT key, why, store = 'chrome' AND s % 13 = 0 AS malicious, store = 'chrome' AND s % 9 = 0 AS unwanted, CAST(greatest(CASE WHEN store = 'chrome' AND s % 13 = 0 THEN 100 WHEN store = 'chrome' AND s % 9 = 0 THEN 70 ELSE 0 END, CASE WHEN why IS NOT NULL THEN 100 WHEN status = 'removed' THEN 45 WHEN status = 'not_found' THEN 20 WHEN status = 'unlisted' THEN 10 ELSE 0 END,
  CASE WHEN rating < 2.5 AND rating_count >= 50 THEN 15 ELSE 0 END, CASE WHEN s % 9 = 0 THEN 15 ELSE 0 END, CASE WHEN s % 5 = 0 THEN CASE WHEN s / 5.0 >= 9 THEN 35 WHEN s / 5.0 >= 7 THEN 25 WHEN s > 0 THEN 10 ELSE 0 END ELSE 0 END) AS INTEGER) AS threat_score FROM li JOIN blk USING (key)),
expo AS (SELECT key, CAST(least(100, least(60, round_even(log10(hosts + 1) * 15, 0)) + CASE WHEN versions > 2 THEN 10 ELSE 0 END) AS INTEGER) AS exposure_score FROM hosts_of),
risk0 AS (SELECT *, CASE WHEN display_name = 'adgaurd' THEN 18 ELSE 0 END AS name_penalty, coalesce(why IS NOT NULL OR malicious, false) AS known_bad, CASE WHEN users < 1000 THEN CASE WHEN users < 100 THEN 8 ELSE 4 END ELSE 0 END + CASE WHEN hosts <= 1 THEN 4 WHEN (SELECT count(*) FROM hosts) >= 10 AND hosts / (SELECT count(*) FROM hosts) < 0.03 THEN 3 ELSE 0 END AS rarity
  FROM li JOIN cap USING (key) JOIN tru USING (key) JOIN thr USING (key) JOIN expo USING (key) JOIN hosts_of USING (key)),
risk AS (SELECT key, store, hosts AS host_count, capability_score, trust_score, threat_score, exposure_score, name_penalty, known_bad, CAST(least(100, greatest(0, round_even(0.35 * CAST(capability_score AS DOUBLE) + 0.25 * CAST(100 - trust_score AS DOUBLE) + 0.25 * CAST(threat_score AS DOUBLE) + 0.15 * CAST(exposure_score AS DOUBLE) + name_penalty + rarity, 0),
  CASE WHEN known_bad THEN CASE WHEN users >= 100000 THEN 96 WHEN users >= 10000 THEN 92 ELSE 85 END WHEN unwanted THEN 70 WHEN status = 'removed' THEN 60 WHEN status = 'not_found' AND name_penalty >= 18 THEN 55 ELSE 0 END)) AS INTEGER) AS risk_score FROM risk0),
banded AS (SELECT *, CASE WHEN risk_score >= 75 THEN 'critical' WHEN risk_score >= 50 THEN 'high' WHEN risk_score >= 25 THEN 'medium' ELSE 'low' END AS risk_band FROM risk)"""


@query(LIST + " SELECT key, capability_score, CASE WHEN s % 6 = 0 THEN 'developer declares it collects: financial and payment information, authentication information, personal communications' END AS declared FROM cap JOIN li USING (key)")
def s3_capability(inv):
    df = score.capability(score.permission_sets(listings(inv)))
    declared = F.get(F.filter("capability_signals", lambda s: s["code"] == "declared-data-collection"), 0)["detail"]
    return df.select(F.concat(F.lit("ext:"), "store", F.lit(":"), "extension_id").alias("key"), "capability_score", declared.alias("declared"))


@query(LIST + " SELECT key, CASE WHEN s % 10 = 0 THEN '''unsafe-eval'' lets it run code built from strings' WHEN s % 7 = 0 THEN 'loads scripts from https://cdn.example.org' END AS weak FROM li")
def s4_weak_csp(inv):
    return listings(inv).select(F.concat(F.lit("ext:"), "store", F.lit(":"), "extension_id").alias("key"), score.weak_csp(F.col("content_security_policy")).alias("weak"))


@query(LIST + " SELECT key, trust_score FROM tru")
def s5_trust(inv):
    return score.trust(listings(inv).withColumn("reputable", F.lit(False)), AS_OF).select(F.concat(F.lit("ext:"), "store", F.lit(":"), "extension_id").alias("key"), "trust_score")


@query(LIST + " SELECT extension_id, why FROM blk JOIN li USING (key) WHERE why IS NOT NULL")
def s6_blocklist(inv):
    return score.match_blocklist(groups(inv).select("extension_id", "versions"), block_list(inv))


@query(LIST + " SELECT extension_id, CASE WHEN s % 13 = 0 THEN 100 ELSE 70 END AS threat, CAST(s % 13 = 0 AS BIGINT) + CAST(s % 9 = 0 AS BIGINT) AS n FROM li WHERE store = 'chrome' AND (s % 13 = 0 OR s % 9 = 0)")
def s7_feeds(inv):
    return score.match_feeds(groups(inv), feeds(inv)).select("extension_id", F.array_max(F.transform("hits", lambda h: h["threat"])).alias("threat"), F.size("hits").cast("long").alias("n"))


@query(LIST + " SELECT key, threat_score FROM thr")
def s8_threat(inv):
    return scored(inv).select("key", "threat_score")


@query(LIST + " SELECT key, exposure_score FROM expo")
def s9_exposure(inv):
    return groups(inv).select("key", score.exposure(F.col("host_count"), F.size("versions")).alias("exposure_score"))


@query(LIST + " SELECT key, s > 20 AS verified FROM li WHERE key IN (SELECT extension_key FROM installed_on i JOIN hosts USING (host_id))")
def s10_installs(inv):
    return score.store_install_verified(installs(inv))


@query(""", li AS (SELECT extension_key AS key, extension_id, p_size AS s FROM software WHERE store = 'chrome') SELECT key, s > 20 AND s % 2 = 0 AND EXISTS (SELECT 1 FROM installed_on i JOIN hosts USING (host_id) WHERE i.extension_key = key) AS reputable FROM li""")
def s11_reputable(inv):
    ids = inv.software.where(_size(2) & (F.col("store") == "chrome")).select(F.lit("x").alias("name"), F.lit("chrome").alias("kind"), F.concat(F.lit("u"), F.md5(F.col("extension_id").cast("binary"))).alias("id"))
    ext = groups(inv).where("store = 'chrome'").withColumn("publisher_id", F.concat(F.lit("u"), F.md5(F.col("extension_id").cast("binary")))).withColumn("status", F.lit("public")).withColumn("author_ids", F.array().cast("array<bigint>"))
    return score.publisher_reputable(ext, ids, score.store_install_verified(installs(inv)))


@query(" SELECT DISTINCT display_name, CASE WHEN display_name = 'adgaurd' THEN 18 ELSE 0 END AS name_penalty FROM software")
def s12_names(inv):
    return score.name_anomalies(inv.software.select(F.col("display_name").alias("name"), "display_name", F.lit(False).alias("vouched")).distinct()).select("display_name", "name_penalty")


@query(""" SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 0 ELSE CASE p_partkey % 9 WHEN 1 THEN 18 WHEN 2 THEN 18 WHEN 3 THEN 8 WHEN 5 THEN 18 WHEN 6 THEN 18 WHEN 8 THEN 18 ELSE 0 END END AS name_penalty,
CASE p_partkey % 9 WHEN 1 THEN 'adguard' WHEN 2 THEN 'lastpass' WHEN 3 THEN 'dashlane' WHEN 5 THEN 'keeper' WHEN 6 THEN 'paypal' WHEN 8 THEN 'amazon' END AS brand FROM software""")
def s12_lookalikes(inv):
    # the brand itself, a swap, a lost letter, a short affix, a long affix, a letter more, a digit for a letter, two letters off, another letter
    kinds = ("Norton", "ad-Gaurd", "lastpas", "Dashlane EX", "bitwarden pro", "keepper", "payp4l", "metmsak9", "Amazom")
    shown = F.element_at(F.array(*map(F.lit, kinds)), (F.col("p_partkey") % 9 + 1).cast("int"))
    names = inv.software.select("p_partkey", F.concat_ws(" #", "name", "p_partkey").alias("name"), shown.alias("display_name"), _size(2).alias("vouched"))
    judged = score.name_anomalies(names.drop("p_partkey")).withColumn("p_partkey", F.substring_index("name", "#", -1).cast("long"))
    told = F.get(F.filter("name_signals", lambda s: s["code"].startswith("brand") | (s["code"] == "typosquat-brand")), 0)["detail"]
    return judged.select("p_partkey", "name_penalty", F.nullif(F.regexp_extract(told, "the '(.*?)' brand", 1), F.lit("")).alias("brand"))


@query(LIST + " SELECT key, store, host_count, capability_score, trust_score, threat_score, exposure_score, name_penalty, risk_score, risk_band, known_bad FROM banded")
def s13_score_extensions(inv):
    return scored(inv).select("key", "store", "host_count", "capability_score", "trust_score", "threat_score", "exposure_score", "name_penalty", "risk_score", "risk_band", "known_bad")


@query(LIST + """, seen AS (SELECT extension_key AS key, count(DISTINCT host_id) AS n, list_sort(list(DISTINCT version)) AS versions FROM installed_on WHERE extension_key IS NOT NULL GROUP BY 1)
SELECT key, sha1('{"display_name":"' || display_name || '","extension_id":"' || extension_id || '","host_count":' || coalesce(n, 0) || ',"installed_paths":[],"key":"' || key || CASE WHEN s % 5 = 0 THEN '","max_cvss":' || CAST(s / 5.0 AS DOUBLE) || ',"name":"' ELSE '","name":"' END || name
  || '","store":"' || store || '","versions":[' || CASE WHEN n > 0 THEN '"' || array_to_string(versions, '","') || '"' ELSE '' END || '],"rare":' || (SELECT count(*) >= 10 AND coalesce(n, 0) / count(*) < 0.03 FROM hosts) || '}') AS fingerprint FROM li LEFT JOIN seen USING (key)""")
def s14_fingerprints(inv):
    return score.extension_fingerprints(groups(inv), inv.hosts.agg(F.count("*").alias("fleet_hosts")))


@query(" SELECT extension_key AS key, CASE WHEN p_size % 3 = 0 THEN 'new' WHEN p_size % 3 = 1 THEN 'changed' ELSE 'listing due' END AS reason FROM software WHERE store IS NOT NULL AND (p_size % 3 < 2 OR p_size > 20)")
def s15_due(inv):
    g = groups(inv)
    prints = score.extension_fingerprints(g, inv.hosts.agg(F.count("*").alias("fleet_hosts")))
    by_size = inv.software.where("store IS NOT NULL").select(F.col("extension_key").alias("key"), "p_size")
    prior = prints.join(by_size, "key").where(~_size(3)).join(g.select("key", "versions"), "key").select("key", F.when(F.col("p_size") % 3 == 1, "old").otherwise(F.col("fingerprint")).alias("fingerprint"), F.col("versions").alias("versions_seen"))
    listed = inv.software.where("store IS NOT NULL").select("store", "extension_id", F.when(F.col("p_size") > 20, F.lit("2001-01-01")).otherwise(F.lit(AS_OF)).cast("timestamp").alias("fetched_at"), F.lit("1").alias("version"))
    return score.due_for_scoring(g, prints, prior, listed, AS_OF)


@query(LIST + " SELECT s.name, risk_score, risk_band FROM software s LEFT JOIN banded b ON s.extension_key = b.key")
def s16_apply_scores(inv):
    return score.apply_scores(inv.software, scored(inv).withColumn("store_name", F.lit(None).cast("string"))).select("name", "risk_score", "risk_band")


@query(LIST + " SELECT risk_band, count(DISTINCT key) AS extensions FROM banded GROUP BY 1 UNION ALL SELECT 'total', count(DISTINCT key) FROM banded")
def agg10_bands(inv):
    return aggregate.extension_band_summary(scored(inv).select("key", "risk_band"))


@query(LIST + " SELECT risk_band, count(*) FILTER (host_count = 1) AS p1, count(*) FILTER (host_count BETWEEN 2 AND 4) AS p2_4, count(*) FILTER (host_count BETWEEN 5 AND 9) AS p5_9, count(*) FILTER (host_count >= 10) AS p10 FROM banded WHERE host_count > 0 GROUP BY 1")
def agg12_matrix(inv):
    return aggregate.extension_matrix(scored(inv))


@query(LIST + " SELECT store, count(*) AS total, count(*) AS with_id, count(*) FILTER (status IN ('public', 'unlisted')) AS listed, count(*) AS with_users, count(*) AS with_rating, count(*) AS with_manifest, CASE WHEN count(*) FILTER (s % 9 = 0) > 0 THEN 'too large' ELSE '' END AS errors FROM li GROUP BY store")
def agg13_coverage(inv):
    return aggregate.enrichment_coverage(listings(inv).withColumn("error", F.col("manifest_unavailable")))


@query(LIST + " SELECT key, risk_score FROM banded WHERE risk_band = 'high' AND store = 'chrome' AND NOT known_bad")
def flt8_extension_filter(inv):
    return scope.extension_filter(scored(inv), "high", "chrome", False).select("key", "risk_score")


# --- categories --------------------------------------------------------------------------------------


@query(r""" SELECT name, CASE WHEN p_partkey % 20 IN (5, 6) THEN regexp_replace(name, ' [0-9]+\.0$', '') ELSE name END AS title FROM software""")
def cat1_normalize(inv):
    return inv.software.select("name", categorize.normalize_title(F.col("name")).alias("title"))


@query(" SELECT name, CASE p_partkey % 20 WHEN 5 THEN 'Communication|Team Chat' WHEN 6 THEN 'Browser' END AS catalog_category, CASE p_partkey % 20 WHEN 5 THEN 'Workplace messaging and collaboration platform.' WHEN 6 THEN 'Google''s web browser based on Chromium.' END AS catalog_description FROM software")
def cat2_catalog(inv):
    return categorize.catalog_lookup(inv.software).select("name", "catalog_category", "catalog_description")


def _articles(inv: Inventory) -> DataFrame:
    """Articles about titles by the size of their part: a browser, a game, or no software."""
    e = F.when(_size(3), "Is a web browser for U.S. users. It has plug-ins.").when(_size(2), "A roguelike game. By Dr. X.").otherwise("A river. It flows.")
    return inv.software.select(categorize.normalize_title(F.col("name")).alias("title"), F.when(_size(7), "disambiguation").otherwise("standard").alias("kind"), F.lit("").alias("description"), e.alias("extract"))


@query(""" SELECT name, CASE WHEN p_partkey % 20 = 5 THEN 'Communication|Team Chat' WHEN p_partkey % 20 = 6 THEN 'Browser' WHEN p_size % 7 = 0 THEN p_type WHEN p_size % 3 = 0 THEN 'Browser' WHEN p_size % 2 = 0 THEN 'Application' ELSE p_type END AS category,
CASE WHEN p_partkey % 20 = 5 THEN 'Workplace messaging and collaboration platform.' WHEN p_partkey % 20 = 6 THEN 'Google''s web browser based on Chromium.' WHEN p_size % 7 = 0 THEN 'told ' || vendor WHEN p_size % 3 = 0 THEN 'Is a web browser for U.S. users.' WHEN p_size % 2 = 0 THEN 'A roguelike game.' ELSE 'told ' || vendor END AS description,
CAST(p_size % 4 + 1 AS INTEGER) AS attempts,
CASE WHEN p_partkey % 20 IN (5, 6) THEN 'catalog' WHEN p_size % 7 = 0 THEN 'miss' WHEN p_size % 3 = 0 OR p_size % 2 = 0 THEN 'article' ELSE 'miss' END AS outcome FROM software""")
def cat6_categorize(inv):
    # one article a title: parts that share a normalised title are catalog hits anyway
    stored = inv.software.withColumn("description", F.concat(F.lit("told "), "vendor")).withColumn("attempts", F.col("p_size") % 4)
    return categorize.categorize(stored, _articles(inv), AS_OF).select("name", "category", "description", "attempts", "outcome")


@query(" SELECT name, CASE WHEN p_partkey % 20 IN (5, 6) OR p_size % 2 = 0 THEN p_type END AS category FROM software")
def cat7_purge(inv):
    df = inv.software.withColumn("description", F.when(_size(2), "a media player application").otherwise("a river")).withColumn("last_attempt", F.lit("2001-01-01").cast("timestamp"))
    return categorize.purge_failed_gate(df, AS_OF).select("name", "category")


@query(" SELECT host_id, contains(platform, 'u') AS gate, CASE WHEN contains(platform, 'u') THEN 'Browser' ELSE 'Application' END AS categories FROM hosts")
def cat4_infer(inv):
    text = F.when(F.col("platform").contains("u"), F.concat_ws(" ", "hostname", F.lit("runs a Web Browser"))).otherwise(F.concat_ws(" ", "hostname", F.lit("stands by a river")))
    return inv.hosts.select("host_id", categorize.software_gate(text).alias("gate"), categorize.infer_categories(text).alias("categories"))


# --- removal runs ------------------------------------------------------------------------------------


def removal_runs(inv: Inventory) -> DataFrame:
    """A history of runs: two for each install of a Chromium extension, by version."""
    e = inv.installed_on.where("source = 'chrome_extensions'").select(F.col("extension_key"), "host_id", F.split("version", r"\.")[1].cast("int").alias("v"), "first_seen", "last_seen")
    out = F.when(F.col("v") % 3 == 0, F.lit("x\nFH_RESULT=error\nFH_RESULT=removed\nFH_REMOVED=2\nFH_BLOCK=written\n")).otherwise(F.lit("FH_RESULT=not_found\n"))
    a = e.select("extension_key", "host_id", F.lit("a").alias("execution_id"), F.col("first_seen").alias("requested_at"), F.when(F.col("v") % 5 == 0, -2).otherwise(0).cast("long").alias("exit_code"), out.alias("output"))
    b = e.select("extension_key", "host_id", F.lit("b").alias("execution_id"), F.col("last_seen").alias("requested_at"), F.when(F.col("v") % 2 == 0, F.lit(None)).otherwise(0).cast("long").alias("exit_code"), out.alias("output"))
    return a.unionByName(b)


RUNS = """, re AS (SELECT extension_key, host_id, CAST(split_part(version, '.', 2) AS INTEGER) AS v, first_seen, last_seen FROM installed_on WHERE source = 'chrome_extensions')"""


@query(RUNS + """ SELECT extension_key, host_id, execution_id, CASE WHEN code IS NULL THEN 'queued' WHEN code <> 0 THEN 'failed' WHEN v % 3 = 0 THEN 'removed' ELSE 'not_found' END AS outcome, CAST(CASE WHEN v % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS removed,
CASE WHEN v % 3 = 0 THEN 'written' END AS block, CASE WHEN code = -2 THEN 'scripts are disabled on the host' END AS detail FROM (SELECT *, 'a' AS execution_id, CASE WHEN v % 5 = 0 THEN -2 ELSE 0 END AS code FROM re UNION ALL SELECT *, 'b', CASE WHEN v % 2 = 0 THEN NULL ELSE 0 END FROM re)""")
def run1_parse_output(inv):
    return runs.parse_run_output(removal_runs(inv)).select("extension_key", "host_id", "execution_id", "outcome", "removed", "block", "detail")


@query(RUNS + " SELECT extension_key, host_id, 'b' AS execution_id, CAST(v % 2 = 0 AS BIGINT) AS pending FROM re")
def run2_latest(inv):
    return runs.latest_runs(removal_runs(inv)).select("extension_key", "host_id", "execution_id", "pending")


@query(RUNS + """ SELECT i.extension_key, i.host_id, CASE WHEN platform = 'chrome' THEN 'platform' WHEN team_id = 4 THEN 'scripts off' WHEN re.v % 2 = 0 THEN 'queued' END AS reason, coalesce(NOT (platform = 'chrome' OR team_id = 4 OR re.v % 2 = 0), true) AS eligible,
CASE WHEN platform IN ('ubuntu', 'rhel') THEN true WHEN platform = 'windows' THEN store = 'chrome' ELSE false END AS blockable FROM installed_on i JOIN hosts USING (host_id) JOIN (SELECT name, store FROM software) USING (name) LEFT JOIN re ON re.extension_key = i.extension_key AND re.host_id = i.host_id WHERE i.extension_key IS NOT NULL""")
def run3_eligibility(inv):
    e = inv.installed_on.where("extension_key IS NOT NULL").select("name", "host_id").join(inv.software.select("name", "extension_key", "store", "extension_id", F.lit(False).alias("is_builtin")), "name").join(inv.hosts.select("host_id", "platform"), "host_id")
    state = inv.hosts.select("host_id", (F.col("team_id") != 4).alias("scripts_enabled"))
    return runs.removal_eligibility(e, state, removal_runs(inv))


# --- streams -----------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/{name}.parque[t]")  # a file source reads folders and patterns


def str1_stream_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host records from the event stream, merged batch by batch; the state after the last one."""
    out = _scratch(spark)
    events = _stream(spark, sf_dir, "events")
    docs = events.select((F.col("user_id")).alias("host_id"), F.concat(F.lit("host-"), "user_id").alias("hostname"), F.col("event_type").alias("platform"), F.col("ts").cast("timestamp").alias("updated_at"))
    inventory_stream.stream_host_state(docs, f"{out}/state", f"{out}/checkpoint").awaitTermination()
    return flat(inventory_stream.host_state(spark, f"{out}/state"))


def str3_stream_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and type, counted by a stream with a watermark."""
    out = _scratch(spark)
    counted = inventory_stream.stream_activity(_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    keep = lambda df, i: df.write.mode("overwrite").parquet(f"{out}/counts/v={i}")
    counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{out}/counts")
    return last.where(F.col("v") == last.agg(F.max("v")).first()[0]).select(F.col("start").cast("date").alias("start"), "event_type", "n")


def _scratch(spark: SparkSession) -> str:
    """A folder of this run under the session's shared folder."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


QUERIES |= {"str1_stream_hosts": str1_stream_hosts, "str3_stream_activity": str3_stream_activity}
ORACLE_SQL |= {
    "str1_stream_hosts": "SELECT host_id, 'host-' || host_id AS hostname, m.p AS platform, CAST(m.ts AS DATE) AS updated_at FROM (SELECT user_id AS host_id, max({'ts': ts, 'h': 'host-' || user_id, 'p': event_type}) AS m FROM events GROUP BY 1)",
    "str3_stream_activity": "SELECT CAST(ts AS DATE) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
