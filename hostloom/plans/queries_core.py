"""Queries over scopes, counts and detections, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostloom.functions import lists
from hostloom.operators import aggregate, detect, scope
from hostloom.plans.inventory import SQL, Inventory, inventory

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Arrays as text, timestamps as dates: what both engines print alike."""
    made = [F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c).cast("date").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes]
    return df.select(*made)


def query(sql: str | None = None, name: str | None = None, prefix: str = SQL):
    """Registers a function of an Inventory as a query, with the SQL that follows the inventory's."""

    def register(f):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return flat(f(inventory(spark, sf_dir)))

        QUERIES[key] = run
        if sql:
            ORACLE_SQL[key] = prefix + sql
        return f

    return register


def approved(inv: Inventory) -> DataFrame:
    """A whitelist: every title of one vendor."""
    return inv.software.where("vendor = 'Brand#11'").select(F.col("name").alias("entry"))


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _re(patterns) -> str:
    return "'" + detect.whole_name(patterns) + "'"


THRESHOLDS = ", thresholds AS (SELECT platform, count(*) AS hosts, greatest(2, CAST(floor(count(*) * 0.03) AS BIGINT)) AS threshold FROM hosts WHERE coalesce(platform, '') <> '' GROUP BY platform)"
SYSTEM = f""", titles AS (SELECT *, coalesce(source IN {_in(lists.DEV_LANGUAGE_SOURCES + lists.LINUX_PACKAGE_SOURCES)}, false) OR NOT regexp_matches(name, '[\\p{{L}}\\p{{N}}]')
  OR regexp_matches(lower(name), {_re(lists.SYSTEM_PATTERNS)}) OR regexp_matches(lower(name), {_re(lists.HELPER_PATTERNS)})
  OR {" OR ".join(f"contains(lower(p_type), '{c}')" for c in lists.SYSTEM_CATEGORIES)} AS is_system FROM software)"""
_hints = lambda table, test: " ".join(f"WHEN {' OR '.join(test(w) for w in words)} THEN '{k}'" for k, words in table)
TYPE = f"""CASE WHEN source IN {_in(lists.BROWSER_EXTENSION_SOURCES)} THEN 'Browser Extension' WHEN source IN {_in(lists.IDE_EXTENSION_SOURCES)} THEN 'VSCode Extension'
  {_hints(lists.NAME_CONTAINS, lambda w: f"contains(name, '{w}')")} {_hints(lists.NAME_STARTS, lambda w: f"starts_with(name, '{w}')")} {_hints(lists.NAME_CONTAINS_LATE, lambda w: f"contains(name, '{w}')")} ELSE 'Application' END"""
EDGES = ", edges AS (SELECT i.name, i.host_id, i.version, h.hostname, h.platform FROM installed_on i JOIN hosts h USING (host_id) WHERE i.name NOT IN (SELECT name FROM software WHERE vendor = 'Brand#11'))"
USERS = ", by_title AS (SELECT i.name, string_agg(DISTINCT username, '|' ORDER BY username) AS users FROM installed_on i JOIN hosts USING (host_id) JOIN uses USING (host_id) GROUP BY i.name)"


def _word(text: str, words) -> str:
    alternatives = "|".join(w.replace(".", r"\.").replace("-", r"\-") for w in words)
    return f"regexp_matches({text}, '(^|[^a-z0-9])({alternatives})($|[^a-z0-9])')"


RISK = "CASE " + " ".join(f"WHEN {_word('lower(p_type)', (k.lower(), *w))} THEN '{k}'" for k, w in lists.HIGH_RISK.items()) + " " + " ".join(f"WHEN {_word('name', w)} OR {_word('lower(display_name)', w)} THEN '{k}'" for k, w in lists.HIGH_RISK.items()) + " END"
_DET = "name AS software_name, display_name, {type} AS software_type, {level} AS risk_level, {category} AS category, '{kind}' AS detection_type, host_count, affected_hosts, coalesce(users, '') AS affected_users, {platforms} AS platforms, {version} AS version, {details} AS details, {advice} AS recommendation, {reason} AS risk_reason"
OUTLIERS = f"""{THRESHOLDS}{SYSTEM}{EDGES}{USERS}, rare AS (SELECT name, count(DISTINCT host_id) AS host_count, string_agg(DISTINCT hostname, '|' ORDER BY hostname) AS affected_hosts, string_agg(DISTINCT platform, '|' ORDER BY platform) AS platforms
  FROM edges GROUP BY name HAVING count(DISTINCT host_id) <= (SELECT max(threshold) FROM thresholds)),
outliers AS (SELECT {_DET.format(type=TYPE, level="CASE WHEN host_count = 1 THEN 'high' ELSE 'medium' END", category="'Outlier Software'", kind="outlier", platforms="platforms", version="'Unknown'", details="'Installed on ' || host_count || ' host(s) only - unusual for enterprise software'", advice="'Verify if this software is authorized. Found on only ' || host_count || ' host(s). Consider removing if unauthorized.'", reason="'Risk is ' || CASE WHEN host_count = 1 THEN 'HIGH' ELSE 'MEDIUM' END || ' because this software is installed on only ' || host_count || ' host(s) (<' || (SELECT max(threshold) FROM thresholds) || ' threshold).'")}
  FROM rare JOIN titles USING (name) LEFT JOIN by_title USING (name) WHERE NOT is_system)"""
HIGH = f""", hr AS (SELECT *, {RISK} AS matched FROM titles WHERE NOT is_system), hr_hosts AS (SELECT name, count(DISTINCT host_id) AS host_count, string_agg(DISTINCT hostname, '|' ORDER BY hostname) AS affected_hosts, string_agg(DISTINCT platform, '|' ORDER BY platform) AS platforms FROM edges GROUP BY name),
high AS (SELECT {_DET.format(type=TYPE, level="'high'", category="matched", kind="high_risk", platforms="platforms", version="'Unknown'", details="'High-risk category: ' || matched", advice="CASE matched " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lists.ADVICE.items()) + " END", reason="'Risk is HIGH because ''' || name || ''' matches the ''' || matched || ''' category, which is flagged for security review.'")}
  FROM hr_hosts JOIN hr USING (name) LEFT JOIN by_title USING (name) WHERE matched IS NOT NULL)"""
SPRAWL = f""", sp0 AS (SELECT name, count(DISTINCT version) AS version_count, count(DISTINCT host_id) AS host_count, string_agg(DISTINCT hostname, '|' ORDER BY hostname) AS affected_hosts, list_sort(list(DISTINCT version)) AS versions FROM edges WHERE version NOT IN ('', 'unknown') GROUP BY name HAVING count(DISTINCT version) > 2 ORDER BY version_count DESC, name LIMIT 20),
sp1 AS (SELECT *, CASE WHEN version_count > 5 THEN 'high' WHEN version_count > 3 THEN 'medium' ELSE 'low' END AS lvl FROM sp0 JOIN titles USING (name) WHERE NOT is_system),
sprawl AS (SELECT {_DET.format(type=TYPE, level="lvl", category="'Version Management'", kind="version_sprawl", platforms="''", version="version_count || ' versions: ' || array_to_string(list_slice(versions, 1, 3), ', ') || CASE WHEN version_count > 3 THEN '...' ELSE '' END", details="'Version sprawl detected - ' || version_count || ' different versions installed'", advice="'Standardize software versions across fleet. Currently running ' || version_count || ' different versions.'", reason="'Risk is ' || upper(lvl) || ' because there are ' || version_count || ' distinct versions installed, indicating poor patch management.'")} FROM sp1 LEFT JOIN by_title USING (name))"""
ALL = OUTLIERS + HIGH + SPRAWL + ", found AS (SELECT * FROM outliers UNION ALL SELECT * FROM high UNION ALL SELECT * FROM sprawl)"


@query(OUTLIERS + " SELECT * FROM outliers")
def det1_outliers(inv):
    return detect.detect_outliers(inv, inv.hosts, approved(inv))


@query(f"{SYSTEM}{EDGES}{USERS}{HIGH} SELECT * FROM high")
def det2_high_risk(inv):
    return detect.detect_high_risk(inv, inv.hosts, approved(inv))


@query(f"{SYSTEM}{EDGES}{USERS}{SPRAWL} SELECT * FROM sprawl")
def det3_version_sprawl(inv):
    return detect.detect_version_sprawl(inv, inv.hosts, approved(inv))


@query(ALL + " SELECT * FROM found WHERE risk_level = 'high' AND host_count >= 3")
def det4_detections(inv):
    return detect.detections(inv, inv.hosts, approved(inv), risk="high", host_count="3+")


@query(f"""{THRESHOLDS}, per AS (SELECT name, platform, count(DISTINCT host_id) AS n FROM installed_on JOIN hosts USING (host_id) GROUP BY ALL)
SELECT name, min(n) AS min_hosts, any_value(len(category) > 0) AS categorised FROM per JOIN thresholds USING (platform) JOIN software USING (name) WHERE n <= threshold AND source IN {_in(lists.ELIGIBLE_SOURCES)} GROUP BY name ORDER BY categorised, min_hosts, name LIMIT 50""")
def det5_decide_findings(inv):
    return detect.decide_findings(inv)


@query(f"{SYSTEM} SELECT name, is_system FROM titles")
def det6_system_packages(inv):
    return inv.software.select("name", detect.is_system_package(F.col("name"), F.col("category"), F.col("sources")).alias("is_system"))


@query(f" SELECT name, {TYPE} AS software_type FROM software")
def det7_software_types(inv):
    return inv.software.select("name", detect.software_type(F.col("name"), F.col("sources")).alias("software_type"))


@query(f"""{THRESHOLDS}{SYSTEM}, per AS (SELECT name, platform, count(DISTINCT host_id) AS n FROM installed_on JOIN hosts USING (host_id) GROUP BY ALL)
SELECT name, min(n) AS min_hosts FROM per JOIN thresholds USING (platform) JOIN titles USING (name) WHERE n <= threshold AND source IN {_in([s for s in lists.ELIGIBLE_SOURCES if s not in lists.BROWSER_EXTENSION_SOURCES])}
  AND NOT is_system AND p_size % 3 = 0 GROUP BY name ORDER BY min_hosts, name LIMIT 500""")
def det8_enrichment_candidates(inv):
    bare = inv.software.withColumn("category", F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.col("category")))
    return detect.enrichment_candidates(Inventory(**(inv.__dict__ | {"software": bare})), "2002-01-01")


@query(ALL + """ SELECT 'total' AS measure, 'all' AS value, count(*) AS n FROM found UNION ALL SELECT 'risk_level', risk_level, count(*) FROM found GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM found GROUP BY 2
UNION ALL SELECT 'detection_type', detection_type, count(*) FROM found GROUP BY 2
UNION ALL SELECT 'affected_hosts', 'all', count(DISTINCT x) FROM (SELECT unnest(string_split(affected_hosts, '|')) AS x FROM found)
UNION ALL SELECT 'affected_users', 'all', count(DISTINCT x) FROM (SELECT unnest(string_split(affected_users, '|')) AS x FROM found) WHERE x <> ''""")
def agg7_detection_summary(inv):
    found = detect.findings(inv, inv.hosts, approved(inv))
    return aggregate.detection_summary(found, *detect.affected(inv, found, inv.hosts, approved(inv)))


@query(THRESHOLDS + " SELECT * FROM thresholds")
def agg1_platform_thresholds(inv):
    return aggregate.platform_thresholds(inv.hosts)


@query(""" SELECT (SELECT count(*) FROM hosts) AS hosts, (SELECT count(DISTINCT team_id) FROM hosts) AS teams, (SELECT count(DISTINCT username) FROM uses SEMI JOIN hosts USING (host_id)) AS users,
(SELECT count(*) FROM software SEMI JOIN installed_on USING (name)) AS software, (SELECT count(*) FROM software SEMI JOIN installed_on USING (name) WHERE len(category) = 0) AS uncategorised""")
def agg2_fleet_totals(inv):
    return aggregate.fleet_totals(inv)


@query(""", top AS (SELECT name, count(DISTINCT host_id) AS host_count FROM installed_on GROUP BY name ORDER BY host_count DESC, name LIMIT 500)
SELECT name, display_name, host_count, (SELECT array_to_string(list_slice(list_sort(list(DISTINCT version)), 1, 25), '|') FROM installed_on i WHERE i.name = top.name) AS versions FROM top LEFT JOIN software USING (name)""")
def agg3_software_inventory(inv):
    return aggregate.software_inventory(inv)


@query(" SELECT label_id, name, (SELECT count(DISTINCT host_id) FROM has_label h SEMI JOIN hosts USING (host_id) WHERE h.label_id = l.label_id) AS host_count FROM inv_labels l")
def agg4_label_inventory(inv):
    return aggregate.label_inventory(inv)


@query(" SELECT DISTINCT username, hostname FROM uses JOIN hosts USING (host_id) ORDER BY 1, 2 LIMIT 500")
def agg5_user_hosts(inv):
    return aggregate.user_host_list(inv)


@query(" SELECT host_id, hostname, platform, team_id, team_name, CAST(last_seen AS DATE) AS last_seen FROM hosts ORDER BY hostname, host_id LIMIT 500", "agg5_host_list")
def _hosts(inv):
    return aggregate.host_list(inv)


@query(" SELECT DISTINCT team_id, team_name FROM hosts WHERE team_id IS NOT NULL", "agg5_teams")
def _teams(inv):
    return aggregate.teams(inv)


@query(" SELECT DISTINCT platform FROM hosts WHERE coalesce(platform, '') <> ''", "agg5_platforms")
def _platforms(inv):
    return aggregate.platforms(inv)


@query(USERS + " SELECT * FROM by_title")
def agg6_users_by_software(inv):
    return aggregate.users_by_software(inv, inv.software.select("name"), inv.hosts)


EXT = f", ext AS (SELECT i.*, coalesce(i.extension_key, 'name:' || i.name) AS key, hostname, platform FROM installed_on i JOIN hosts USING (host_id)), bext AS (SELECT * FROM ext WHERE source IN {_in(lists.BROWSER_EXTENSION_SOURCES)})"


@query(EXT + " SELECT key, count(DISTINCT host_id) AS host_count, count(DISTINCT version) AS version_count, string_agg(DISTINCT platform, '|' ORDER BY platform) AS platforms FROM bext GROUP BY key")
def agg8_extension_groups(inv):
    return aggregate.extension_groups(inv)


@query(EXT + """ SELECT key, min(name) AS name, CAST(NULL AS INTEGER) AS risk_score, CAST(NULL AS VARCHAR) AS risk_band, count(DISTINCT hostname) AS hostname_count,
array_to_string(list_slice(list_sort(list(DISTINCT hostname)), 1, 50), '|') AS hostnames, array_to_string(list_slice(list_sort(list(DISTINCT version)), 1, 20), '|') AS versions FROM bext GROUP BY key ORDER BY hostname_count DESC, key LIMIT 500""")
def agg9_extension_inventory(inv):
    return aggregate.extension_inventory(inv)


@query(EXT + " SELECT key, hostname, m.version AS version, CAST(m.d AS DATE) AS last_seen FROM (SELECT key, hostname, max({'d': last_seen, 'version': version}) AS m FROM bext GROUP BY ALL)")
def agg11_extension_detail(inv):
    keys = inv.software.where(F.col("source").isin(*lists.BROWSER_EXTENSION_SOURCES)).select(F.coalesce("extension_key", F.concat(F.lit("name:"), "name")).alias("key"))
    return aggregate.extension_detail(inv, keys)


@query(" SELECT host_id, hostname, platform, team_id, team_name, CAST(last_seen AS DATE) AS last_seen FROM hosts WHERE contains(platform, 'u') AND (SELECT count(*) FROM has_label l WHERE l.host_id = hosts.host_id AND label IN ('1-URGENT', '2-HIGH')) = 2")
def flt1_host_scope(inv):
    return scope.host_scope(inv, platform="U", labels=["1-URGENT", "2-HIGH", "1-URGENT"])


@query(" SELECT host_id, hostname, platform, team_id, team_name, CAST(last_seen AS DATE) AS last_seen FROM hosts WHERE (platform = 'windows' OR host_id IN (SELECT host_id FROM has_label WHERE label = '5-LOW')) AND NOT (team_id = 3)")
def flt2_composite_scope(inv):
    return scope.composite_scope(inv, '{"op": "AND", "args": [{"op": "OR", "args": [{"platform": "windows"}, {"label": "5-LOW"}]}, {"op": "NOT", "args": [{"team": "3"}]}]}')


@query(", n AS (SELECT host_id, count(DISTINCT label) AS n FROM hosts LEFT JOIN (SELECT * FROM has_label WHERE label IN ('1-URGENT', '2-HIGH')) USING (host_id) GROUP BY host_id) SELECT count(*) FILTER (n = 2) AS hosts, count(*) FILTER (n > 0) AS hosts_other_op FROM n")
def flt3_scope_count(inv):
    return scope.scope_count(inv, labels=["1-URGENT", "2-HIGH"])


@query(" SELECT name, vendor FROM software WHERE vendor <> 'Brand#11'")
def flt4_exclude_whitelisted(inv):
    return scope.exclude_whitelisted(inv.software, approved(inv)).select("name", "vendor")


@query(""" SELECT * FROM (SELECT 'host' AS kind, CAST(host_id AS VARCHAR) AS id, hostname AS label, platform AS detail, 0 AS host_count FROM hosts WHERE contains(hostname, 'o') ORDER BY label, id LIMIT 100)
UNION ALL SELECT * FROM (SELECT 'user', username, username, email, 0 FROM users WHERE contains(username, 'o') OR contains(email, 'o') ORDER BY 2 LIMIT 100)
UNION ALL SELECT * FROM (SELECT 'software', name, display_name, NULL, count(host_id) AS n FROM software LEFT JOIN installed_on USING (name) WHERE contains(name, 'o') OR contains(display_name, 'o') GROUP BY ALL ORDER BY n DESC, 2 LIMIT 100)""")
def flt5_search(inv):
    return scope.search(inv, "O")


@query(""", titles AS (SELECT name FROM software LEFT JOIN installed_on USING (name) WHERE contains(name, 'slack') OR contains(display_name, 'slack') GROUP BY name ORDER BY count(host_id) DESC, name LIMIT 100)
SELECT DISTINCT 'software_' || name AS src, 'host_' || host_id AS dst, 'INSTALLED_ON' AS kind FROM installed_on SEMI JOIN titles USING (name) SEMI JOIN hosts USING (host_id)""")
def flt6_search_links(inv):
    return scope.search_links(inv, scope.search(inv, "slack"))
