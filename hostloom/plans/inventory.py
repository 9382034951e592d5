"""The inventory tables, derived from the driver's test tables: a fixed mapping, in Spark and in SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the mapping.
PLATFORMS = {"MACHINERY": "darwin", "BUILDING": "windows", "AUTOMOBILE": "ubuntu", "FURNITURE": "rhel", "HOUSEHOLD": "chrome"}
TITLES = {0: "teamviewer ", 1: "dropbox ", 2: "telegram desktop ", 3: "xmrig ", 4: "nordvpn ", 5: "slack ", 6: "google chrome ", 7: "lib", 8: "app"}
ENDINGS = {5: ".0", 6: ".0", 8: " helper"}
SOURCES = ("apps", "programs", "homebrew_packages", "chrome_extensions", "firefox_addons", "npm_packages", "deb_packages", "vscode_extensions")
SNAPSHOT_A, SNAPSHOT_B = "1998-01-01", "1999-07-01"


@dataclass(frozen=True)
class Inventory:
    """hosts, users, software, labels and the edge tables uses, installed_on, has_label."""

    hosts: DataFrame
    users: DataFrame
    software: DataFrame
    labels: DataFrame
    uses: DataFrame
    installed_on: DataFrame
    has_label: DataFrame


def inventory(spark: SparkSession, sf_dir: str) -> Inventory:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    customer, nation, orders, part, lineitem, events = map(t, ("customer", "nation", "orders", "part", "lineitem", "events"))

    seen = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_seen"))
    platform = F.coalesce(*[F.when(F.col("c_mktsegment") == k, v) for k, v in PLATFORMS.items()])
    hosts = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(seen, "c_custkey", "left")
        .select(F.col("c_custkey").alias("host_id"), F.concat(F.lit("host-"), F.col("c_custkey") % 700).alias("hostname"), platform.alias("platform"), F.col("c_nationkey").cast("long").alias("team_id"), F.col("n_name").alias("team_name"), "last_seen")
    )
    key, kind = F.col("p_partkey").cast("string"), F.col("p_partkey") % 20
    plain = F.concat_ws("-", F.lower(F.trim("p_name")), key)
    name = F.coalesce(*[F.when(kind == k, F.concat(F.lit(v), key, F.lit(ENDINGS.get(k, "")))) for k, v in TITLES.items()], plain)
    source = F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("p_size") % 8 + 1).cast("int"))
    software = part.select("p_partkey", name.alias("name"), F.when(kind == 9, "adgaurd").otherwise(name).alias("display_name"), source.alias("source"), F.col("p_brand").alias("vendor"), F.col("p_type"), F.col("p_size"), F.col("p_retailprice"))
    letters = F.translate(F.md5(F.col("name").cast("binary")), "0123456789abcdef", "abcdefghijklmnop")
    store = F.when(F.col("source") == "chrome_extensions", "chrome").when(F.col("source") == "firefox_addons", "firefox")
    ext_id = F.when(F.col("source") == "chrome_extensions", letters).when(F.col("source") == "firefox_addons", F.concat(F.lit("addon-"), F.col("p_partkey"), F.lit("@example.org")))
    software = software.withColumns({"store": store, "extension_id": ext_id}).select("*", F.concat(F.lit("ext:"), "store", F.lit(":"), "extension_id").alias("extension_key"), F.array("source").alias("sources"), F.array("p_type").alias("category"))

    returned = lineitem.where(F.col("l_returnflag") == "R").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    version = F.concat_ws(".", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"))
    edges = returned.groupBy(F.col("l_partkey").alias("p_partkey"), F.col("o_custkey").alias("host_id")).agg(F.max(F.struct("l_shipdate", version.alias("version"))).alias("last"), F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"))
    installed_on = edges.join(software.select("p_partkey", "name", "source", "extension_key"), "p_partkey").select("name", "host_id", F.col("last.version").alias("version"), "source", "extension_key", "first_seen", "last_seen", "p_partkey")

    signups = events.where(F.col("event_type") == "signup")
    total = customer.agg(F.count("*").alias("n_hosts"))
    uses = signups.crossJoin(F.broadcast(total)).select(F.concat(F.lit("user-"), F.col("user_id")).alias("username"), (F.col("event_id") % F.col("n_hosts")).alias("host_id")).distinct()
    users = uses.select("username", F.concat("username", F.lit("@example.org")).alias("email")).distinct()

    marked = orders.select(F.col("o_custkey").alias("host_id"), F.col("o_orderpriority").alias("label")).distinct()
    labels = marked.select("label").distinct().select(F.substring_index("label", "-", 1).cast("long").alias("label_id"), F.col("label").alias("name"))
    has_label = marked.select("host_id", F.substring_index("label", "-", 1).cast("long").alias("label_id"), "label")
    return Inventory(hosts, users, software, labels, uses, installed_on, has_label)


def _case(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in values.items()) + " END"


_NAME = "CASE p_partkey % 20 " + " ".join(f"WHEN {k} THEN '{v}' || p_partkey || '{ENDINGS.get(k, '')}'" for k, v in TITLES.items()) + " ELSE lower(trim(p_name)) || '-' || p_partkey END"

#: Common table expressions with the same tables; oracle queries follow after a comma.
SQL = f"""WITH RECURSIVE hosts AS (
  SELECT c_custkey AS host_id, 'host-' || (c_custkey % 700) AS hostname, {_case("c_mktsegment", PLATFORMS)} AS platform,
    CAST(c_nationkey AS BIGINT) AS team_id, n_name AS team_name, last_seen
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_seen FROM orders GROUP BY 1) ON o_custkey = c_custkey),
software0 AS (
  SELECT p_partkey, {_NAME} AS name, {_case("p_size % 8", dict(enumerate(SOURCES)))} AS source, p_brand AS vendor, p_type, p_size, p_retailprice FROM part),
software1 AS (
  SELECT *, CASE WHEN p_partkey % 20 = 9 THEN 'adgaurd' ELSE name END AS display_name, [source] AS sources, [p_type] AS category,
    CASE source WHEN 'chrome_extensions' THEN 'chrome' WHEN 'firefox_addons' THEN 'firefox' END AS store,
    CASE source WHEN 'chrome_extensions' THEN translate(md5(name), '0123456789abcdef', 'abcdefghijklmnop') WHEN 'firefox_addons' THEN 'addon-' || p_partkey || '@example.org' END AS extension_id FROM software0),
software AS (SELECT *, 'ext:' || store || ':' || extension_id AS extension_key FROM software1),
installed_on AS (
  SELECT s.name, e.host_id, e.last.version AS version, s.source, s.extension_key, first_seen, last_seen, p_partkey
  FROM (SELECT l_partkey, o_custkey AS host_id, max({{'d': l_shipdate, 'version': l_linenumber || '.' || CAST(l_quantity AS INTEGER)}}) AS last, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 2) e JOIN software s ON s.p_partkey = e.l_partkey),
uses AS (SELECT DISTINCT 'user-' || user_id AS username, event_id % (SELECT count(*) FROM customer) AS host_id FROM events WHERE event_type = 'signup'),
users AS (SELECT DISTINCT username, username || '@example.org' AS email FROM uses),
has_label AS (SELECT DISTINCT o_custkey AS host_id, CAST(split_part(o_orderpriority, '-', 1) AS BIGINT) AS label_id, o_orderpriority AS label FROM orders),
inv_labels AS (SELECT DISTINCT label_id, label AS name FROM has_label)
"""
