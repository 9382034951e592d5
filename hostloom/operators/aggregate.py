"""Counts, inventories and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostloom.functions import lists
from hostloom.plans.inventory import Inventory

#: LIST_LIMIT bounds the lists of names in a report's row; the tables behind them hold all.
LIST_CAP, LIST_LIMIT = 500, 10_000


def platform_thresholds(hosts: DataFrame, share: float = lists.OUTLIER_SHARE) -> DataFrame:
    """(platform, hosts, threshold) per non-empty platform: a share of its hosts, at least two. A share outside (0, 1) is the default."""
    share = share if 0 < share < 1 else lists.OUTLIER_SHARE
    return hosts.where(F.coalesce("platform", F.lit("")) != "").groupBy("platform").agg(F.count("*").alias("hosts")).withColumn("threshold", F.greatest(F.lit(lists.OUTLIER_HOSTS), F.floor(F.col("hosts") * share)).cast("long"))


def fleet_totals(inv: Inventory) -> DataFrame:
    """One row: hosts, users with a host, software with a host, uncategorised software with a host, teams."""
    hosts = inv.hosts.agg(F.count("*").alias("hosts"), F.count_distinct("team_id").alias("teams"))
    users = inv.uses.join(inv.hosts, "host_id", "left_semi").agg(F.count_distinct("username").alias("users"))
    held = inv.software.join(inv.installed_on, "name", "left_semi")
    software = held.agg(F.count("*").alias("software"), F.count_if(F.coalesce(F.size("category"), F.lit(0)) < 1).alias("uncategorised"))
    return hosts.crossJoin(users).crossJoin(software)


def software_inventory(inv: Inventory, limit: int = LIST_CAP, versions: int = 25) -> DataFrame:
    """(name, display_name, host_count, versions): installed titles, most hosts first, then by name; the first
    versions in order. Versions are gathered for the listed titles only."""
    counted = inv.installed_on.groupBy("name").agg(F.count_distinct("host_id").alias("host_count")).orderBy(F.desc("host_count"), "name").limit(limit)
    seen = inv.installed_on.join(F.broadcast(counted.select("name")), "name", "left_semi").where(F.coalesce("version", F.lit("")) != "").select("name", "version").distinct()
    listed = first_of_each(seen, ["name"], "version", "versions", versions)
    return counted.join(inv.software.select("name", "display_name"), "name", "left").join(listed, "name", "left").select("name", "display_name", "host_count", F.coalesce("versions", F.array().cast("array<string>")).alias("versions"))


def label_inventory(inv: Inventory) -> DataFrame:
    """(label_id, name, host_count): labels with the number of their present hosts, by name."""
    n = inv.has_label.join(inv.hosts, "host_id", "left_semi").groupBy("label_id").agg(F.count_distinct("host_id").alias("host_count"))
    return inv.labels.join(n, "label_id", "left").select("label_id", "name", F.coalesce("host_count", F.lit(0)).alias("host_count")).orderBy("name")


def host_list(inv: Inventory, limit: int = LIST_CAP) -> DataFrame:
    return inv.hosts.orderBy("hostname", "host_id").limit(limit)


def user_host_list(inv: Inventory, limit: int = LIST_CAP) -> DataFrame:
    """(username, hostname): distinct, in order."""
    return inv.uses.join(inv.hosts, "host_id").select("username", "hostname").distinct().orderBy("username", "hostname").limit(limit)


def teams(inv: Inventory) -> DataFrame:
    return inv.hosts.where(F.col("team_id").isNotNull()).select("team_id", "team_name").distinct().orderBy("team_id")


def platforms(inv: Inventory) -> DataFrame:
    return inv.hosts.where(F.coalesce("platform", F.lit("")) != "").select("platform").distinct().orderBy("platform")


def first_of_each(rows: DataFrame, by: list[str], column: str, alias: str, limit: int) -> DataFrame:
    """(*by, alias): the first `limit` values of each group, sorted. Rows are distinct and not null. Each map task sends at
    most `limit` of a group, so a group of any size fits."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(column))).where(F.col("_n") <= limit)
    return first.groupBy(*by).agg(F.sort_array(F.collect_list(column)).alias(alias))


def users_of(inv: Inventory, names: DataFrame, hosts: DataFrame) -> DataFrame:
    """(name, username): distinct users of each title's hosts in scope, one row each. names: (name)."""
    wanted = inv.installed_on.select("name", "host_id").join(names.distinct(), "name", "left_semi").join(hosts.select("host_id"), "host_id", "left_semi")
    return wanted.join(inv.uses.where("username IS NOT NULL"), "host_id").select("name", "username").distinct()


def users_by_software(inv: Inventory, names: DataFrame, hosts: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """(name, users): sorted distinct users of each title's hosts in scope, the first `limit`; `users_of` has all."""
    return first_of_each(users_of(inv, names, hosts), ["name"], "username", "users", limit)


def detection_summary(found: DataFrame, hostnames: DataFrame, usernames: DataFrame) -> DataFrame:
    """(measure, value, n): counts in all, by level, category and type in one pass of grouping sets, and the distinct hosts
    and users. found: findings; hostnames, usernames: all hosts and users of them (`detect.affected`), not the lists in rows."""
    by = found.groupingSets([[], ["risk_level"], ["category"], ["detection_type"]], "risk_level", "category", "detection_type").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    names = F.create_map(*[F.lit(x) for pair in ((7, "total"), (3, "risk_level"), (5, "category"), (6, "detection_type")) for x in pair])
    counts = by.select(F.element_at(names, F.col("g").cast("int")).alias("measure"), F.coalesce("risk_level", "category", "detection_type", F.lit("all")).alias("value"), "n")
    distinct = [df.agg(F.count_distinct(c).alias("n")).select(F.lit(m).alias("measure"), F.lit("all").alias("value"), "n") for m, df, c in (("affected_hosts", hostnames, "hostname"), ("affected_users", usernames, "username"))]
    return counts.unionByName(distinct[0]).unionByName(distinct[1])


def extension_groups(inv: Inventory) -> DataFrame:
    """(key, host_count, version_count, platforms): installs of browser extensions by canonical key (`name:<name>` without one)."""
    ext = inv.installed_on.where(F.col("source").isin(*lists.BROWSER_EXTENSION_SOURCES)).join(inv.hosts.select("host_id", "platform"), "host_id")
    key = F.coalesce("extension_key", F.concat(F.lit("name:"), "name"))
    return ext.groupBy(key.alias("key")).agg(F.count_distinct("host_id").alias("host_count"), F.count_distinct("version").alias("version_count"), F.sort_array(F.collect_set("platform")).alias("platforms"))


def extension_inventory(inv: Inventory, scores: DataFrame | None = None, limit: int = LIST_CAP) -> DataFrame:
    """(key, name, risk_score, risk_band, hostname_count, hostnames, versions): scored keys first, highest risk, then
    most hostnames, then key; 50 hostnames and 20 versions in order. scores: (key, risk_score, risk_band)."""
    ext = inv.installed_on.where(F.col("source").isin(*lists.BROWSER_EXTENSION_SOURCES)).join(inv.hosts.select("host_id", "hostname"), "host_id")
    ext = ext.withColumn("key", F.coalesce("extension_key", F.concat(F.lit("name:"), "name")))
    counted = ext.groupBy("key").agg(F.min("name").alias("name"), F.count_distinct(F.nullif("hostname", F.lit(""))).alias("hostname_count"))
    none = inv.software.sparkSession.createDataFrame([], "key string, risk_score int, risk_band string")
    top = counted.join(scores if scores is not None else none, "key", "left").orderBy(F.desc_nulls_last("risk_score"), F.desc("hostname_count"), "key").limit(limit)
    shown = ext.join(F.broadcast(top.select("key")), "key", "left_semi")
    out, none = top, F.array().cast("array<string>")
    for column, alias, most in (("hostname", "hostnames", 50), ("version", "versions", 20)):
        values = shown.where(F.col(column).isNotNull() & (F.lit(column == "version") | (F.col(column) != ""))).select("key", column).distinct()
        out = out.join(first_of_each(values, ["key"], column, alias, most), "key", "left").withColumn(alias, F.coalesce(alias, none))
    return out.select("key", "name", "risk_score", "risk_band", "hostname_count", "hostnames", "versions")


def extension_band_summary(scored: DataFrame) -> DataFrame:
    """(risk_band, extensions): distinct keys per band (null: unassessed) and in all (`total`). scored: (key, risk_band)."""
    by = scored.groupBy(F.coalesce("risk_band", F.lit("unassessed")).alias("risk_band")).agg(F.count_distinct("key").alias("extensions"))
    return by.unionByName(scored.agg(F.count_distinct("key").alias("extensions")).select(F.lit("total").alias("risk_band"), "extensions"))


def extension_detail(inv: Inventory, keys: DataFrame) -> DataFrame:
    """(key, hostname, version, last_seen): one row per hostname and key, the latest seen (then the greatest version). keys: (key)."""
    ext = inv.installed_on.withColumn("key", F.coalesce("extension_key", F.concat(F.lit("name:"), "name"))).join(keys.distinct(), "key", "left_semi").join(inv.hosts.select("host_id", "hostname"), "host_id")
    return ext.groupBy("key", "hostname").agg(F.max(F.struct(ext["last_seen"], "version")).alias("m")).select("key", "hostname", "m.version", "m.last_seen")


def extension_matrix(extensions: DataFrame) -> DataFrame:
    """(risk_band, p1, p2_4, p5_9, p10): extensions by band and number of hosts; those without a host count are left out."""
    n = F.col("host_count")
    bucket = F.when(n == 1, "p1").when(n.between(2, 4), "p2_4").when(n.between(5, 9), "p5_9").when(n >= 10, "p10")
    counted = extensions.withColumn("bucket", bucket).where(F.col("bucket").isNotNull()).groupBy(F.coalesce("risk_band", F.lit("unassessed")).alias("risk_band")).pivot("bucket", ["p1", "p2_4", "p5_9", "p10"]).count()
    return counted.na.fill(0)


def enrichment_coverage(extensions: DataFrame) -> DataFrame:
    """Per store: total, with_id, listed, with_users, with_rating, with_manifest and the first 5 errors in order."""
    return extensions.groupBy("store").agg(
        F.count("*").alias("total"), F.count_if(F.coalesce("extension_id", F.lit("")) != "").alias("with_id"), F.count_if(F.col("status").isin("public", "unlisted")).alias("listed"),
        F.count("users").alias("with_users"), F.count("rating").alias("with_rating"), F.count("manifest_version").alias("with_manifest"),
        F.slice(F.sort_array(F.collect_set("error")), 1, 5).alias("errors"),
    )


def diff_counts(changes: DataFrame) -> DataFrame:
    """(bucket, kind, n, share): rollup of a diff's rows; nulls stand for totals."""
    total = F.sum(F.when(F.col("bucket").isNull(), F.col("n"))).over(Window.partitionBy())
    return changes.rollup("bucket", "kind").agg(F.count("*").alias("n")).select("bucket", "kind", "n", (F.col("n") / total).alias("share"))
