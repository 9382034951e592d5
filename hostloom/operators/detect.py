"""Rare, high-risk and sprawling software, and the predicates behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.functions import lists
from hostloom.functions.shared import settle
from hostloom.functions.values import word_match
from hostloom.operators.aggregate import LIST_LIMIT, first_of_each, platform_thresholds
from hostloom.operators.scope import exclude_whitelisted
from hostloom.plans.inventory import Inventory

KINDS, COUNTS = ("outlier", "high_risk", "version_sprawl"), ("1", "2", "3+")


def _clean(sources: Column) -> Column:
    return F.filter(F.transform(sources, lambda s: F.lower(F.trim(s))), lambda s: s.isNotNull() & (s != ""))


def _any_of(sources: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(_clean(sources), F.array(*map(F.lit, names))), F.lit(False))


def _all_of(sources: Column, names: tuple[str, ...]) -> Column:
    s = _clean(sources)
    return F.coalesce((F.size(s) > 0) & (F.size(F.array_except(s, F.array(*map(F.lit, names)))) == 0), F.lit(False))


def whole_name(patterns: tuple[str, ...]) -> str:
    return r"(?i)\A(?:" + "|".join(patterns) + r")\z"


def is_system_package(name: Column, categories: Column, sources: Column, linux_packages: bool = False) -> Column:
    """OS plumbing, language packages, Linux packages (unless asked for), helpers, names without a letter or digit,
    or a system category. A null or empty name is not one. Evaluate once per title, never per install."""
    nm = F.lower(F.trim(name))
    by_source = _all_of(sources, lists.DEV_LANGUAGE_SOURCES)
    if not linux_packages:
        by_source = by_source | _all_of(sources, lists.LINUX_PACKAGE_SOURCES)
    told = F.lower(F.array_join(F.coalesce(categories, F.array().cast("array<string>")), " "))
    by_category = F.lit(False)
    for token in lists.SYSTEM_CATEGORIES:
        by_category = by_category | told.contains(token)
    by_name = ~nm.rlike(r"[\p{L}\p{N}]") | nm.rlike(whole_name(lists.SYSTEM_PATTERNS)) | nm.rlike(whole_name(lists.HELPER_PATTERNS))
    return F.when(F.coalesce(name, F.lit("")) == "", False).otherwise(by_source | by_name | by_category)


def software_type(name: Column, sources: Column) -> Column:
    """The install source decides extensions; else the first hint in the name; else Application."""
    n = F.lower(F.coalesce(name, F.lit("")))
    out = F.when(_any_of(sources, lists.BROWSER_EXTENSION_SOURCES), "Browser Extension").when(_any_of(sources, lists.IDE_EXTENSION_SOURCES), "VSCode Extension")
    for table, test in ((lists.NAME_CONTAINS, n.contains), (lists.NAME_STARTS, n.startswith), (lists.NAME_CONTAINS_LATE, n.contains)):
        for kind, words in table:
            found = F.lit(False)
            for w in words:
                found = found | test(w)
            out = out.when(found, kind)
    return out.otherwise("Application")


def high_risk_category(name: Column, display_name: Column, categories: Column) -> Column:
    """The first curated category that a category of the title, else its name or display name matches; else null."""
    of = lambda text, wide: F.coalesce(*[F.when(word_match(text, ((c.lower(), *words) if wide else words)), c) for c, words in lists.HIGH_RISK.items()])
    by_category = F.filter(F.transform(F.coalesce(categories, F.array().cast("array<string>")), lambda c: of(F.lower(c), True)), lambda x: x.isNotNull())
    shown = F.lower(F.coalesce(F.nullif(display_name, F.lit("")), name))
    by_name = F.coalesce(*[F.when(word_match(F.lower(name), words) | word_match(shown, words), c) for c, words in lists.HIGH_RISK.items()])
    return F.coalesce(F.get(by_category, 0), by_name)


def installs(inv: Inventory, hosts: DataFrame, whitelist: DataFrame | None = None) -> DataFrame:
    """Installs on hosts in scope, with hostname and platform, minus approved titles."""
    edges = inv.installed_on.select("name", "host_id", "version").join(hosts.select("host_id", "hostname", "platform"), "host_id")
    return edges if whitelist is None else edges.join(exclude_whitelisted(inv.software, whitelist).select("name"), "name", "left_semi")


def scope_threshold(inv: Inventory, platform: str | None = None, share: float = lists.OUTLIER_SHARE) -> DataFrame:
    """One row (threshold): the largest threshold of the platforms that fit the filter, else of all; without any
    platform, from the number of hosts."""
    t = platform_thresholds(inv.hosts, share)
    fits = F.lower("platform").contains(platform.lower()) if platform and platform != "all" else F.lit(True)
    by_platform = t.agg(F.coalesce(F.max(F.when(fits, F.col("threshold"))), F.max("threshold")).alias("t"))
    by_hosts = inv.hosts.agg(F.greatest(F.lit(lists.OUTLIER_HOSTS), F.floor(F.greatest(F.count("*"), F.lit(1)) * share)).cast("long").alias("h"))
    return by_platform.crossJoin(by_hosts).select(F.coalesce("t", "h").alias("threshold"))


def _title_facts(inv: Inventory, edges: DataFrame, kinds: set[str]) -> DataFrame:
    """One row per installed title: its counts, and what its name, categories and sources tell. One shuffle by title and one
    run of the patterns serve all kinds; only what `kinds` need is counted and matched. Known tells whether software has it."""
    told = F.when(_has_version(), F.col("version"))
    counts = [F.count_distinct("host_id").alias("host_count")]
    if "version_sprawl" in kinds:
        counts += [F.count_distinct(told).alias("version_count"), F.count_distinct(F.when(told.isNotNull(), F.col("host_id"))).alias("versioned_hosts")]
    has = set(inv.software.columns)
    extra = {c: F.col(c) if c in has else F.lit(None).cast(t) for c, t in (("risk_band", "string"), ("risk_score", "int"), ("is_builtin", "boolean"))}
    matched = high_risk_category(F.col("name"), F.col("display_name"), F.col("category")) if "high_risk" in kinds else F.lit(None).cast("string")
    last = F.col("last_version") if "last_version" in has else F.lit(None).cast("string")
    titles = inv.software.select("name", "display_name", "sources", last.alias("version"), is_system_package(F.col("name"), F.col("category"), F.col("sources")).alias("is_system"), matched.alias("matched"), *[v.alias(k) for k, v in extra.items()], F.lit(True).alias("known"))
    return edges.groupBy("name").agg(*counts).join(titles, "name", "left")


def _has_version() -> Column:
    return F.col("version").isNotNull() & ~F.col("version").isin("", "unknown")


def _outliers(facts: DataFrame, threshold: DataFrame) -> DataFrame:
    rare = facts.where("known AND NOT is_system").crossJoin(F.broadcast(threshold)).where(F.col("host_count") <= F.col("threshold"))
    rank = lambda c: F.when(c == "high", 2).when(c == "medium", 1).otherwise(0)
    counted = F.when(F.col("host_count") == 1, "high").otherwise("medium")
    banded = F.coalesce(*[F.when(F.col("risk_band") == k, v) for k, v in lists.BAND_LEVELS.items()])
    takes = banded.isNotNull() & (~F.coalesce("is_builtin", F.lit(False)) | (rank(banded) > rank(counted)))
    level = F.when(takes, banded).otherwise(counted)
    # Texts of the report.
    reason = F.when(takes, F.format_string("Risk is %s from the browser-extension risk score (%s/100, band %s). Installed on %d host(s).", F.upper(level), F.col("risk_score").cast("string"), "risk_band", "host_count")).otherwise(
        F.format_string("Risk is %s because this software is installed on only %d host(s) (<%d threshold).", F.upper(level), "host_count", "threshold"))
    details = F.format_string("Installed on %d host(s) only - unusual for enterprise software", "host_count")
    return _findings(rare, level, F.lit("Outlier Software"), "outlier", details, F.format_string("Verify if this software is authorized. Found on only %d host(s). Consider removing if unauthorized.", "host_count"), reason)


def _high_risk(facts: DataFrame) -> DataFrame:
    found = facts.where("known AND NOT is_system AND matched IS NOT NULL")
    advice = F.coalesce(*[F.when(F.col("matched") == k, v) for k, v in lists.ADVICE.items()])
    # Texts of the report.
    reason = F.format_string("Risk is HIGH because '%s' matches the '%s' category, which is flagged for security review.", "name", "matched")
    return _findings(found, F.lit("high"), F.col("matched"), "high_risk", F.concat(F.lit("High-risk category: "), "matched"), advice, reason)


def _sprawl(facts: DataFrame, top: int) -> DataFrame:
    most = facts.where("version_count > 2").orderBy(F.desc("version_count"), "name").limit(top).where("known AND NOT is_system").withColumn("host_count", F.col("versioned_hosts"))
    level = F.when(F.col("version_count") > 5, "high").when(F.col("version_count") > 3, "medium").otherwise("low")
    # Texts of the report.
    details = F.format_string("Version sprawl detected - %d different versions installed", "version_count")
    advice = F.format_string("Standardize software versions across fleet. Currently running %d different versions.", "version_count")
    reason = F.format_string("Risk is %s because there are %d distinct versions installed, indicating poor patch management.", F.upper(level), "version_count")
    return _findings(most, level, F.lit("Version Management"), "version_sprawl", details, advice, reason)


def _findings(df: DataFrame, level: Column, category: Column, kind: str, details: Column, advice: Column, reason: Column) -> DataFrame:
    count = F.col("version_count") if kind == "version_sprawl" else F.lit(None)
    return df.select(
        F.col("name").alias("software_name"), F.coalesce(F.nullif("display_name", F.lit("")), "name").alias("display_name"), software_type(F.col("name"), F.col("sources")).alias("software_type"),
        level.alias("risk_level"), category.alias("category"), F.lit(kind).alias("detection_type"), F.col("host_count").cast("long").alias("host_count"), F.coalesce(F.nullif("version", F.lit("")), F.lit("Unknown")).alias("version"),
        details.alias("details"), advice.alias("recommendation"), reason.alias("risk_reason"), count.cast("long").alias("version_count"),
    )


def affected(inv: Inventory, found: DataFrame, hosts: DataFrame, whitelist: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((software_name, detection_type, hostname), (software_name, username)): all hosts and users of findings, one row each.
    Hosts of a sprawling title are those that tell a version."""
    names = found.select("software_name", "detection_type").distinct()
    return _affected(inv, installs(inv, hosts, whitelist), names)


def _affected(inv: Inventory, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`affected` of the titles in names (software_name, detection_type), by their installs."""
    on = edges.where("hostname IS NOT NULL").groupBy("name", "hostname").agg(F.max(_has_version()).alias("told"))
    on = on.join(names, F.col("name") == F.col("software_name")).where("detection_type <> 'version_sprawl' OR told").select("software_name", "detection_type", "hostname")
    of = edges.select("name", "host_id").join(names.select(F.col("software_name").alias("name")).distinct(), "name", "left_semi").join(inv.uses.where("username IS NOT NULL"), "host_id")
    return on, of.select(F.col("name").alias("software_name"), "username").distinct()


def _with_lists(inv: Inventory, found: DataFrame, hosts: DataFrame, whitelist: DataFrame | None, limit: int, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Adds the lists, for the titles found only, each at most `limit` long. Versions are listed for sprawling titles only.
    For several kinds the installs of the titles found are settled once, and all lists are taken from there."""
    if len(kinds) > 1:
        found = settle(found)
    names = found.select("software_name", "detection_type").distinct()
    edges = installs(inv, hosts, whitelist).join(names.select(F.col("software_name").alias("name")).distinct(), "name", "left_semi")
    edges = settle(edges) if len(kinds) > 1 else edges
    on, of = _affected(inv, edges, names)
    out = found.join(first_of_each(on, ["software_name", "detection_type"], "hostname", "affected_hosts", limit), ["software_name", "detection_type"], "left")
    out = out.join(first_of_each(of, ["software_name"], "username", "affected_users", limit), "software_name", "left")
    if kinds == ("version_sprawl",):
        out = out.withColumn("platforms", F.lit(None).cast("array<string>"))
    else:
        out = out.join(edges.groupBy(F.col("name").alias("software_name")).agg(F.sort_array(F.collect_set("platform")).alias("platforms")), "software_name", "left")
    if "version_sprawl" in kinds:
        sprawling = found.where("detection_type = 'version_sprawl'").select(F.col("software_name").alias("name"))
        told = edges.where(_has_version()).join(sprawling, "name", "left_semi").select(F.col("name").alias("software_name"), "version").distinct()
        out = out.join(first_of_each(told, ["software_name"], "version", "versions", 3), "software_name", "left")
    else:
        out = out.withColumn("versions", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<string>")
    sprawl = F.col("detection_type") == "version_sprawl"
    shown = F.concat(F.col("version_count").cast("string"), F.lit(" versions: "), F.array_join("versions", ", "), F.when(F.col("version_count") > 3, "...").otherwise(""))
    return out.select(
        "software_name", "display_name", "software_type", "risk_level", "category", "detection_type", "host_count", F.coalesce("affected_hosts", none).alias("affected_hosts"), F.coalesce("affected_users", none).alias("affected_users"),
        F.when(sprawl, none).otherwise(F.coalesce("platforms", none)).alias("platforms"), F.when(sprawl, shown).otherwise(F.col("version")).alias("version"), "details", "recommendation", "risk_reason",
    )


def findings(inv: Inventory, hosts: DataFrame, whitelist: DataFrame | None = None, kinds: tuple[str, ...] = KINDS, platform: str | None = None, share: float = lists.OUTLIER_SHARE, top: int = 20) -> DataFrame:
    """Findings of the wanted kinds without lists. For several kinds the titles' facts are settled, so installs are read once."""
    facts = _title_facts(inv, installs(inv, hosts, whitelist), set(kinds))
    if len(kinds) > 1:
        facts = settle(facts)
    made = {"outlier": lambda: _outliers(facts, scope_threshold(inv, platform, share)), "high_risk": lambda: _high_risk(facts), "version_sprawl": lambda: _sprawl(facts, top)}
    parts = [f() for k, f in made.items() if k in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def detect_outliers(inv: Inventory, hosts: DataFrame, whitelist: DataFrame | None = None, platform: str | None = None, share: float = lists.OUTLIER_SHARE, limit: int = LIST_LIMIT) -> DataFrame:
    """Titles on at most `threshold` hosts in scope, minus approved titles and system packages.

    One shuffle by title counts hosts; lists are gathered for rare titles only. One host is high, more are medium; an
    extension's band overrides (for built-ins only upward). Lists hold the first `limit` by name; `affected` has all.
    """
    return _with_lists(inv, findings(inv, hosts, whitelist, ("outlier",), platform, share), hosts, whitelist, limit, ("outlier",))


def detect_high_risk(inv: Inventory, hosts: DataFrame, whitelist: DataFrame | None = None, limit: int = LIST_LIMIT) -> DataFrame:
    """Titles of the curated categories on hosts in scope, always high. Titles are classified once, then joined. Lists hold
    the first `limit` by name, as such titles may be on every host; host_count counts all, and `affected` has all."""
    return _with_lists(inv, findings(inv, hosts, whitelist, ("high_risk",)), hosts, whitelist, limit, ("high_risk",))


def detect_version_sprawl(inv: Inventory, hosts: DataFrame, whitelist: DataFrame | None = None, top: int = 20, limit: int = LIST_LIMIT) -> DataFrame:
    """The `top` titles with the most (more than 2) versions on hosts in scope, ties by name, system packages dropped
    after that. Null, empty and `unknown` versions don't count. Lists as in `detect_high_risk`."""
    return _with_lists(inv, findings(inv, hosts, whitelist, ("version_sprawl",), top=top), hosts, whitelist, limit, ("version_sprawl",))


def detections(inv: Inventory, hosts: DataFrame, whitelist: DataFrame | None = None, risk: str = "all", kind: str = "all", host_count: str = "all", user_count: str = "all", software_kind: str = "all", platform: str | None = None, limit: int = LIST_LIMIT) -> DataFrame:
    """All three kinds with one schema, filtered. Counts: `1`, `2`, `3+`; anything else doesn't filter. Findings are
    filtered before their lists (first `limit` by name) are gathered."""
    if limit < 3:
        raise ValueError("a list takes at least 3")
    kinds = KINDS if kind == "all" else (kind,)
    out = findings(inv, hosts, whitelist, kinds, platform)
    by_count = lambda n, wanted: n >= 3 if wanted == "3+" else n == int(wanted)
    for test in (F.col("risk_level") == risk if risk != "all" else None, F.col("software_type") == software_kind if software_kind != "all" else None, by_count(F.col("host_count"), host_count) if host_count in COUNTS else None):
        out = out if test is None else out.where(test)
    out = _with_lists(inv, out, hosts, whitelist, limit, kinds)
    return out.where(by_count(F.size("affected_users"), user_count)) if user_count in COUNTS else out


def decide_findings(inv: Inventory, share: float = lists.OUTLIER_SHARE, top: int = 50) -> DataFrame:
    """Titles of user apps and extensions that are rare on some platform, by that platform's own threshold; the lowest
    count over such platforms; uncategorised first, then rarest, then by name; the first `top`."""
    return _rare_on_a_platform(inv, share, F.lit(True)).orderBy("categorised", "min_hosts", "name").limit(top).select("name", "min_hosts", "categorised")


def _rare_on_a_platform(inv: Inventory, share: float, wanted: Column) -> DataFrame:
    titles = inv.software.where(_any_of(F.col("sources"), lists.ELIGIBLE_SOURCES) & wanted).select("name", (F.coalesce(F.size("category"), F.lit(0)) > 0).alias("categorised"), "category", "sources")
    edges = inv.installed_on.select("name", "host_id").join(inv.hosts.select("host_id", "platform"), "host_id")
    per = edges.groupBy("name", "platform").agg(F.count_distinct("host_id").alias("n")).join(F.broadcast(platform_thresholds(inv.hosts, share)), "platform").where("n <= threshold")
    return per.groupBy("name").agg(F.min("n").alias("min_hosts")).join(titles, "name")


def enrichment_candidates(inv: Inventory, as_of: str, cooldown_days: int = 7, share: float = lists.OUTLIER_SHARE, limit: int = 500) -> DataFrame:
    """Titles to categorise: no category, an eligible source, no browser extension, last attempt (if any) before the
    cooldown, rare on some platform, no system package; rarest first."""
    has = set(inv.software.columns)
    last = F.col("last_attempt") if "last_attempt" in has else F.lit(None).cast("timestamp")
    wanted = (F.coalesce(F.size("category"), F.lit(0)) < 1) & ~_any_of(F.col("sources"), lists.BROWSER_EXTENSION_SOURCES) & (last.isNull() | (last < F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(cooldown_days))))
    found = _rare_on_a_platform(inv, share, wanted)
    return found.where(~is_system_package(F.col("name"), F.col("category"), F.col("sources"))).orderBy("min_hosts", "name").limit(limit).select("name", "min_hosts")
