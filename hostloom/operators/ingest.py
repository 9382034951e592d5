"""Host documents to tables: users, software rows, extension identities, and merges of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.functions import lists
from hostloom.functions.values import filled, first_filled, greatest_version
from hostloom.sources.readers import latest

# Vendor component extensions, install roots, store formats.
BUILTIN_SUFFIXES = ("@mozilla.org", "@mozilla.com")
BUILTIN_IDS = (
    "aohghmighlieiainnegkcijnfilokake", "aapocclcgogkmnckokdopfmhonfmgoek", "felcaaldnbdncclmgdcncolpebgiejap", "ghbmnnjooekpmoecnnnilnnbdlolhkhi",
    "nmmhkkegccagdldgiimedpiccmgmieda", "mhjfbmdgcfjbbpaeojofohoefgiehjai", "nkeimhogjdpnpccoofpliimaahmaaome", "pkedcjkdefgpdelpbcmbmeomcjbeemfm",
)
CHROMIUM_STORES = ("chrome", "edge", "brave", "opera", "vivaldi", "chromium")
_WIN = r"[a-z]:\\(?:program files(?: \(x86\))?|users\\[^\\]+\\appdata\\local)\\"
BUILTIN_ROOTS = {
    "chrome": rf"^{_WIN}google\\chrome\\application\\",
    "edge": rf"^{_WIN}microsoft\\edge\\application\\",
    "brave": rf"^{_WIN}bravesoftware\\brave-browser\\application\\",
    "vivaldi": rf"^{_WIN}vivaldi\\application\\",
    "firefox": rf"^(?:{_WIN}mozilla firefox\\|\\applications\\firefox\.app\\contents\\resources\\|\\usr\\lib(?:64)?\\firefox(?:-esr)?\\)browser\\features\\",
    "safari": r"^\\(?:applications\\safari\.app|system)\\",
}
CHROMIUM_ID = r"(?<![A-Za-z0-9_])([a-p]{32})(?![A-Za-z0-9_])"
FIREFOX_ID = r"^(?:\{[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\}|[A-Za-z0-9._+-]*@[A-Za-z0-9._-]+)$"
SAFARI_APPEX = r"^(/Applications/[^/]+\.app)/Contents/PlugIns/([^/]+\.appex)/?$"


def host_user_identifiers(docs: DataFrame) -> DataFrame:
    """(host_id, users): distinct user names of a host: users[] (username, else email, else display_name; bare text as it
    is), primary_user and owner. A document without a users list, primary_user and owner has null, an empty list stays
    empty: the first leaves stored users alone, the second clears them."""
    parsed = F.transform("users", lambda u: F.struct(F.from_json(u, "username string, email string, display_name string").alias("o"), u.alias("raw")))
    names = F.transform(parsed, lambda p: F.when(F.startswith(F.ltrim(p["raw"]), F.lit("{")), first_filled(p["o"]["username"], p["o"]["email"], p["o"]["display_name"])).otherwise(filled(F.trim(p["raw"]))))
    more = F.array(filled(F.trim("primary_user")), filled(F.trim("owner")))
    every = F.array_distinct(F.filter(F.concat(F.coalesce(names, F.array().cast("array<string>")), more), lambda x: x.isNotNull()))
    return docs.select(F.col("id").alias("host_id"), F.when(F.col("users").isNotNull() | (F.size(every) > 0), every).alias("users"))


def uses_edges(docs: DataFrame) -> DataFrame:
    """(username, host_id), distinct."""
    return host_user_identifiers(docs).select(F.explode("users").alias("username"), "host_id").distinct()


def known_users(uses: DataFrame, users: DataFrame) -> DataFrame:
    """(username, email, fullname) of users on hosts; attributes from the global list where it has them."""
    rest = [c for c in users.columns if c != "username"]
    once = users.groupBy("username").agg(F.max(F.struct(*rest)).alias("v")).select("username", "v.*")  # of several, always the same
    return uses.select("username").distinct().join(once, "username", "left")


def explode_software(docs: DataFrame) -> DataFrame:
    """(host_id, pos, name, version, source, ... , key): one row per host and title, the first one listed.

    Names are trimmed and lower-cased, empty ones dropped; version `unknown` by default. Browser extensions get their
    identity and are known by their key, other titles by name.
    """
    rows = docs.select(F.col("id").alias("host_id"), F.posexplode("software").alias("pos", "s")).select("host_id", "pos", "s.*")
    rows = rows.withColumn("name", F.lower(F.trim("name"))).where(F.coalesce("name", F.lit("")) != "")
    rows = rows.withColumn("version", F.coalesce(filled(F.trim("version")), F.lit("unknown"))).withColumn("source", F.trim(F.coalesce("source", F.lit(""))))
    rows = bind_safari_apps(extension_identity(rows))
    rows = rows.withColumn("key", F.coalesce("extension_key", "name"))
    return latest(rows, ["host_id", "key"], ["pos"])


def infer_store(source: Column, browser: Column, extension_for: Column, paths: Column) -> Column:
    told = F.lower(F.concat_ws(" ", browser, extension_for))
    by_path = lambda *parts: F.exists(paths, lambda p: F.lower(p).rlike("|".join(rf"\Q{x}\E" for x in parts)))
    chrome = F.lit(None).cast("string")
    for s in ("edge", "brave", "opera", "vivaldi", "chromium"):
        chrome = F.coalesce(chrome, F.when(told.contains(s), s))
    for s, parts in (("edge", ("microsoft\\edge", "microsoft edge.app")), ("brave", ("brave",)), ("opera", ("opera",)), ("vivaldi", ("vivaldi",))):
        chrome = F.coalesce(chrome, F.when(F.coalesce(by_path(*parts), F.lit(False)), s))
    return F.when(source == "firefox_addons", "firefox").when(source == "safari_extensions", "safari").when(source == "ie_extensions", "edge").when(source == "chrome_extensions", F.coalesce(chrome, F.lit("chrome")))


def extension_identity(rows: DataFrame) -> DataFrame:
    """Adds store, extension_id, extension_key, is_builtin (null for other titles) and keeps the first 10 paths.

    The id is the given one, else the first found in name, display name and paths: 32 letters a-p (Chromium), a GUID or
    address (Firefox), a dotted bundle id without space or @ (Safari). The key is ext:<store>:<id> in lower case, or
    ext:<store>:name:<hash of the name> where no id is known.
    """
    none = F.array().cast("array<string>")
    paths = F.filter(F.coalesce("installed_paths", none), lambda p: F.coalesce(p, F.lit("")) != "")
    source = F.lower(F.trim("source"))
    store = infer_store(source, F.col("browser"), F.col("extension_for"), paths)
    tried = F.filter(F.transform(F.concat(F.array("name", "display_name"), paths), lambda c: F.trim(c)), lambda c: F.coalesce(c, F.lit("")) != "")
    chromium = F.filter(F.transform(tried, lambda c: F.regexp_extract(c, CHROMIUM_ID, 1)), lambda x: x != "")
    firefox = F.filter(tried, lambda c: c.rlike(FIREFOX_ID))
    safari = F.filter(tried, lambda c: c.rlike(r"^[^ @]*\.[^ @]*\.[^ @]*$"))
    found = F.when(source.isin("chrome_extensions", "ie_extensions"), F.get(chromium, 0)).when(source == "firefox_addons", F.get(firefox, 0)).when(source == "safari_extensions", F.get(safari, 0))
    ext_id = F.when(store.isNotNull(), F.coalesce(filled(F.trim("extension_id")), found))
    named = F.substring(F.sha1(F.coalesce(filled("name"), "display_name", F.lit("")).cast("binary")), 1, 16)
    rows = rows.withColumns({"store": store, "extension_id": ext_id})
    key = F.when(F.col("store").isNotNull(), F.coalesce(F.lower(F.concat(F.lit("ext:"), "store", F.lit(":"), "extension_id")), F.concat(F.lit("ext:"), "store", F.lit(":name:"), named)))
    return rows.withColumns({"extension_key": key, "installed_paths": F.slice(paths, 1, 10), "installed_path": F.get(paths, 0), "is_builtin": F.when(F.col("store").isNotNull(), is_builtin(F.col("store"), F.col("extension_id"), paths))})


def _fits(pattern: str):
    return lambda x: F.coalesce(x.rlike(pattern), F.lit(False))


def is_builtin(store: Column, extension_id: Column, paths: Column) -> Column:
    """Whether a browser ships the extension itself: by id, Firefox id suffix, or a path anchored at its install root."""
    i = F.lower(F.trim(F.coalesce(extension_id, F.lit(""))))
    by_suffix = F.lit(False)
    for s in BUILTIN_SUFFIXES:
        by_suffix = by_suffix | i.endswith(s)
    root = F.coalesce(*[F.when(store == s, r) for s, r in BUILTIN_ROOTS.items()])
    own = F.transform(paths, lambda p: F.translate(F.lower(p), "/", "\\"))
    by_path = F.lit(False)
    for s, r in BUILTIN_ROOTS.items():
        by_path = by_path | ((store == s) & F.exists(own, _fits(r)))
    return F.coalesce((store == "firefox") & by_suffix | store.isin(*CHROMIUM_STORES) & i.isin(*BUILTIN_IDS) | root.isNotNull() & by_path, F.lit(False))


def bind_safari_apps(rows: DataFrame) -> DataFrame:
    """Safari extensions take the identity of the app that holds them on the same host: <bundle>/<appex>@<team or
    unsigned>; the app's name comes before theirs. Rows whose app isn't listed stay as they are."""
    app = F.nullif(F.regexp_extract("installed_path", SAFARI_APPEX, 1), F.lit(""))
    rows = rows.withColumn("_app", F.when(F.col("store") == "safari", app)).withColumn("_appex", F.regexp_extract("installed_path", SAFARI_APPEX, 2))
    team = F.get(F.filter(F.transform("signature_information", lambda s: s["team_identifier"]), lambda t: F.coalesce(t, F.lit("")) != ""), 0)
    apps = rows.where((F.col("source") == "apps") & (F.coalesce("bundle_identifier", F.lit("")) != "")).select(F.col("host_id").alias("_h"), F.explode("installed_paths").alias("_path"), F.col("bundle_identifier").alias("_bundle"), team.alias("_team"))
    apps = apps.groupBy("_h", "_path").agg(F.min(F.struct("_bundle", "_team")).alias("a"))
    joined = rows.join(apps, (F.col("host_id") == F.col("_h")) & (F.col("_app") == F.col("_path")), "left")
    bound = F.col("a").isNotNull()
    new_id = F.concat("a._bundle", F.lit("/"), "_appex", F.lit("@"), F.coalesce("a._team", F.lit("unsigned")))
    title = F.regexp_extract("_app", r"([^/]+)\.app$", 1)
    prefix = F.concat(title, F.lit(" › "))
    shown = F.coalesce(filled("display_name"), "name")
    out = joined.withColumns(
        {
            "display_name": F.when(F.col("_app").isNotNull() & ~F.startswith(shown, prefix), F.concat(prefix, shown)).otherwise(F.col("display_name")),
            "extension_key": F.when(bound, F.lower(F.concat(F.lit("ext:safari:"), new_id))).otherwise(F.col("extension_key")),
            "extension_id": F.when(bound, new_id).otherwise(F.col("extension_id")),
            "app_bundle_id": F.col("a._bundle"), "app_team_id": F.col("a._team"),
        }
    )
    return out.drop("_app", "_appex", "_h", "_path", "a")


def summarize_vulnerabilities(v: Column, first: int = 50) -> Column:
    """struct(count, max_cvss, records): count of all; the greatest of the first non-empty scores of the first 50; compact records as JSON."""
    some = F.slice(v, 1, first)
    score = lambda x: F.coalesce(x["cvss_score"], x["cvss"], x["cvss_v3_score"])
    records = F.to_json(F.transform(some, lambda x: F.struct(F.coalesce(filled(x["cve"]), x["cve_id"]).alias("cve"), score(x).alias("cvss_score"), x["epss_probability"].alias("epss"))))
    return F.struct(F.coalesce(F.size(v), F.lit(0)).cast("long").alias("vulnerability_count"), F.array_max(F.transform(some, score)).alias("max_cvss"), F.coalesce(records, F.lit("[]")).alias("records"))


def merge_case_variants(software: DataFrame, installed_on: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Titles that differ in case only become one in lower case, with all versions and sources; edges follow, one per title and host."""
    each = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(F.lit(c).alias("of"), x.alias("x")))
    values = F.concat(F.array(F.struct(F.lit("display_name").alias("of"), F.col("display_name").alias("x"))), each("versions"), each("sources"))
    parts = software.select(F.lower("name").alias("name"), F.explode(values).alias("p")).select("name", "p.*")
    held = lambda c: F.array_sort(F.collect_set(F.when(F.col("of") == c, F.col("x")))).alias(c)  # noqa: E731  (sets from the map side on: repeats are never gathered)
    merged = parts.groupBy("name").agg(F.min(F.when(F.col("of") == "display_name", F.col("x"))).alias("display_name"), held("versions"), held("sources"))
    edges = installed_on.withColumn("name", F.lower("name"))
    return merged, edges.groupBy("name", "host_id").agg(greatest_version().alias("version"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def merge_extension_keys(software: DataFrame, installed_on: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All titles of one extension_key become one, named by the key. The survivor whose attributes stay is the one named
    so already, else the shortest name that is no path, then the first. Edges keep what any has: min first, max last seen."""
    path = F.col("name").contains("/") | F.col("name").contains("\\")
    order = F.struct((F.lower("name") != F.col("extension_key")).alias("a"), path.alias("b"), F.length("name").alias("c"), F.col("name").alias("d"))
    ext = software.where(F.col("extension_key").isNotNull())
    nodes = ext.groupBy("extension_key").agg(F.min_by("name", order).alias("survivor"), F.min_by("display_name", order).alias("display_name"), F.count("*").alias("merged"))
    edges = installed_on.where(F.col("extension_key").isNotNull()).groupBy(F.col("extension_key").alias("name"), "host_id").agg(greatest_version().alias("version"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return nodes.withColumnRenamed("extension_key", "name"), edges


def dedupe_edges(installed_on: DataFrame, hosts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, report): one edge per title and host, the latest seen; report: pairs that had several, and extras removed."""
    edges = installed_on if hosts is None else installed_on.join(hosts.select("host_id"), "host_id", "left_semi")
    report = edges.groupBy("name", "host_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("pairs"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extras"))
    return latest(edges, ["name", "host_id"], [F.desc_nulls_last("last_seen"), F.desc_nulls_last("version")]), report


def display_names(hosts: DataFrame) -> DataFrame:
    """Adds display_name: `<hostname> #<id>` where several hosts share the hostname."""
    shared = hosts.groupBy(F.col("hostname").alias("_h")).agg(F.count("*").alias("_n")).where("_n > 1")
    shown = F.when(F.col("_n").isNotNull(), F.concat("hostname", F.lit(" #"), F.col("host_id").cast("string"))).otherwise(F.col("hostname"))
    return hosts.join(shared, F.col("hostname") == F.col("_h"), "left").withColumn("display_name", shown).drop("_h", "_n")


def is_browser_extension(source: Column) -> Column:
    return F.lower(F.trim(source)).isin(*lists.BROWSER_EXTENSION_SOURCES)
