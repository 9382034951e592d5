"""Risk scores of browser extensions: capability, trust, threat, exposure, names."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostloom.functions.values import filled, range_version_key
from hostloom.operators.ingest import is_builtin

# --- Fixed values ---------------------------------------------------------------------------------
PERMISSIONS = {
    "debugger": 25, "nativeMessaging": 20, "proxy": 20, "userScripts": 15, "cookies": 15, "webRequest": 15, "declarativeNetRequest": 15,
    "declarativeNetRequestWithHostAccess": 15, "management": 15, "scripting": 12, "clipboardRead": 12, "tabCapture": 10, "history": 8, "identity": 8,
    "downloads": 6, "offscreen": 6, "activeTab": 2, "storage": 1, "contextMenus": 1, "alarms": 1, "notifications": 1, "sidePanel": 1,
}
PRIVACY, PRIVACY_CAP = {4: 4, 3: 3, 5: 3, 1: 2, 7: 2}, 8
PRIVACY_LABELS = {
    1: "personally identifiable information", 3: "financial and payment information", 4: "authentication information", 5: "personal communications",
    6: "location", 7: "web history", 8: "user activity", 9: "website content",
}
ALL_URLS = ("<all_urls>", "*://*/*", "http://*/*", "https://*/*")
HOST_PATTERN = r"(?i)^(?:<all_urls>|\*://|[a-z]+://)"
FEED_THREAT = {"malicious": 100, "unwanted": 70, "listed": 45}
MALICIOUS_WORDS, UNWANTED_WORDS = ("malware", "malicious", "trojan", "stealer", "phish"), ("adware", "unwanted", "hijack", "spam")
STORE_ROOTS = {
    "chrome": (r"\\google\\chrome\\", r"/google/chrome/", r"/google-chrome/"), "edge": (r"\\microsoft\\edge\\", r"/microsoft edge/", r"/microsoft-edge/"),
    "brave": (r"\\bravesoftware\\", r"/bravesoftware/"), "firefox": (r"\\mozilla\\firefox\\profiles\\", r"/firefox/profiles/", r"/.mozilla/firefox/"),
}
BRANDS = (
    "adguard", "adblock", "ublock", "lastpass", "bitwarden", "1password", "dashlane", "grammarly", "honey", "paypal", "metamask", "phantom", "rabby", "ledger",
    "trezor", "keeper", "norton", "mcafee", "avast", "avg", "malwarebytes", "kaspersky", "eset", "bitdefender", "sophos", "cloudflare", "google", "microsoft",
    "mozilla", "adobe", "apple", "amazon", "netflix", "spotify", "slack", "zoom", "notion", "evernote", "pocket", "darkreader", "ghostery", "privacybadger", "tampermonkey",
)
AFFIXES = ("x", "pro", "plus", "app", "ex", "official")
LOOKALIKES = "абвгдеёжзийклмнопрстуфхцчшщъыьэюяαβγδεζηθικλμνξοπρστυφχψω"
PUBLISHER_SUFFIXES = (
    "inc", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "gmbh", "ag", "sa", "srl", "sro", "bv", "plc", "pty", "software", "systems",
    "security", "technologies", "platforms", "labs", "lab", "devs", "dev", "developers", "developer", "team",
)
NAME_CAP = 35
#: Characters of the runs that regexes of the block list are filed under.
GRAM = 4

_NONE = "array<string>"
SIGNAL = "struct<code:string,weight:bigint,detail:string>"


def signal(code: Column | str, weight: Column | int, detail: Column | str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(code).alias("code"), lit(weight).cast("long").alias("weight"), lit(detail).alias("detail"))


def when_signal(test: Column, code: Column | str, weight: Column | int, detail: Column | str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), signal(code, weight, detail))


def present(*signals: Column) -> Column:
    return F.filter(F.array(*signals), lambda s: s.isNotNull())


def _list(c: str) -> Column:
    return F.coalesce(c, F.array().cast(_NONE))


def manifest_fields(json: Column) -> Column:
    """struct(permissions, optional_permissions, host_permissions, content_script_matches, content_security_policy,
    manifest_version, version) of a manifest's JSON; a policy may be text or an object, of which extension_pages counts."""
    m = F.from_json(json, "permissions array<string>, optional_permissions array<string>, host_permissions array<string>, content_scripts array<struct<matches:array<string>>>, content_security_policy string, manifest_version bigint, version string")
    csp = m["content_security_policy"]
    pages = F.when(F.ltrim(csp).startswith("{"), F.get_json_object(csp, "$.extension_pages")).otherwise(csp)
    none = F.array().cast(_NONE)
    matches = F.array_distinct(F.flatten(F.transform(F.coalesce(m["content_scripts"], F.array().cast("array<struct<matches:array<string>>>")), lambda s: F.coalesce(s["matches"], none))))
    return F.struct(F.coalesce(m["permissions"], none).alias("permissions"), F.coalesce(m["optional_permissions"], none).alias("optional_permissions"), F.coalesce(m["host_permissions"], none).alias("host_permissions"), matches.alias("content_script_matches"), F.substring(pages, 1, 2000).alias("content_security_policy"), m["manifest_version"].alias("manifest_version"), m["version"].alias("version"))


def permission_sets(df: DataFrame) -> DataFrame:
    """Adds perms, hosts, matches, optional (sorted, distinct): required permissions without host patterns, host patterns
    of either list, content script matches, and optional permissions that aren't required."""
    is_host = lambda p: p.rlike(HOST_PATTERN)
    raw = F.filter(_list("permissions"), lambda p: p.isNotNull())
    perms = F.array_sort(F.array_distinct(F.filter(raw, lambda p: ~is_host(p))))
    hosts = F.array_sort(F.array_distinct(F.concat(F.filter(_list("host_permissions"), lambda p: p.isNotNull()), F.filter(raw, is_host))))
    optional = F.array_sort(F.array_except(F.filter(_list("optional_permissions"), lambda p: p.isNotNull() & ~is_host(p)), perms))
    return df.withColumns({"perms": perms, "hosts": hosts, "matches": F.array_sort(F.array_distinct(_list("content_script_matches"))), "optional": optional})


def weak_csp(csp: Column) -> Column:
    """Why a policy weakens script isolation, else null: unsafe-eval, or remote script sources. The first directive of a
    name counts; script-src falls back to default-src."""
    names = F.transform(F.regexp_extract_all(csp, F.lit(r"(?i)(?:^|;)\s*(script-src(?:-elem)?|default-src)\s+([^;]*)"), 1), lambda x: F.lower(x))
    values = F.regexp_extract_all(csp, F.lit(r"(?i)(?:^|;)\s*(script-src(?:-elem)?|default-src)\s+([^;]*)"), 2)

    def of(*wanted: str) -> Column:
        out = F.lit(None).cast("string")
        for w in wanted:
            at = F.array_position(names, w)
            out = F.coalesce(out, F.when(at > 0, F.get(values, (at - 1).cast("int"))))
        return F.filter(F.split(F.coalesce(out, F.lit("")), r"\s+"), lambda x: x != "")

    script, elements = of("script-src", "default-src"), of("script-src-elem", "script-src", "default-src")
    remote = F.array_distinct(F.filter(F.concat(elements, script), lambda x: F.lower(x).rlike(r"^https?:") | x.startswith("*")))
    return F.when(F.exists(script, lambda x: F.lower(x) == "'unsafe-eval'"), "'unsafe-eval' lets it run code built from strings").when(F.size(remote) > 0, F.concat(F.lit("loads scripts from "), F.array_join(F.slice(remote, 1, 3), ", ")))


def capability(df: DataFrame) -> DataFrame:
    """Adds capability_score and capability_signals. Needs the columns of `permission_sets`, privacy_codes and
    content_security_policy. Optional permissions weigh half (half to even), in order, within what required ones weigh."""
    weights = F.create_map(*[F.lit(x) for k, v in PERMISSIONS.items() for x in (k, v)])
    weight = lambda p: F.coalesce(F.try_element_at(weights, p), F.lit(0)).cast("long")
    required = F.filter(F.transform("perms", lambda p: signal(F.concat(F.lit("permission:"), p), weight(p), F.concat(F.lit("requests the '"), p, F.lit("' permission")))), lambda s: s["weight"] > 0)
    base = F.aggregate(required, F.lit(0).cast("long"), lambda a, s: a + s["weight"])
    zero = F.struct(F.col("_base").alias("budget"), F.array().cast(f"array<{SIGNAL}>").alias("signals"))

    def take(acc, p):
        w = F.least(F.rint(weight(p) * 0.5).cast("long"), acc["budget"])
        s = signal(F.concat(F.lit("optional-permission:"), p), w, F.concat(F.lit("may request the '"), p, F.lit("' permission at runtime")))
        return F.struct((acc["budget"] - F.greatest(w, F.lit(0))).alias("budget"), F.when(w > 0, F.concat(acc["signals"], F.array(s))).otherwise(acc["signals"]).alias("signals"))

    df = df.withColumn("_required", required).withColumn("_base", base).withColumn("_optional", F.aggregate("optional", zero, take)["signals"])
    every = F.array(*map(F.lit, ALL_URLS))
    n_hosts, n_matches = F.size("hosts"), F.size("matches")
    broad, everywhere = F.arrays_overlap("hosts", every), F.arrays_overlap("matches", every)
    privacy = F.create_map(*[F.lit(x) for k, v in PRIVACY.items() for x in (k, v)])
    labels = F.create_map(*[F.lit(x) for k, v in PRIVACY_LABELS.items() for x in (k, v)])
    codes = F.array_sort(F.array_distinct(F.filter(F.coalesce("privacy_codes", F.array().cast("array<bigint>")), lambda c: c.isin(*PRIVACY))))
    declared = F.least(F.lit(PRIVACY_CAP), F.aggregate(codes, F.lit(0), lambda a, c: a + F.element_at(privacy, c.cast("int"))))
    reach = F.when(n_hosts > 0, F.when(broad, 20).otherwise(F.least(F.lit(10), 2 * n_hosts))).otherwise(0)
    script = F.when(n_matches > 0, F.when(everywhere, 10).otherwise(5)).otherwise(0)
    told = F.when(F.size(codes) > 0, declared).otherwise(0)
    score = F.col("_base") + F.aggregate("_optional", F.lit(0).cast("long"), lambda a, s: a + s["weight"]) + reach + script + told
    score = F.when((n_hosts == 0) & (n_matches == 0), F.rint(score * 0.6)).otherwise(score).cast("long")
    weak = weak_csp(F.col("content_security_policy"))
    more = present(
        when_signal((n_hosts > 0) & broad, "broad-host-access", 20, "host permissions include <all_urls> or an equivalent wildcard"),
        when_signal((n_hosts > 0) & ~broad, "host-access", reach, F.format_string("requests access to %d host pattern(s)", n_hosts)),
        when_signal((n_matches > 0) & everywhere, "content-script-all-urls", 10, "content script runs on every page"),
        when_signal((n_matches > 0) & ~everywhere, "content-script", 5, F.format_string("injects a content script into %d pattern(s)", n_matches)),
        when_signal(F.size(codes) > 0, "declared-data-collection", told, F.concat(F.lit("developer declares it collects: "), F.array_join(F.transform(codes, lambda c: F.element_at(labels, c.cast("int"))), ", "))),
        when_signal(weak.isNotNull(), "weak-csp", 15, F.concat(F.lit("content security policy: "), weak)),
    )
    total = F.least(F.lit(100), score + F.when(weak.isNotNull(), 15).otherwise(0)).cast("int")
    return df.withColumns({"capability_score": total, "capability_signals": F.concat("_required", "_optional", more)}).drop("_required", "_base", "_optional")


def trust(df: DataFrame, as_of: str) -> DataFrame:
    """Adds trust_score and trust_signals (negative weights), as of a date: never the clock. Needs status, reputable and the listing's columns."""
    status = F.lower(F.coalesce(filled("status"), F.lit("unknown")))
    age = F.floor((F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("updated_at")) / 86400)
    users = F.col("users")
    popular = F.least(F.lit(12), F.floor(F.log10(users + 1) * 4 + 1e-12)).cast("long")
    verified = F.coalesce("developer_verified", F.lit(False))
    rated = (F.col("rating") >= 4.0) & (F.coalesce("rating_count", F.lit(0)) >= 100)
    terms = [
        (status == "public", "store-listed", F.lit(25), "listed in a public extension store"),
        (status == "unlisted", "store-unlisted", F.lit(5), "unlisted, but the store still serves it"),
        (status == "unknown", "store-status-unknown", F.lit(8), "store metadata unavailable"),
        (F.col("reputable"), "reputable-publisher", F.lit(20), "publisher matches a known vendor"),
        (verified, "verified-developer", F.lit(10), "store marks the developer as verified"),
        (~verified & F.coalesce("established_publisher", F.lit(False)), "established-publisher", F.lit(10), "verified website owner with no history of violations"),
        (F.col("featured"), "store-featured", F.lit(5), "featured by the store"),
        (F.col("manifest_version") == 3, "manifest-v3", F.lit(8), "uses Manifest V3"),
        (F.col("updated_at").isNotNull(), "store-updated", F.when(age <= 365, 10).when(age <= 730, 4).otherwise(0), F.format_string("last store update %d days ago", F.greatest(age, F.lit(0)))),
        (users > 0, "install-popularity", popular, F.concat(F.format_number(users, 0), F.lit(" store installs"))),
        (rated, "store-rating", F.lit(5), "rated 4.0 or better by 100 or more"),
        (F.col("crx_hash_verified"), "crx-hash-verified", F.lit(5), "package hash matches the store's"),
    ]
    points = F.lit(0)
    for test, _, p, _ in terms:
        points = points + F.when(F.coalesce(test, F.lit(False)), p).otherwise(0)
    return df.withColumns({"trust_score": F.least(F.lit(100), points).cast("int"), "trust_signals": present(*[when_signal(t, c, -p, d) for t, c, p, d in terms])})


@F.pandas_udf(T.StructType().add("literal", T.StringType()).add("valid", T.BooleanType()))
def required_literal(patterns: pd.Series) -> pd.DataFrame:
    """A text that every match of a regex contains: the longest run of plain characters outside groups, classes and
    alternatives, without those that a quantifier may leave out; null where none is sure. And whether the regex compiles."""

    def longest(p: str) -> str | None:
        if re.search(r"\\Q|\(\?[a-zA-Z-]+[:)]", p):  # quotes and flags change how the rest reads
            return None
        runs, run, depth, i = [], "", 0, 0
        while i < len(p):
            c, step, plain = p[i], 1, False
            if c == "\\":
                step, plain = 2, i + 1 < len(p) and not p[i + 1].isalnum()
                c = p[i + 1 : i + 2]
            elif c == "[":
                end = p.find("]", i + 2 + (p[i + 1 : i + 2] == "^"))
                if end < 0 or "[" in p[i + 1 : end] or "\\]" in p[i : end + 1]:
                    return None
                step = end + 1 - i
            elif c in "()":
                depth += 1 if c == "(" else -1
            elif c == "|" and depth == 0:
                return None
            elif c in "*?{" and depth == 0:
                run = run[:-1]
                step = p.find("}", i) + 1 - i if c == "{" else 1
                if step < 1:
                    return None
            else:
                plain = c not in ".^$|+*?{"
            if depth == 0 and plain and c != ")":
                run += c
            else:
                runs.append(run)
                run = ""
            i += step
        return max([*runs, run], key=len) or None

    def judge(p: str | None) -> tuple[str | None, bool]:
        if p is None:
            return None, False
        same = re.sub(r"\\Q(.*?)(?:\\E|$)", lambda m: re.escape(m[1]), p)  # forms that only this compiler doesn't know
        same = re.sub(r"\(\?<(?![=!])", "(?P<", same).replace(r"\z", r"\Z")
        try:
            re.compile(re.sub(r"\\[pP](\{\^?\w+\}|\w)", r"\\w", same))
        except re.error:
            return None, False
        return longest(p), True

    return pd.DataFrame([judge(p) for p in patterns], columns=["literal", "valid"])


def matching_patterns(ids: DataFrame, patterns: DataFrame) -> DataFrame:
    """(extension_id, guid): the regexes that find something in each id. ids: (extension_id), distinct; patterns: (guid, pattern).

    An inverted index: a regex can only match ids that contain each run of GRAM characters of its required literal. It is
    filed under the run that the fewest ids have, and meets only ids with that run, by equality; a run that no id has ends
    it. Only regexes without such a literal meet all ids. Regexes that don't compile match nothing.
    """
    patterns = patterns.withColumn("pattern", F.replace("pattern", F.lit("(?P<"), F.lit("(?<")))
    told = patterns.withColumn("l", required_literal("pattern")).where("l.valid").select("guid", "pattern", F.when(F.length("l.literal") >= GRAM, F.col("l.literal")).alias("literal"))
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - GRAM + 1), lambda k: F.substring(F.col(c), k, F.lit(GRAM))))).alias("gram")
    asked = told.where("literal IS NOT NULL").select("guid", "pattern", grams("literal"))
    held = ids.where(F.length("extension_id") >= GRAM).select("extension_id", grams("extension_id"))
    often = held.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("often"))
    filed = asked.join(often, "gram", "left").groupBy("guid", "pattern").agg(F.min_by("gram", F.struct(F.coalesce("often", F.lit(0)), "gram")).alias("gram"))
    by_gram = held.join(filed, "gram").where("extension_id rlike pattern").select("extension_id", "guid")
    bare = ids.join(told.where("literal IS NULL"), F.expr("extension_id rlike pattern")).select("extension_id", "guid")
    return by_gram.unionByName(bare)


def match_blocklist(ext: DataFrame, blocklist: DataFrame) -> DataFrame:
    """(extension_id, why): ids on the block list. ext: (extension_id, versions); blocklist: (guid, why, ranges).

    The entry of the id itself comes first, then /regex/ guids in order; the first that blocks a version counts. An entry
    blocks: any known version in any range, or no range, or no known version. A missing or * end of a range is open.
    """
    ids = ext.select(F.trim("extension_id").alias("extension_id"), "versions").where(F.coalesce("extension_id", F.lit("")) != "")
    is_regex = F.col("guid").rlike("^/.*/$")
    regex = blocklist.where(is_regex).select("guid", F.expr("substring(guid, 2, length(guid) - 2)").alias("pattern"))
    loose = matching_patterns(ids.select("extension_id").distinct(), regex).withColumn("rank", F.lit(1))
    exact = ids.select("extension_id").distinct().join(blocklist.where(~is_regex), F.col("extension_id") == F.col("guid")).select("extension_id", "guid", F.lit(0).alias("rank"))
    met = exact.unionByName(loose).join(blocklist.select("guid", "why", "ranges"), "guid").join(ids, "extension_id")
    open_end = lambda e: F.coalesce(filled(F.trim(e)), F.lit("*")) == "*"
    inside = lambda v, r: (open_end(r["minVersion"]) | (range_version_key(v) >= range_version_key(r["minVersion"]))) & (open_end(r["maxVersion"]) | (range_version_key(v) <= range_version_key(r["maxVersion"])))
    known = F.filter(F.coalesce("versions", F.array().cast(_NONE)), lambda v: F.trim(F.coalesce(v, F.lit(""))) != "")
    blocked = (F.size(F.coalesce("ranges", F.array().cast("array<struct<minVersion:string,maxVersion:string>>"))) < 1) | (F.size(known) == 0) | F.exists(known, lambda v: F.exists("ranges", lambda r: F.coalesce(inside(v, r), F.lit(False))))
    first = met.where(blocked).groupBy("extension_id").agg(F.min_by(F.struct("why"), F.struct("rank", "guid", "why")).alias("m"))
    return first.select("extension_id", F.coalesce(filled("m.why"), F.lit("blocked")).alias("why"))


def match_feeds(ext: DataFrame, feeds: DataFrame) -> DataFrame:
    """(extension_id, hits): feed entries of an id, in order of the feed: (feed, reason, severity, threat). Firefox feeds apply
    to Firefox, Chromium feeds to all Chromium stores."""
    reason = F.lower("reason")
    any_of = lambda words: reason.rlike("|".join(words))
    severity = F.when(any_of(MALICIOUS_WORDS), "malicious").when(any_of(UNWANTED_WORDS), "unwanted").otherwise("listed")
    graded = feeds.withColumn("severity", severity).withColumn("threat", F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in FEED_THREAT.items()]))
    e = ext.select("extension_id", F.lower("extension_id").alias("_id"), F.when(F.col("store") == "firefox", "firefox").otherwise("chromium").alias("platform")).where(F.col("store").isin("firefox", "chrome", "edge", "brave", "opera", "vivaldi", "chromium")).distinct()
    hits = e.join(graded, (F.col("_id") == F.col("id")) & (e["platform"] == graded["platform"]))
    return hits.groupBy("extension_id").agg(F.array_sort(F.collect_list(F.struct("feed", "reason", "severity", "threat"))).alias("hits"))


def threat(df: DataFrame) -> DataFrame:
    """Adds threat_score and threat_signals: the greatest of the floors. Needs blocked_why, hits and the listing's columns."""
    status = F.lower(F.coalesce("status", F.lit("")))
    blocked = F.col("blocked_why").isNotNull()
    cvss = F.col("max_cvss")
    error = F.coalesce(filled("manifest_error"), F.lit("")) != ""
    unseen = (F.coalesce(filled("manifest_unavailable"), F.lit("")) != "") & ~error
    floors = [
        (blocked, "blocklisted", 100, F.coalesce("blocked_why", F.lit(""))),
        (~blocked & status.isin("removed", "disabled"), "removed-from-store", 45, "no longer available in its store"),
        (~blocked & status.isin("not_found", "sideloaded"), "not-in-store", 20, "not found in the expected public store"),
        (~blocked & (status == "unlisted"), "unlisted", 10, "unlisted or self-distributed"),
        ((F.col("rating") < 2.5) & (F.coalesce("rating_count", F.lit(0)) >= 50), "poor-public-reputation", 15, "rated below 2.5 by 50 or more"),
        (unseen, "manifest-uninspected", 15, F.coalesce(F.substring("manifest_unavailable", 1, 200), F.lit(""))),
        (error, "manifest-unparseable", 30, F.coalesce(F.substring("manifest_error", 1, 200), F.lit(""))),
        (cvss >= 9, "critical-cve", 35, F.format_string("CVSS %.1f vulnerability", cvss)),
        ((cvss >= 7) & (cvss < 9), "high-cve", 25, F.format_string("CVSS %.1f vulnerability", cvss)),
        ((cvss > 0) & (cvss < 7), "known-cve", 10, F.format_string("CVSS %.1f vulnerability", cvss)),
    ]
    hits = F.coalesce("hits", F.array().cast("array<struct<feed:string,reason:string,severity:string,threat:int>>"))
    fed = F.coalesce(F.array_max(F.transform(hits, lambda h: h["threat"])), F.lit(0))
    score = F.greatest(fed, *[F.when(F.coalesce(t, F.lit(False)), w).otherwise(0) for t, _, w, _ in floors])
    told = F.transform(hits, lambda h: signal(F.concat(F.lit("threat-feed:"), h["feed"]), h["threat"], F.concat(h["feed"], F.lit(": "), h["reason"])))
    return df.withColumns({"threat_score": F.least(F.lit(100), score).cast("int"), "threat_signals": F.concat(present(*[when_signal(t, c, w, d) for t, c, w, d in floors]), told)})


def exposure(host_count: Column, version_count: Column) -> Column:
    """min(60, 15 log10(hosts + 1), half to even), 10 more for over two versions."""
    n = F.greatest(F.coalesce(host_count, F.lit(0)), F.lit(0))
    return F.least(F.lit(100), F.least(F.lit(60), F.rint(F.log10(n + 1) * 15)) + F.when(version_count > 2, 10).otherwise(0)).cast("int")


def store_install_verified(installs: DataFrame) -> DataFrame:
    """(key, verified): whether every install lies in the browser's own store directory for that id. installs: (key,
    store, extension_id, path, platform), one row each; they are judged one by one and never gathered. A missing path
    fails except on ChromeOS; one proof at least is needed."""
    p, i = F.lower("path"), F.lower("extension_id")
    root = F.lit(False)
    for store, roots in STORE_ROOTS.items():
        root = root | ((F.col("store") == store) & p.rlike("|".join(roots)))
    proof = F.coalesce(root & p.contains(i) & ~p.contains(".."), F.lit(False))
    missing = F.coalesce("path", F.lit("")) == ""
    fine = proof | (missing & (F.col("platform") == "chrome"))
    return installs.groupBy("key").agg((F.bool_and(fine) & (F.count_if(proof) > 0)).alias("verified"))


def publisher_reputable(ext: DataFrame, publishers: DataFrame, verified: DataFrame) -> DataFrame:
    """(key, reputable): a trusted immutable id (publisher, author, extension while public, signing team bound into the
    key) and verified installs. publishers: (name, kind, id)."""
    ids = publishers.select("kind", F.col("id").alias("trusted")).distinct()
    claims = ext.select("key", F.explode(F.filter(F.array(
        F.when(F.col("store") == "chrome", F.struct(F.lit("chrome").alias("kind"), F.col("publisher_id").alias("trusted"))),
        F.when((F.col("store") == "edge") & (F.col("status") == "public"), F.struct(F.lit("edge").alias("kind"), F.col("extension_id").alias("trusted"))),
        F.when((F.col("store") == "safari") & F.endswith(F.lower("extension_id"), F.concat(F.lit("@"), F.lower("app_team_id"))), F.struct(F.lit("safari").alias("kind"), F.col("app_team_id").alias("trusted"))),
    ), lambda c: c.isNotNull())).alias("c")).select("key", "c.*")
    authors = ext.where("store = 'firefox'").select("key", F.lit("firefox").alias("kind"), F.explode(F.transform("author_ids", lambda a: a.cast("string"))).alias("trusted"))
    known = claims.unionByName(authors).join(ids, ["kind", "trusted"], "left_semi").select("key").distinct()
    return ext.select("key").distinct().join(known.withColumn("_k", F.lit(True)), "key", "left").join(verified, "key", "left").select("key", (F.coalesce("_k", F.lit(False)) & F.coalesce("verified", F.lit(False))).alias("reputable"))


@F.pandas_udf(T.StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold() if isinstance(x, str) else None)


def _look(folded: Column) -> Column:
    return F.regexp_replace(F.replace(F.translate(folded, "01", "ol"), F.lit("rn"), F.lit("m")), "[^a-z0-9]+", "")


def publisher_name_key(name: Column) -> Column:
    """A publisher's name without legal and corporate words at its end, for display matches only."""
    words = F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: w != "")
    out = F.array_join(words, " ")
    for _ in range(3):
        out = F.regexp_replace(out, r" (?:" + "|".join(PUBLISHER_SUFFIXES) + r")$", "")
    return out


def _brand_hits(compact: DataFrame, brands: tuple[str, ...]) -> DataFrame:
    """(_c, _hit): the first brand in order that a compact name looks like: within one edit or swap of neighbours, or with
    an affix of at most two letters.

    Words within one edit or swap share a form: themselves, or themselves less one letter. The forms of the brands, and the
    brands with an affix, are a fixed short table that names meet by equality; only names that share one are compared.
    """
    looks = list(dict.fromkeys(b.replace("0", "o").replace("1", "l").replace("rn", "m") for b in brands))
    forms = {(f, i, b) for i, b in enumerate(looks) for f in (b, *(b[:k] + b[k + 1 :] for k in range(len(b))), *(b + a for a in AFFIXES if len(a) <= 2))}
    listed = compact.sparkSession.createDataFrame(sorted(forms), "form string, i int, brand string")
    shorter = F.transform(F.sequence(F.lit(1), F.length("_c")), lambda k: F.concat(F.substring(F.col("_c"), F.lit(1), k - 1), F.substring(F.col("_c"), k + 1, F.length("_c"))))
    fits = compact.where(F.length("_c").between(1, max(map(len, looks)) + 2))
    held = fits.select("_c", F.explode(F.array_distinct(F.concat(F.array("_c"), shorter))).alias("form"))
    pairs = held.join(F.broadcast(listed), "form").select("_c", "i", "brand").distinct()
    n = F.length("brand")
    swapped = F.expr("exists(sequence(1, length(brand) - 1), k -> _c = concat(left(brand, k - 1), substring(brand, k + 1, 1), substring(brand, k, 1), substring(brand, k + 2)))")
    near = ((F.abs(F.length("_c") - n) <= 1) & (F.levenshtein("_c", "brand") <= 1)) | swapped
    rest = F.expr("substring(_c, length(brand) + 1)")
    affix = F.startswith("_c", "brand") & rest.isin(*[a for a in AFFIXES if len(a) <= 2])
    kind = F.when(near, 1).when(affix, 2)
    first = pairs.withColumns({"kind": kind, "rest": rest}).where("kind IS NOT NULL").groupBy("_c").agg(F.min_by(F.struct("kind", "brand", "rest"), "i").alias("m"))
    told = F.when(F.col("m.kind") == 1, signal("typosquat-brand", 18, F.concat(F.lit("name is one edit away from the '"), F.col("m.brand"), F.lit("' brand")))).otherwise(signal("brand-affix", 8, F.concat(F.lit("name appends '"), F.col("m.rest"), F.lit("' to the '"), F.col("m.brand"), F.lit("' brand"))))
    return first.select("_c", told.alias("_hit"))


def name_anomalies(names: DataFrame, spark_brands: tuple[str, ...] = BRANDS) -> DataFrame:
    """(name, display_name, vouched, name_penalty, name_signals): malformed and look-alike names.

    Names are folded once per distinct value. A look-alike is within one edit of a brand (a swap of neighbours counts)
    or a brand with a short affix, the first brand in order; the brand itself is none. Vouched names are reported,
    not penalised. At most 35.
    """
    shown = F.trim(F.coalesce(filled("display_name"), "name", F.lit("")))
    df = names.select("name", "display_name", "vouched", shown.alias("_d"))
    folded = df.select("_d").distinct().select("_d", nfkc_casefold("_d").alias("_f"))
    df = df.join(folded, "_d")
    exact, compact = F.regexp_replace("_f", "[^a-z0-9]+", ""), _look(F.col("_f"))
    df = df.withColumns({"_exact": exact, "_c": compact})
    hit = _brand_hits(df.where((F.length("_c") >= 5) & ~F.col("_exact").isin(*spark_brands)).select("_c").distinct(), spark_brands)
    df = df.join(hit, "_c", "left").withColumn("_hit", F.when(~F.col("_exact").isin(*spark_brands), F.col("_hit")))
    d = F.col("_d")
    dots = F.length(d) - F.length(F.replace(d, F.lit("."), F.lit("")))
    found = present(
        when_signal(d.rlike(r"[\\/]|\.crx\z|\.xpi\z"), "path-as-name", 12, F.concat(F.lit("name looks like an install path: "), F.substring(d, 1, 120))),
        when_signal(F.col("_f").rlike(f"[{LOOKALIKES}]"), "mixed-script-name", 20, "name contains Cyrillic or Greek letters that mimic Latin"),
        when_signal(d.rlike(r"[\x00-\x1f\x7f]"), "control-characters", 15, "name contains control characters"),
        when_signal(F.length(d) > 80, "oversized-name", 6, F.format_string("name is %d characters", F.length(d))),
        when_signal((dots >= 4) & ~d.contains(" ") & ~d.endswith("@"), "dotted-identifier-name", 4, "name looks like a reverse-DNS identifier"),
        F.when(F.col("_hit").isNotNull(), F.when(F.coalesce("vouched", F.lit(False)), signal("brand-lookalike-vouched", 0, F.concat(F.col("_hit.detail"), F.lit(", but the store vouches for this publisher")))).otherwise(F.col("_hit"))),
    )
    signals = F.when(d == "", F.array(signal("missing-name", 12, "extension has no name or display name"))).otherwise(found)
    total = F.least(F.lit(NAME_CAP), F.aggregate("name_signals", F.lit(0).cast("long"), lambda a, s: a + s["weight"])).cast("int")
    return df.withColumn("name_signals", signals).withColumn("name_penalty", total).select("name", "display_name", "vouched", "name_penalty", "name_signals")


def risk_band(score: Column) -> Column:
    return F.when(score >= 75, "critical").when(score >= 50, "high").when(score >= 25, "medium").when(score.isNotNull(), "low")


def score_extensions(groups: DataFrame, listings: DataFrame, blocklist: DataFrame, feeds: DataFrame, publishers: DataFrame, installs: DataFrame, fleet_hosts: DataFrame, as_of: str) -> DataFrame:
    """One row per key: the four scores, name_penalty, risk_score, risk_band, known_bad, is_builtin, signals by weight.

    groups: (key, name, display_name, store, extension_id, host_count, versions, installed_paths, app_team_id, max_cvss);
    listings: one row per (store, extension_id) with the listing's columns; fleet_hosts: one row (fleet_hosts).
    A built-in with no block-list or feed hit scores 0.
    """
    l = listings.withColumnRenamed("store", "l_store").withColumnRenamed("extension_id", "l_id")  # noqa: E741
    base = groups.join(l, (F.col("store") == F.col("l_store")) & (F.col("extension_id") == F.col("l_id")), "left").drop("l_store", "l_id")
    seen = groups.select("extension_id", F.explode_outer("versions").alias("v")).groupBy("extension_id").agg(F.collect_set("v").alias("versions"))
    blocked = match_blocklist(seen, blocklist).withColumnRenamed("why", "blocked_why")
    verified = store_install_verified(installs)
    trusted = publisher_reputable(base, publishers, verified)
    # names are judged once for either answer to whether the store vouches, so that they don't hang on all that comes before
    both = groups.select("name", "display_name").distinct().select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("vouched"))
    names = name_anomalies(both).select(F.col("name").alias("_name"), F.col("display_name").alias("_shown"), F.col("vouched").alias("_vouched"), "name_penalty", "name_signals")
    df = base.join(blocked, "extension_id", "left").join(match_feeds(groups, feeds), "extension_id", "left").join(trusted, "key", "left").join(verified, "key", "left")
    badge = (F.coalesce("developer_verified", F.lit(False)) | F.coalesce("established_publisher", F.lit(False))) & (F.coalesce("users", F.lit(0)) >= 100_000) & F.coalesce("verified", F.lit(False))
    df = df.withColumn("vouched", F.coalesce("reputable", F.lit(False)) | badge)
    df = df.join(names, F.col("name").eqNullSafe(F.col("_name")) & F.col("display_name").eqNullSafe(F.col("_shown")) & (F.col("vouched") == F.col("_vouched")), "left").drop("_name", "_shown", "_vouched")
    df = threat(trust(capability(permission_sets(df)), as_of))
    df = df.crossJoin(F.broadcast(fleet_hosts)).withColumn("exposure_score", exposure(F.col("host_count"), F.size(F.coalesce("versions", F.array().cast(_NONE)))))
    users, hosts, reputable = F.col("users"), F.coalesce("host_count", F.lit(0)), F.coalesce("reputable", F.lit(False))
    few = F.when((users < 1000) & ~reputable, F.when(users < 100, 8).otherwise(4)).otherwise(0)
    rare = F.when(hosts <= 1, 4).when((F.col("fleet_hosts") >= 10) & (hosts / F.greatest("fleet_hosts", F.lit(1)) < 0.03), 3).otherwise(0)
    rarity = F.coalesce(few, F.lit(0)) + rare
    risk = F.rint(0.35 * F.col("capability_score") + 0.25 * (100 - F.col("trust_score")) + 0.25 * F.col("threat_score") + 0.15 * F.col("exposure_score") + F.col("name_penalty") + rarity)
    hits = F.coalesce("hits", F.array().cast("array<struct<feed:string,reason:string,severity:string,threat:int>>"))
    bad = F.col("blocked_why").isNotNull() | F.exists(hits, lambda h: h["severity"] == "malicious")
    unwanted = F.exists(hits, lambda h: h["severity"] == "unwanted")
    status = F.lower(F.coalesce(filled("status"), F.lit("unknown")))
    scale = F.when(users >= 100_000, 96).when(users >= 10_000, 92).otherwise(85)
    floor = F.when(bad, scale).when(F.size(hits) > 0, F.when(unwanted, 70).otherwise(60)).when(status == "removed", 60).when((status == "not_found") & (F.col("name_penalty") >= 18), 55).otherwise(0)
    none = F.array().cast(_NONE)
    builtin = is_builtin(F.col("store"), F.col("extension_id"), F.coalesce("installed_paths", none))
    plain = builtin & ~bad & (F.size(hits) == 0)
    told = present(
        when_signal(few > 0, F.when(few == 8, "very-low-installs").otherwise("low-installs"), few, F.concat(F.lit("only "), F.format_number(users, 0), F.lit(" store installs"))),
        when_signal(rare > 0, F.when(rare == 4, "single-host").otherwise("rare-in-fleet"), rare, F.format_string("installed on %d/%d hosts", hosts, "fleet_hosts")),
        when_signal(bad & (users >= 10_000), F.when(users >= 100_000, "known-bad-at-scale").otherwise("known-bad-popular"), F.when(users >= 100_000, 30).otherwise(20), F.concat(F.lit("blocked extension with "), F.format_number(users, 0), F.lit(" installs"))),
    )
    every = F.concat("capability_signals", "threat_signals", "name_signals", told, "trust_signals")
    ordered = F.transform(F.array_sort(F.transform(every, lambda s, i: F.struct((-F.abs(s["weight"])).alias("w"), i.alias("i"), s.alias("s")))), lambda x: x["s"])
    zero = lambda c, v=0: F.when(plain, v).otherwise(F.col(c)).alias(c)
    total = F.when(plain, 0).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), risk, floor))).cast("int")
    return df.withColumn("risk_score", total).select(
        "key", "store", "extension_id", "host_count", zero("capability_score"), zero("trust_score", 100), zero("threat_score"), zero("exposure_score"), zero("name_penalty"), "risk_score", risk_band(F.col("risk_score")).alias("risk_band"),
        (bad & ~plain).alias("known_bad"), builtin.alias("is_builtin"), F.when(plain, True).otherwise(reputable).alias("publisher_reputable"), status.alias("store_status"), users.alias("install_users"),
        F.when(plain, F.array(signal("browser-builtin", 0, "shipped by the browser's vendor; never flagged"))).otherwise(ordered).alias("signals"),
    )


def extension_fingerprints(groups: DataFrame, fleet_hosts: DataFrame) -> DataFrame:
    """(key, fingerprint): SHA-1 of every scoring input; the fleet's size only as the flag whether the key is rare in it."""
    rare = (F.col("fleet_hosts") >= 10) & (F.col("host_count") / F.greatest("fleet_hosts", F.lit(1)) < 0.03)
    inputs = [F.col(c) for c in sorted(groups.columns)]
    return groups.crossJoin(F.broadcast(fleet_hosts)).select("key", F.sha1(F.to_json(F.struct(*inputs, rare.alias("rare"))).cast("binary")).alias("fingerprint"))


def due_for_scoring(groups: DataFrame, fingerprints: DataFrame, prior: DataFrame, listings: DataFrame, as_of: str) -> DataFrame:
    """(key, reason): keys to score again: new, changed, or listing due (7 days for Chromium stores, else 21 days and up
    to 7 more by a hash of the key) or older than a version on hosts. prior: (key, fingerprint, versions_seen)."""
    l = listings.select(F.col("store").alias("_s"), F.col("extension_id").alias("_i"), "fetched_at", F.col("version").alias("listed"))  # noqa: E741
    df = groups.join(fingerprints, "key").join(prior.select("key", F.col("fingerprint").alias("was"), "versions_seen"), "key", "left").join(l, (F.col("store") == F.col("_s")) & (F.col("extension_id") == F.col("_i")), "left")
    jitter = F.conv(F.substring(F.sha1(F.col("key").cast("binary")), 1, 8), 16, 10).cast("long") % 8
    ttl = F.when(F.col("store").isin("chrome", "edge", "brave", "opera", "vivaldi", "chromium"), F.lit(7)).otherwise(21 + jitter)
    age = F.datediff(F.lit(as_of).cast("date"), F.col("fetched_at").cast("date"))
    none = F.array().cast(_NONE)
    newer = F.exists(F.array_except(F.coalesce("versions", none), F.coalesce("versions_seen", none)), lambda v: range_version_key(v) > range_version_key(F.col("listed")))
    reason = F.when(F.col("was").isNull(), "new").when(F.col("was") != F.col("fingerprint"), "changed").when(F.col("fetched_at").isNull(), "no listing").when(age > ttl, "listing due").when(newer, "newer version")
    return df.select("key", reason.alias("reason")).where(F.col("reason").isNotNull())


def apply_scores(software: DataFrame, scores: DataFrame) -> DataFrame:
    """Software with its key's score on every title of the key; titles named by a message id (__MSG_) take the listing's name."""
    s = scores.select(F.col("key").alias("_key"), "risk_score", "risk_band", "known_bad", "store_name")
    df = software.join(s, F.col("extension_key") == F.col("_key"), "left").drop("_key")
    return df.withColumn("display_name", F.when(F.col("display_name").startswith("__MSG_"), F.coalesce("store_name", "display_name")).otherwise(F.col("display_name"))).drop("store_name")
