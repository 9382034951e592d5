"""Host scopes and other filters."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.plans.inventory import Inventory

MAX_DEPTH, MAX_LEAVES, MAX_PATTERN = 6, 64, 100
SEARCH_LIMIT, SEARCH_CAP = 100, 5000


def _all(value: str | None) -> bool:
    return value is None or value.strip().lower() in ("", "all")


def _platform(value: str) -> Column:
    return F.coalesce(F.lower("platform").contains(value.strip().lower()), F.lit(False))


def host_scope(inv: Inventory, team: str | None = None, platform: str | None = None, labels: Sequence[str] = (), op: str = "AND") -> DataFrame:
    """Hosts of a team (by its id as text), a platform (part of its name, any case) and labels (AND: all, OR: any).

    None, an empty value and `all` don't filter; repeated labels count once. Hosts with a null in a filtered column
    are out of scope.
    """
    if op.strip().upper() not in ("AND", "OR"):
        raise ValueError("op is AND or OR")
    hosts = inv.hosts
    if not _all(team):
        hosts = hosts.where(F.col("team_id").cast("string") == team.strip())
    if not _all(platform):
        hosts = hosts.where(_platform(platform))
    names = list(dict.fromkeys(x.strip() for x in labels if x.strip()))
    if names:
        marked = inv.has_label.where(F.col("label").isin(names)).select("host_id", "label").distinct()
        if op.strip().upper() == "AND":
            marked = marked.groupBy("host_id").agg(F.count("*").alias("n")).where(F.col("n") == len(names))
        hosts = hosts.join(marked, "host_id", "left_semi")
    return hosts


def composite_scope(inv: Inventory, expression: str) -> DataFrame:
    """Hosts that fit a JSON tree: {"op": "AND" | "OR" | "NOT", "args": [...]} over {"team" | "platform" | "label": text}.

    One pass over the hosts with their labels as an array. Raises ValueError on malformed trees, more than
    MAX_DEPTH levels or MAX_LEAVES leaves.
    """
    leaves = 0

    def compiled(node, depth: int) -> Column:
        nonlocal leaves
        if not isinstance(node, dict) or depth > MAX_DEPTH:
            raise ValueError("a node is an object, at most six deep")
        if "op" in node:
            op, args = str(node["op"]).upper(), node.get("args")
            if set(node) != {"op", "args"} or not isinstance(args, list) or not args or op not in ("AND", "OR", "NOT") or op == "NOT" and len(args) != 1:
                raise ValueError("op is AND, OR or NOT, with a list of args (NOT: one)")
            made = [compiled(a, depth + 1) for a in args]
            out = made[0]
            for m in made[1:]:
                out = out & m if op == "AND" else out | m
            return ~out if op == "NOT" else out
        leaves += 1
        if leaves > MAX_LEAVES or len(node) != 1:
            raise ValueError("a leaf has one key; at most 64 leaves")
        (kind, value), = node.items()
        if not isinstance(value, str) or not value.strip():
            raise ValueError("a leaf's value is text")
        if kind == "team":
            return F.coalesce(F.col("team_id").cast("string") == value, F.lit(False))
        if kind == "platform":
            return _platform(value)
        if kind == "label":
            return F.coalesce(F.array_contains("host_labels", value), F.lit(False))
        raise ValueError(f"unknown leaf {kind}")

    try:
        test = compiled(json.loads(expression), 1)
    except json.JSONDecodeError as e:
        raise ValueError("not JSON") from e
    marked = inv.has_label.groupBy("host_id").agg(F.collect_set("label").alias("host_labels"))
    return inv.hosts.join(marked, "host_id", "left").where(test).drop("host_labels")


def scope_count(inv: Inventory, team: str | None = None, platform: str | None = None, labels: Sequence[str] = (), op: str = "AND") -> DataFrame:
    """(hosts, hosts_other_op): hosts in scope, and under the other label operator if there are two or more labels."""
    names = list(dict.fromkeys(x.strip() for x in labels if x.strip()))
    hosts = host_scope(inv, team, platform)
    marked = inv.has_label.where(F.col("label").isin(names)).groupBy("host_id").agg(F.count_distinct("label").alias("n"))
    n = F.coalesce("n", F.lit(0))
    every, some = F.count_if(n == len(names)), F.count_if(n > 0)
    both = (every, some) if op.strip().upper() == "AND" else (some, every)
    joined = hosts.join(marked, "host_id", "left")
    if not names:
        return joined.agg(F.count("*").alias("hosts"), F.lit(None).cast("long").alias("hosts_other_op"))
    return joined.agg(both[0].alias("hosts"), (both[1] if len(names) > 1 else F.lit(None).cast("long")).alias("hosts_other_op"))


def exclude_whitelisted(software: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Software of which neither lower(name) nor lower(display_name) is approved; whitelist: (entry), any case."""
    allowed = whitelist.select(F.lower(F.trim("entry")).alias("entry")).where("entry <> ''").distinct()
    out = software
    for column in ("name", "display_name"):
        out = out.join(allowed, F.lower(out[column]) == F.col("entry"), "left_anti")
    return out


def search(inv: Inventory, term: str | None, kind: str = "all", mode: str = "contains", case_sensitive: bool = False, limit: int = SEARCH_LIMIT) -> DataFrame:
    """(kind, id, label, detail, host_count): hosts by hostname, users by username and email, software by name and
    display name. Modes contains, exact, regex; no term lists all. Software has the most hosts first, then by name.
    """
    limit = max(1, min(limit, SEARCH_CAP))
    term = (term or "").strip()
    if mode == "regex" and term:
        if len(term) > MAX_PATTERN:
            raise ValueError("the pattern is too long")
        re.compile(term)

    def hit(*columns: str) -> Column:
        if not term:
            return F.lit(True)
        out = F.lit(False)
        for c in columns:
            value, wanted = (F.col(c), term) if case_sensitive else (F.lower(c), term.lower())
            found = {"contains": lambda: value.contains(wanted), "exact": lambda: value == wanted, "regex": lambda: F.col(c).rlike(term if case_sensitive else f"(?i){term}")}[mode]()
            out = out | F.coalesce(found, F.lit(False))
        return out

    none = F.lit(None).cast("string")
    parts = []
    if kind in ("all", "host"):
        parts.append(inv.hosts.where(hit("hostname")).select(F.lit("host").alias("kind"), F.col("host_id").cast("string").alias("id"), F.col("hostname").alias("label"), F.col("platform").alias("detail"), F.lit(0).cast("long").alias("host_count")).orderBy("label", "id").limit(limit))
    if kind in ("all", "user"):
        parts.append(inv.users.where(hit("username", "email")).select(F.lit("user").alias("kind"), F.col("username").alias("id"), F.col("username").alias("label"), F.col("email").alias("detail"), F.lit(0).cast("long").alias("host_count")).orderBy("label").limit(limit))
    if kind in ("all", "software"):
        counted = inv.software.where(hit("name", "display_name")).join(inv.installed_on.groupBy("name").agg(F.count("*").alias("n")), "name", "left")
        parts.append(counted.select(F.lit("software").alias("kind"), F.col("name").alias("id"), F.col("display_name").alias("label"), none.alias("detail"), F.coalesce("n", F.lit(0)).alias("host_count")).orderBy(F.desc("host_count"), "id").limit(limit))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def search_links(inv: Inventory, nodes: DataFrame, cap: int = 500) -> DataFrame:
    """(src, dst, kind) between matched users or software (the first `cap` of each kind) and the hosts they are on."""
    users = nodes.where("kind = 'user'").orderBy("id").limit(cap).select(F.col("id").alias("username"))
    titles = nodes.where("kind = 'software'").orderBy(F.desc("host_count"), "id").limit(cap).select(F.col("id").alias("name"))
    to_host = F.concat(F.lit("host_"), "host_id")
    a = inv.uses.join(inv.hosts, "host_id", "left_semi").join(users, "username", "left_semi").select(F.concat(F.lit("user_"), "username").alias("src"), to_host.alias("dst"), F.lit("USES").alias("kind"))
    b = inv.installed_on.join(inv.hosts, "host_id", "left_semi").join(titles, "name", "left_semi").select(F.concat(F.lit("software_"), "name").alias("src"), to_host.alias("dst"), F.lit("INSTALLED_ON").alias("kind"))
    return a.unionByName(b).distinct()


def filter_changes(changes: DataFrame, text: str | None = None, regex: bool = False, buckets: Sequence[str] = (), kinds: Sequence[str] = ()) -> DataFrame:
    """Diff rows (bucket, kind, id, ...) whose id has the text or fits the pattern, in the given buckets and kinds."""
    out = changes
    if text:
        out = out.where(F.col("id").rlike(text) if regex else F.lower("id").contains(text.lower()))
    if buckets:
        out = out.where(F.col("bucket").isin(list(buckets)))
    return out.where(F.col("kind").isin(list(kinds))) if kinds else out


def extension_filter(extensions: DataFrame, risk: str | None = None, store: str | None = None, known_bad: bool | None = None, include_builtin: bool = False, text: str | None = None) -> DataFrame:
    """Extensions of a band (`unassessed`: no band yet), store and known-bad flag; built-ins only with a score above 0
    unless asked for; text in name, display name, id or publisher."""
    out = extensions
    if not _all(risk):
        out = out.where(F.col("risk_band").isNull() if risk == "unassessed" else F.col("risk_band") == risk)
    if not _all(store):
        out = out.where(F.col("store") == store)
    if known_bad is not None:
        out = out.where(F.coalesce("known_bad", F.lit(False)) == known_bad)
    if not include_builtin:
        out = out.where(~F.coalesce("is_builtin", F.lit(False)) | (F.coalesce("risk_score", F.lit(0)) > 0))
    if text:
        found = [F.coalesce(F.lower(c).contains(text.lower()), F.lit(False)) for c in ("name", "display_name", "extension_id", "publisher") if c in extensions.columns]
        test = found[0]
        for f in found[1:]:
            test = test | f
        out = out.where(test)
    return out
