"""Scalar helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(c: Column | str) -> Column:
    """The value, or null where it is an empty string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(c, F.lit(""))


def first_filled(*cs: Column | str) -> Column:
    """The first value that is neither null nor empty after trimming."""
    return F.coalesce(*[filled(F.trim(F.col(c) if isinstance(c, str) else c)) for c in cs])


def word_match(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    """Whether any of the words occurs in the text without a neighbour in [a-z0-9]. Null text: false."""
    found = "|".join(rf"\Q{w}\E" for w in words)
    return F.coalesce(text.rlike(rf"(?<![a-z0-9])(?:{found})(?![a-z0-9])"), F.lit(False))


def typed_id(kind: str, key: Column) -> Column:
    """host_12, user_x, software_y, label_3."""
    return F.concat(F.lit(f"{kind}_"), key.cast("string"))


def split_typed_id(value: Column) -> tuple[Column, Column]:
    """(kind, key) of a typed id; both null if the kind is unknown, the key empty, or a host's or label's key no number."""
    kind = F.regexp_extract(value, r"^(host|user|software|label)_(?s:(.+))\z", 1)
    key = F.regexp_extract(value, r"^(host|user|software|label)_(?s:(.+))\z", 2)
    fits = (kind != "") & (kind.isin("user", "software") | key.try_cast("bigint").isNotNull())
    return F.when(fits, kind), F.when(fits, key)


def script_os(platform: Column) -> Column:
    """Which script dialect a platform runs: darwin, windows, none (mobile, ChromeOS, unknown), else linux."""
    p = F.lower(F.trim(F.coalesce(platform, F.lit(""))))
    return F.when(p.isin("darwin", "windows"), p).when(p.isin("ios", "ipados", "android", "chrome", ""), "none").otherwise("linux")


# --- version orders ----------------------------------------------------------------------------


def _number(digits: Column) -> Column:
    """Digits of any length as a value that orders by size: (length without leading zeros, digits)."""
    bare = F.regexp_replace(digits, "^0+", "")
    return F.struct(F.length(bare).alias("len"), bare.alias("digits"))


def version_sort_key(version: Column) -> Column:
    """A key that orders versions: dot segments from the left, each by its leading number, a suffix (1.0rc1) below
    the bare number, a segment without leading number above all numbers, an empty one lowest; a prefix comes first.
    Null: null."""
    segments = F.split(version, r"\.")

    def key(s: Column) -> Column:
        digits = F.regexp_extract(s, "^([0-9]*)", 1)
        rest = F.regexp_extract(s, "^[0-9]*(.*)$", 1)
        kind = F.when(s == "", 0).when(digits != "", 1).otherwise(2)
        return F.struct(kind.alias("kind"), _number(digits).alias("n"), (rest == "").alias("bare"), rest.alias("rest"))

    return F.transform(segments, key)


def range_version_key(version: Column, width: Column | int = 12) -> Column:
    """A key for version ranges: at least `width` segments, padded with zeros; * is above all, a suffix below the bare
    number, a segment without leading number counts as 0. Null: null."""
    parts = F.split(F.trim(version), r"\.")
    padded = F.concat(parts, F.array_repeat(F.lit("0"), F.greatest((F.lit(width) if isinstance(width, int) else width) - F.size(parts), F.lit(0))))

    def key(s: Column) -> Column:
        digits = F.regexp_extract(s, "^([0-9]*)", 1)
        rest = F.regexp_extract(s, "^[0-9]*(.*)$", 1)
        return F.struct((s == "*").alias("any"), _number(digits).alias("n"), rest.isin("", "*").alias("bare"), rest.alias("rest"))

    return F.transform(padded, key)


def greatest_version(version: str = "version") -> Column:
    """Aggregate: the greatest version by `version_sort_key`, so 10.0 beats 9.0; ties by text, null only where all are."""
    return F.max(F.when(F.col(version).isNotNull(), F.struct(version_sort_key(F.col(version)).alias("k"), F.col(version).alias("v"))))["v"]


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1 in the order of version ranges; null if either is null."""
    width = F.greatest(F.size(F.split(F.trim(a), r"\.")), F.size(F.split(F.trim(b), r"\.")))
    x, y = range_version_key(a, width), range_version_key(b, width)
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


# --- extension removal -------------------------------------------------------------------------

CHROMIUM_STORES = ("chrome", "edge", "brave", "opera", "vivaldi", "chromium")


def removal_supported(store: Column, extension_id: Column) -> Column:
    """Whether an extension of this store and id format can be removed from hosts."""
    store, i = F.lower(store), F.coalesce(extension_id, F.lit(""))
    guid = r"^(\{[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\}|[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9._-]{1,64})$"
    return F.coalesce(F.when(store.isin(*CHROMIUM_STORES), i.rlike("^[a-p]{32}$")).when(store == "firefox", i.rlike(guid)), F.lit(False))


def can_block(os: Column, store: Column) -> Column:
    """Whether a reinstall can be blocked by policy on the host itself; macOS needs a profile and has none."""
    both = ("chrome", "edge", "brave", "chromium")
    store = F.lower(store)
    return F.coalesce((os == "linux") & store.isin(*both, "firefox") | (os == "windows") & store.isin(*both), F.lit(False))
