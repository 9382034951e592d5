"""Readers of landed files: fixed schemas, no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader

from hostloom.functions.values import first_filled

HOST_DOCUMENT = """id bigint, computer_name string, display_name string, hostname string, os_version string, platform string, primary_ip string,
seen_time timestamp, updated_at timestamp, software_updated_at string, team_id bigint, team_name string, primary_user string, owner string, users array<string>,
software array<struct<name:string,version:string,source:string,display_name:string,bundle_identifier:string,extension_id:string,browser:string,extension_for:string,vendor:string,generated_cpe:string,
installed_paths:array<string>,signature_information:array<struct<installed_path:string,team_identifier:string>>,
vulnerabilities:array<struct<cve:string,cve_id:string,cvss_score:double,cvss:double,cvss_v3_score:double,epss_probability:double,details:string,created_at:string>>>>"""
CORRUPT = "_corrupt_record"
USER = "username string, email string, name string, full_name string"
LABEL = "id bigint, name string, description string, label_type string, label_membership_type string, query string, host_count bigint"
BLOCKLIST = "guid string, why string, versionRange array<struct<minVersion:string,maxVersion:string>>"
PUBLISHER = "name string, match_names array<string>, added_at string, chrome_publisher_ids array<string>, amo_author_ids array<string>, edge_extension_ids array<string>, apple_team_ids array<string>"

# Labels that the operating systems reserve; id formats; lengths and rows of a feed.
RESERVED_LABELS = ("All Hosts", "macOS", "Ubuntu Linux", "CentOS Linux", "MS Windows", "Red Hat Linux", "All Linux", "chrome", "iOS", "iPadOS", "Android")
CHROMIUM_ID, FIREFOX_ID = r"^[a-p]{32}$", r"^(\{[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\}|[a-z0-9._+-]*@[a-z0-9._-]+)$"
REASON_CHARS, SOURCE_CHARS, DATE_CHARS, FEED_ROWS = 120, 300, 40, 200_000


def read_host_documents(spark: SparkSession, path: str) -> DataFrame:
    """Nested host documents, one JSON object a line. Malformed lines and documents without an id are left to `quarantine`."""
    return sound_documents(_documents(spark.read, path))


def stream_host_documents(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of the files that land under a folder."""
    return sound_documents(_documents(spark.readStream, path))


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """(file, cause, record): the lines of host documents that aren't read, `malformed` (no JSON object, cut off, or a field of
    another type: as they came) or `no id` (as they were read). With `read_host_documents` it covers every line but empty ones."""
    docs = _documents(spark.read, path)
    cause = F.when(F.col(CORRUPT).isNotNull(), "malformed").when(F.col("id").isNull(), "no id")
    whole = F.to_json(F.struct(*[c for c in docs.columns if c not in (CORRUPT, "file")]))
    return docs.select("file", cause.alias("cause"), F.coalesce(CORRUPT, whole).alias("record")).where("cause IS NOT NULL")


def _documents(reader: DataFrameReader | DataStreamReader, path: str) -> DataFrame:
    """All lines: those that fit the schema, and the text of those that don't in a column of its own."""
    rows = reader.schema(f"{HOST_DOCUMENT}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("file"))


def sound_documents(docs: DataFrame) -> DataFrame:
    """The documents of `_documents` that fit the schema and have an id."""
    return named_hosts(docs.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "file"))


def named_hosts(docs: DataFrame) -> DataFrame:
    """Drops rows without an id; hostname is the first non-empty of computer_name, display_name, hostname, else host-<id>."""
    name = F.coalesce(first_filled("computer_name", "display_name", "hostname"), F.concat(F.lit("host-"), F.col("id").cast("string")))
    return docs.where(F.col("id").isNotNull()).withColumn("hostname", name)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """(username, email, fullname); the key is the first non-empty of username, email, name; rows without one are dropped."""
    rows = spark.read.schema(USER).json(path)
    return rows.select(first_filled("username", "email", "name").alias("username"), F.nullif(F.trim("email"), F.lit("")).alias("email"), first_filled("full_name", "name").alias("fullname")).where(F.col("username").isNotNull())


def read_labels(spark: SparkSession, path: str, skip_builtin: bool = False) -> DataFrame:
    """Labels but the reserved ones, or (skip_builtin) but all built-in ones; types are lower-cased, regular and dynamic by default."""
    return labels(spark.read.schema(LABEL).json(path), skip_builtin)


def labels(raw: DataFrame, skip_builtin: bool = False) -> DataFrame:
    """The rule of `read_labels` on rows of its schema."""
    rows = raw.where(F.col("id").isNotNull())
    kind = F.coalesce(F.lower(F.nullif(F.trim("label_type"), F.lit(""))), F.lit("regular"))
    rows = rows.where(kind != "builtin") if skip_builtin else rows.where(~F.coalesce("name", F.lit("")).isin(*RESERVED_LABELS))
    return rows.select(F.col("id").alias("label_id"), "name", "description", kind.alias("label_type"), F.coalesce(F.lower(F.nullif(F.trim("label_membership_type"), F.lit(""))), F.lit("dynamic")).alias("membership_type"), "query", "host_count")


def read_threat_feed(spark: SparkSession, path: str, feed: str, platform: str = "chromium", columns: dict[str, str] | None = None) -> DataFrame:
    """(feed, platform, id, reason, source, date) of the first FEED_ROWS rows of a CSV feed with a header; columns maps id, reason, source, date to its names."""
    columns = {"id": "id", "reason": "reason", "source": "source", "date": "date"} | (columns or {})
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns]).withColumn("row", F.monotonically_increasing_id())
    raw = raw.orderBy("row").limit(FEED_ROWS)  # the rule of the feed, not a saving
    return feed_rows(raw.select("row", *[(F.col(f"`{v}`") if v in raw.columns else F.lit(None).cast("string")).alias(k) for k, v in columns.items()]), feed, platform)


def feed_rows(raw: DataFrame, feed: str, platform: str) -> DataFrame:
    """Ids lower-cased and checked against the platform's format; default reason, cut texts; the last row of an id wins."""
    text = lambda c, n: F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, n)
    rows = raw.withColumn("id", F.lower(F.trim("id"))).where(F.col("id").rlike(CHROMIUM_ID if platform == "chromium" else FIREFOX_ID))
    last = rows.groupBy("id").agg(F.max_by(F.struct("reason", "source", "date"), "row").alias("v"))
    return last.select(F.lit(feed).alias("feed"), F.lit(platform).alias("platform"), "id", F.coalesce(F.nullif(text(F.col("v.reason"), REASON_CHARS), F.lit("")), F.lit("listed by threat feed")).alias("reason"), text(F.col("v.source"), SOURCE_CHARS).alias("source"), text(F.col("v.date"), DATE_CHARS).alias("date"))


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    return blocklist(spark.read.schema(BLOCKLIST).json(path))


def blocklist(records: DataFrame) -> DataFrame:
    """(guid, why, ranges): one row per guid; the ranges of several records are put together, the first reason in order stays."""
    none = F.array().cast(records.schema["versionRange"].dataType)
    return records.where(F.coalesce("guid", F.lit("")) != "").groupBy("guid").agg(F.min("why").alias("why"), F.flatten(F.collect_list(F.coalesce("versionRange", none))).alias("ranges"))


def read_publishers(spark: SparkSession, path: str) -> DataFrame:
    return publishers(spark.read.schema(PUBLISHER).option("multiLine", True).json(path))


def _fits(pattern: str):
    return lambda x: F.coalesce(x.rlike(pattern), F.lit(False))


def publishers(entries: DataFrame) -> DataFrame:
    """(name, kind, id): trusted ids, one row each. An entry without a name or an ISO date, or with any malformed id, is dropped whole."""
    none = F.array().cast("array<string>")
    ids = lambda c: F.coalesce(c, none)
    formats = {"chrome_publisher_ids": r"^u[0-9a-f]{32}$", "amo_author_ids": r"^[0-9]+$", "edge_extension_ids": CHROMIUM_ID, "apple_team_ids": r"^[A-Z0-9]{10}$"}
    good = (F.coalesce("name", F.lit("")) != "") & F.coalesce(F.col("added_at").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(False))
    for c, form in formats.items():
        good = good & F.forall(ids(c), _fits(form))
    rows = entries.where(good)
    parts = [rows.select("name", F.lit(k).alias("kind"), F.explode(ids(c)).alias("id")) for c, k in (("chrome_publisher_ids", "chrome"), ("amo_author_ids", "firefox"), ("edge_extension_ids", "edge"), ("apple_team_ids", "safari"), ("match_names", "name"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """(entry): a JSON array of names, trimmed, lower-cased, without empties or repeats."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", T.ArrayType(T.StringType()))).alias("entry"))
    return lines.select(F.lower(F.trim("entry")).alias("entry")).where("entry <> ''").distinct()


def recent_cycles(spark: SparkSession, path: str, n: int = 10, schema: str = "cycle bigint, started_at timestamp, status string, findings bigint") -> DataFrame:
    """The last n cycle records (at most 100), newest first; malformed lines are skipped."""
    return newest_cycles(spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path), n)


def newest_cycles(cycles: DataFrame, n: int) -> DataFrame:
    return cycles.where(F.col("cycle").isNotNull()).orderBy(F.desc("started_at"), F.desc("cycle")).limit(min(n, 100))


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
