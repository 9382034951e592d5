"""URL filter: block and allow rules, and gradient-boosted trees over lexical features (DataFrame functions and Spark ML)."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.llm.common import settle, small

#: (host, path prefix, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Labelled urls that the trees are fitted on, in expectation; chosen by hash of the url.
TRAIN_ROWS, TREES, DEPTH = 20_000, 10, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("n_url", "n_host", "depth", "digit_ratio", "entropy", "n_params", "n_labels", "n_hyphens", "longest", "suffix_rate", "suffix_log")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? or #."""
    rest = F.when(url.contains("://"), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    host = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(name, verdict) of the longest rule whose host is the url's or a parent of it and whose path starts the
    url's; null if none fits. Equal lengths: the later name in code point order."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("name"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    return F.array_max(F.array(*fits))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Length, depth, digit ratio, entropy and parameter counts of a url."""
    n = F.length(url).cast("double")
    counts = F.transform(F.array_distinct(F.split(url, "")), lambda c: F.length(url) - F.length(F.replace(url, c, F.lit(""))))
    entropy = F.aggregate(F.filter(counts, lambda x: x > 0), F.lit(0.0), lambda s, x: s - x / n * F.log2(x / n))
    parts = F.array_remove(F.split(path, "/"), "")
    return {
        "n_url": n,
        "n_host": F.length(host).cast("double"),
        "depth": F.size(parts).cast("double"),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(n, F.lit(1.0)),
        "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "n_params": F.when(url.contains("?"), F.size(F.split(F.substring_index(url, "?", -1), "[&;]"))).otherwise(0).cast("double"),
        "n_labels": F.size(F.array_remove(F.split(host, r"\."), "")).cast("double"),
        "n_hyphens": (F.length(url) - F.length(F.translate(url, "-_", ""))).cast("double"),
        "longest": F.coalesce(F.array_max(F.transform(F.concat(parts, F.split(host, r"\.")), lambda x: F.length(x))), F.lit(0)).cast("double"),
    }


def judge(pages: DataFrame, rules=RULES, train_rows: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """One row per page row: page_id, host, path, rule, verdict, p_block.

    Urls that a rule fits are the labelled ones: the rule decides them, and a sample of about `train_rows` of them
    (by hash of the url, so equal urls go together) fits the trees that decide the others. Suffix statistics (share
    blocked and count of the host's last two labels) are counted over all labelled urls, at every size. Null
    urls and urls without :// have an empty host and path and no rule; the trees judge them as they do others. With
    labels of one kind only, that kind is the verdict of all; with none, allow. Repeated rows get equal results.
    """
    spark = pages.sparkSession
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = split_url(url)
    rows = pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("m", matched_rule(F.col("host"), F.col("path"), rules))
    labelled = rows.where(F.col("m").isNotNull())
    n, n_block = labelled.agg(F.count("*"), F.count_if(F.col("m.verdict") == "block")).first()
    base = rows.select("page_id", "host", "path", F.col("m.name").alias("rule"), F.col("m.verdict").alias("ruled"), "url")
    if not n or n_block in (0, n):
        only = "block" if n and n_block else "allow"
        return base.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(only)).alias("verdict"), F.lit(float(only == "block")).alias("p_block"))
    unit = 1 << 20
    chosen = F.pmod(F.xxhash64("url"), F.lit(unit)) < int(min(1.0, train_rows / n) * unit)
    suffix = F.substring_index("host", ".", -2)
    traits = base.select("*", suffix.alias("suffix"), *[c.alias(k) for k, c in lexical(F.col("url"), F.col("host"), F.col("path")).items()])
    train = settle(traits.where(F.col("ruled").isNotNull() & chosen).withColumn("label", (F.col("ruled") == "block").cast("double")))
    stats = settle(labelled.groupBy(suffix.alias("suffix")).agg(F.count_if(F.col("m.verdict") == "block").cast("double").alias("b"), F.count("*").alias("c")))
    n_stats = stats.count()
    prior = n_block / n

    def with_suffix(df: DataFrame) -> DataFrame:
        seen = df.join(small(stats, n_stats, 48), "suffix", "left")
        rate = (F.coalesce("b", F.lit(0.0)) + 4 * prior) / (F.coalesce("c", F.lit(0)) + 4)
        seen = seen.withColumn("suffix_rate", rate).withColumn("suffix_log", F.log1p(F.coalesce("c", F.lit(0)).cast("double")))
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(seen)

    fitted = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, maxBins=32).fit(with_suffix(train).select("features", "label").coalesce(max(1, spark.sparkContext.defaultParallelism // 2)))
    scored = fitted.transform(with_suffix(traits))
    p = vector_to_array("probability")[1]
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(p >= 0.5, "block").otherwise("allow")).alias("verdict"), p.alias("p_block"))
