"""The corpus pipeline: documents through quality rules, near-duplicate removal, decontamination, mixing and sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostloom.llm import decontaminate, mix, near, quality, shard
from hostloom.llm.common import discard, settle, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality rules keep (op7's rules and model; labels are matched by doc_id).

    Null and empty texts and texts of fewer than 20 words go; repeated rows are judged alike; an empty table stays
    empty; other columns pass as they are, whatever their names.
    """
    return quality.keep(docs, table(spark, sf_dir, "labels"))


#: Near copies of the corpus: five-word shingles at a Jaccard similarity of 0.8 or more. op10's contract has values of its own.
SHINGLE, PERCENT = 5, 80


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the least doc_id; a null id stands behind all others.

    Rows without words are in no group and stay. Repeated rows are one group. Ties (one doc_id, several texts) go to the
    least hash of the row. An empty table stays empty; other columns pass as they are.
    """
    return near.one_of_each(docs, size=SHINGLE, percent=PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without any window of a benchmark item.

    Null and empty texts have no words and stay; repeated rows go or stay together; an empty benchmark takes nothing away.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes its words, to the nearest whole number (0 to 2).

    Rows without words are not taken; a null source is a source of its own; equal rows share what they take.
    """
    return mix.mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot, near equal bytes a shard; repeated rows (the mix makes them) are spread like others."""
    return shard.slots(shard.tree_shards(docs, shards=8)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]

#: Classifier verdicts, sketches and seeded orders have no SQL form; tests hold the near-copy stage against brute force, the others against their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder before the next reads them, and
    removed once the next has been written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, settle(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
