"""Connected components by alternating large-star and small-star steps, settled between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.llm.common import discard, settle


def _stars(pairs: DataFrame) -> DataFrame:
    """Each node of `u` with the least of itself and its partners in `v`; map-side minima, so hub nodes don't gather."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v), any orderable type, either direction, repeats allowed -> (node, component), component the least node.

    Nodes without an edge do not appear. An empty edge table gives an empty result. Edges with a null end or from a
    node to itself are ignored. Every round writes its edges to the shared folder; rounds grow with the logarithm of
    the longest chain.
    """
    kept = edges.where(F.col("u") != F.col("v"))
    stars = settle(kept.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_stars(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        least = _stars(large)
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, stars = stars, settle(small.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct())
        discard(last)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = nodes.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._settled_at = stars._settled_at  # so that discard() finds it
    return out
