"""Sharding by a K-d tree over metadata: distributed weighted medians along the widest dimension."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostloom.llm.common import settle

SHARDS = 8
#: A row's place along a dimension is a key of KEY_BITS: the dimension's value, then a hash of the row; equal rows are
#: told apart by a second key. A pass over the rows finds STEP_BITS of a cut.
STEP_BITS, KEY_BITS, DIM_BITS = 12, 60, 24
#: Levels of the tree between two tables of nodes.
SETTLED_LEVELS = 4


def _dims(has: set[str]) -> dict[str, F.Column]:
    """Metadata as numbers. Names are hashed: rows of one source or language stay together."""
    unit = lambda c: F.shiftright(F.xxhash64(c), 11).cast("double")
    dims = {"doc_id": F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0)), "size": F.log2(F.col("size"))}
    return dims | {n: unit(F.col(n)) for n in ("source", "lang") if n in has}


def tree_shards(documents: DataFrame, target_bytes: int | None = None, shards: int | None = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, equal, shard): leaves of a K-d tree with near equal bytes; `equal` tells equal rows apart.

    A node that stands for k leaves is cut along its widest dimension (extent over the table's extent) where its left
    side has floor(k / 2) / k of its bytes; each side then gets leaves by the bytes that it really has, at most one for each
    of its rows, so a row that is larger than a shard's share leaves no shard empty while there are rows to part. The cut is found digit by digit from histograms of a sortable key (the
    dimension, then a hash that breaks ties), so ties and hot sources are cut too and nothing is sorted or sampled.
    Size is the UTF-8 bytes plus 1; null text has none (size 1, crc null). Null metadata is a value like others.
    The law is near equal bytes. Equal texts (the groups) lie together only as far as their metadata do: a cut may part
    them, and it parts repeated rows too, or else a shard would grow with its largest group. An empty table gives an
    empty result. `target_bytes` (or `shards`) sets the leaves; the driver holds a few numbers for each leaf.
    """
    rows, n, total = keyed(documents)
    if total is None:
        return rows.select("doc_id", "size", "text_crc32", "equal", F.lit(0).alias("shard"))
    leaves = shards if target_bytes is None else math.ceil(total / target_bytes)
    if leaves < 1:
        raise ValueError(f"{leaves} leaves; the tree takes 1 or more")
    return _grow(rows, n, leaves).drop(*[f"d{i}" for i in range(n)])


def keyed(documents: DataFrame) -> tuple[DataFrame, int, int | None]:
    """(rows: doc_id, size, text_crc32, a key d0, d1, ... for each dimension, equal; number of dimensions; bytes in all)."""
    text = F.col("text").cast("binary")
    has = set(documents.columns)
    meta = documents.select(
        "doc_id", *[c for c in ("source", "lang") if c in has], (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    dims = _dims(has)
    # equal rows may stand in any order, so the order in which they were read tells them apart
    equal = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - KEY_BITS)
    rows = settle(meta.select("doc_id", "size", "text_crc32", *[c.alias(f"d{i}") for i, c in enumerate(dims.values())], equal.alias("equal")))
    span = rows.agg(*[f(f"d{i}") for i in range(len(dims)) for f in (F.min, F.max)], F.sum("size")).first()
    tie = F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "size"), 64 - (KEY_BITS - DIM_BITS))
    for i in range(len(dims)):
        low, wide = span[2 * i] or 0.0, (span[2 * i + 1] or 0.0) - (span[2 * i] or 0.0)
        place = ((F.col(f"d{i}") - low) / (wide or 1.0) * ((1 << DIM_BITS) - 1)).cast("long")
        rows = rows.withColumn(f"d{i}", F.shiftleft(place, KEY_BITS - DIM_BITS).bitwiseOR(tie))
    return rows, len(dims), span[-1]


def _grow(rows: DataFrame, n: int, leaves: int) -> DataFrame:
    """Adds `shard`. Per level: one pass for bytes, rows and extents, then a pass for each digit that the cuts still need:
    first of the key, then, where the rows at a cut have one key, of the key that tells equal rows apart. Every few
    levels the nodes are settled, so plans don't grow with the depth."""
    spark = rows.sparkSession
    rows, nodes, first, right_of, level = rows.withColumn("node", F.lit(0)), {0: leaves}, {0: 0}, {}, 0
    while True:
        if level % SETTLED_LEVELS == SETTLED_LEVELS - 1:
            rows = settle(rows)
        wide = {r[0]: r for r in rows.groupBy("node").agg(F.sum("size"), F.count("*"), *[F.max(f"d{i}") - F.min(f"d{i}") for i in range(n)]).collect()}
        for at, new in right_of.items():  # the nodes that the last level cut: the left side keeps the node's number
            nodes[at], nodes[new] = leaves_of(nodes[at], *(wide.get(x, (x, 0, 0))[1:3] for x in (at, new)))
            first[new] = first[at] + nodes[at]
        level += 1
        cut = {}
        for at, (_, total, count, *extents) in wide.items():
            if nodes[at] > 1 and count > 1:
                cut[at] = {"dim": max(range(n), key=lambda i: (extents[i] >> (KEY_BITS - DIM_BITS), -i)), "want": total * (nodes[at] // 2) / nodes[at], "low": 0, "upto": -1, "total": total, "before": 0}
        if not cut:
            break
        key = F.element_at(F.array(*[F.col(f"d{i}") for i in range(n)]), F.col("dim") + 1)
        open_nodes = set(cut)
        for side in ("low", "upto"):  # rows up to key `low` go left; of those that have it, those up to `upto`
            digit = KEY_BITS
            if side == "upto":
                for k in open_nodes:
                    cut[k]["upto"] = 0
            while open_nodes and digit:
                digit -= STEP_BITS
                now = spark.createDataFrame([(k, cut[k]["dim"], cut[k]["low"], cut[k][side], float(cut[k]["want"])) for k in open_nodes], "node int, dim int, low long, at long, want double")
                place = key if side == "low" else F.col("equal")
                inside = F.shiftright(place, digit + STEP_BITS) == F.shiftright("at", digit + STEP_BITS)
                bins = rows.join(F.broadcast(now), "node").where(inside if side == "low" else inside & (key == F.col("low")))
                bins = bins.groupBy("node", F.shiftright(place, digit).alias("bin")).agg(F.first("want").alias("want"), F.sum("size").alias("bytes"), F.count("*").alias("n"))
                # the bin in which the wanted share falls, chosen where the bins are: 2 ** STEP_BITS of a node at most
                running = F.sum("bytes").over(Window.partitionBy("node").orderBy("bin"))
                hit = bins.withColumn("upto", running).where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("bytes") < F.col("want"))).select("node", "bin", "bytes", "n", (F.col("upto") - F.col("bytes")).alias("before")).collect()
                for r in hit:
                    c = cut[r[0]]
                    c[side], c["want"], c["before"] = r[1] << digit, c["want"] - r[4], c["before"] + r[4]
                    if r[3] == 1:  # one row left: it goes where it fits better, but leaves neither side without rows
                        goes_left = not c["before"] or 2 * c["want"] >= r[2] and c["before"] + r[2] < c["total"]
                        c[side] += (1 << digit) - 1 if goes_left else -1
                        open_nodes.discard(r[0])
        right_of = {at: len(nodes) + i for i, at in enumerate(sorted(cut))}
        # a cut that the first key settles takes all of that key to the left
        cuts = spark.createDataFrame([(k, c["dim"], c["low"], c["upto"] if c["upto"] >= 0 else (1 << KEY_BITS), right_of[k]) for k, c in cut.items()], "node int, dim int, low long, upto long, new int")
        right = (key > F.col("low")) | ((key == F.col("low")) & (F.col("equal") > F.col("upto")))
        rows = rows.join(F.broadcast(cuts), "node", "left").withColumn("node", F.when(right, F.col("new")).otherwise(F.col("node"))).drop("dim", "low", "upto", "new")
    names = spark.createDataFrame([(at, first[at]) for at in sorted(wide)], "node int, shard int")
    return rows.join(F.broadcast(names), "node").drop("node")


def leaves_of(k: int, left: tuple[int, int], right: tuple[int, int]) -> tuple[int, int]:
    """How k leaves are shared by two sides of (bytes, rows): by bytes, one at least and one for each row at most. Leaves
    that no row is left for go to the left; a side without rows has none."""
    if not left[1] or not right[1]:
        return (0, k) if not left[1] else (k, 0)
    l = min(max(1, min(k - 1, math.floor(k * left[0] / (left[0] + right[0]) + 0.5))), left[1])  # noqa: E741
    r = min(k - l, right[1])
    return k - r, r


def slots(sharded: DataFrame, buckets: int = 512) -> DataFrame:
    """Adds `slot`: numbers from 0 without gaps in each shard, for `equal`. Rows are numbered in hashed buckets of a shard,
    over which repeated rows spread too, and buckets start where the ones before them end, so no task holds a whole shard."""
    rows = sharded.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "equal"), F.lit(buckets)).cast("int"))
    starts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = starts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("start"))
    numbered = rows.withColumn("r", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "equal")))
    return numbered.join(starts, ["shard", "bucket"]).withColumn("slot", F.col("start") + F.col("r") - 1).drop("bucket", "start", "r", "equal")
