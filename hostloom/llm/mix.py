"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostloom.llm.common import discard, settle, small

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
SHARDS, BLOCKS_PER_SOURCE, SEED = 8, 1000, 17
#: Buckets of a source's order, and piles that its repeated rows are counted in.
BUCKETS, PILES = 4096, 4096


def words_in(text: F.Column) -> F.Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null has none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, w, target): sources in code point order, null last, weigh `weights` in turn.

    Water-filling in closed form: sources are capped in the order of cap * size / weight; the rest share what is left
    by weight. The result is what repeated resharing of the excess comes to. One row per source goes to one task: meant
    for up to millions of sources, whatever the number of documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*map(F.lit, weights))
    w = sizes.withColumn("w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1)).cast("long"))
    w = w.withColumn("cap", F.col("source_size") * cap)
    filling = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    upto, everything = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = w.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
    w = w.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(upto), F.lit(0)))
    w = w.withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0)))
    # the first source that isn't capped fixes the level of all that follow
    w = w.withColumn("level", F.col("left") / F.col("w_left").cast("double")).withColumn("open", F.col("cap") > F.col("level") * F.col("w"))
    w = w.withColumn("level", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("w"))
    return w.select("source", "source_size", "w", target.alias("target"))


def quotas(goals: DataFrame, blocks: F.Column, shards: int = SHARDS) -> DataFrame:
    """(source, shard, quota): blocks 1 to n of each shard's cumulated house, dealt by the highest quotients target / (2k + 1).

    goals: source, target; `blocks` is the number of blocks in all. Sainte-Laguë is house-monotone, so shard j gets
    what the houses of its two ends differ by: integer quotas that sum to the whole apportionment. A seat's divisor
    lies between total / (house + S / 2) and total / (house - S / 2); only the seats in between, about 2 S, are ranked.
    """
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda j: F.struct((j - 1).alias("shard"), F.floor(F.col("blocks") * j / shards).alias("house")))
    total, n = F.sum("target").over(Window.partitionBy()), F.count("*").over(Window.partitionBy())
    s = goals.withColumn("total", total).withColumn("n", n).withColumn("blocks", blocks).select("source", "target", "total", "n", F.explode(ends).alias("e")).select("source", "target", "total", "n", "e.*")
    sure = F.greatest(F.floor(F.col("target") / F.col("total") * F.greatest(F.col("house") - F.col("n") / 2 - 1, F.lit(0)) - F.lit(1)), F.lit(0))
    most = F.ceil(F.col("target") / F.col("total") * (F.col("house") + F.col("n") / 2 + 1)) + 1
    s = s.where("total > 0").withColumn("sure", sure).withColumn("most", most)
    s = s.withColumn("open", F.col("house") - F.sum("sure").over(Window.partitionBy("shard")))
    seats = s.select("source", "shard", "open", "target", F.explode(F.sequence("sure", "most")).alias("k"))
    ranked = seats.withColumn("r", F.row_number().over(Window.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), F.col("source").isNull(), "source")))
    won = ranked.where(F.col("r") <= F.col("open")).groupBy("source", "shard").agg(F.count("*").alias("won"))
    a, b = s.alias("a"), won.alias("b")
    house = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.shard") == F.col("b.shard")), "left").select("a.source", "a.shard", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("house"))
    before = F.lag("house", 1, 0).over(Window.partitionBy("source").orderBy("shard"))
    return house.select("source", "shard", (F.col("house") - before).alias("quota"))


def mixture(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, shards: int = SHARDS, blocks_per_source: int = BLOCKS_PER_SOURCE, seed: int = SEED) -> DataFrame:
    """One row per document row: doc_id, size, source_size, target, taken, source, text_crc32, source_taken, blocks, shards.

    The mix is cut into blocks of equally many words; `quotas` gives each source whole blocks, some for each shard, and a
    source with words whose target is too small for any takes one block, cut at its target. A source's documents
    stand in a seeded order (hash of seed and row), which cuts its words into blocks in random order; the mix takes
    them from the first on and begins anew after the last, so a document is taken `cap` times at most. A second seeded
    order deals these blocks to the shards, to each as many as its quota; `shards` names the shards of the blocks in
    which a document's taken copies begin, one after the other (empty where nothing is taken). Null text has
    size 0; a null source is a source of its own, last in order; repeated rows are documents of their own; an empty
    table gives an empty result; sources without words take nothing. Equal runs give equal results.
    """
    out, blocks = _taken(documents, weights, share, cap, shards, blocks_per_source, seed)
    n_blocks = blocks.count()
    for k in range(cap):  # the block in which the k-th copy begins
        began = F.col("offset") + k * F.col("source_size")
        out = out.withColumn("block", F.when((F.col("size") > 0) & (began < F.col("source_taken")), F.floor(began / F.col("block_words"))))
        o, b = out.alias("o"), small(blocks, n_blocks, 32).alias("b")
        out = o.join(b, F.col("o.source").eqNullSafe(F.col("b.source")) & (F.col("o.block") == F.col("b.block")), "left").select("o.*", F.col("b.shard").alias(f"shard_{k}")).drop("block")
    named = F.concat_ws(",", *[F.col(f"shard_{k}").cast("string") for k in range(cap)])
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "text_crc32", F.col("source_taken").cast("long").alias("source_taken"), F.col("blocks").cast("long").alias("blocks"), named.alias("shards"))


def _taken(documents: DataFrame, weights, share: float, cap: int, shards: int, blocks_per_source: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(documents with their place in the source's order and what is taken of them, `blocks` of `_planned`)."""
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.crc32(F.col("text").cast("binary")))
    pile = F.pmod(F.monotonically_increasing_id(), F.lit(PILES)).cast("int")
    rows = settle(documents.select("doc_id", "source", words_in(F.col("text")).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), order.alias("at"), pile.alias("pile")))
    # rows that are equal in all that counts are a few lines of the order, so a group of copies is a few rows from here on
    lines = settle(rows.groupBy("source", "at", "doc_id", "size", "text_crc32", "pile").agg(F.count("*").alias("n")).withColumn("bucket", F.pmod(F.shiftright("at", 40), F.lit(BUCKETS))))
    per_bucket = lines.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("bucket_size"))
    goals = settle(targets(per_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, cap))
    n_sources = goals.count()
    plan, blocks = _planned(goals, n_sources, cap, shards, blocks_per_source, seed)
    discard(rows)
    offsets = per_bucket.withColumn("before", F.coalesce(F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("source", "bucket").orderBy("at", "doc_id", "size", "text_crc32", "pile").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)))
    p, o = placed.alias("p"), offsets.alias("o")
    joined = p.join(o, F.col("p.source").eqNullSafe(F.col("o.source")) & (F.col("p.bucket") == F.col("o.bucket"))).select("p.*", (F.col("o.before") + F.col("p.inside")).alias("offset"))
    # each of the equal rows has a place of its own
    joined = joined.select("doc_id", "source", "size", "text_crc32", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.col("offset") + i * F.col("size"))).alias("offset"))
    j, g = joined.alias("j"), small(plan, n_sources, 96).alias("g")
    out = j.join(g, F.col("j.source").eqNullSafe(F.col("g.source"))).select("j.*", "g.source_size", "g.target", "g.source_taken", "g.blocks", "g.block_words")
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("source_taken") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("source_taken") - rounds * F.col("source_size")
    return out.withColumn("taken", (rounds * F.col("size") + F.least(F.greatest(rest - F.col("offset"), F.lit(0)), F.col("size"))).cast("long")), blocks


def _planned(goals: DataFrame, n_sources: int, cap: int, shards: int, blocks_per_source: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(plan: goals with blocks, block_words, source_taken; blocks: source, block, shard of each block taken), settled."""
    # words a block: about `blocks_per_source` blocks for the mean source
    whole = F.sum("target").over(Window.partitionBy())
    per = F.greatest(F.floor(whole / F.lit(float(max(1, n_sources) * blocks_per_source))), F.lit(1))
    dealt = settle(quotas(goals, F.floor(F.col("total") / F.greatest(F.floor(F.col("total") / (F.col("n") * F.lit(float(blocks_per_source)))), F.lit(1))), shards))
    won = dealt.groupBy("source").agg(F.sum("quota").alias("blocks"))
    b, d = goals.withColumn("block_words", per).alias("b"), won.alias("d")
    plan = b.join(d, F.col("b.source").eqNullSafe(F.col("d.source")), "left").select("b.*", F.coalesce("d.blocks", F.lit(0)).alias("blocks"))
    # a target below half a block wins no seat: such a source takes one block, cut at its target, for a shard by hash
    missed = (F.col("blocks") == 0) & (F.col("target") > 0)
    plan = plan.withColumn("missed", missed).withColumn("block_words", F.when(missed, F.greatest(F.round("target").cast("long"), F.lit(1))).otherwise(F.col("block_words")))
    plan = plan.withColumn("blocks", F.when(missed, F.lit(1)).otherwise(F.col("blocks")))
    plan = settle(plan.withColumn("source_taken", F.least(F.col("blocks") * F.col("block_words"), F.col("source_size") * cap)))
    every = plan.where("blocks > 0").select("source", "missed", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"))
    drawn = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), F.lit("block"), "source", "block"), "block")
    every = every.withColumn("rank", F.row_number().over(drawn) - 1)
    upto = F.sum("quota").over(Window.partitionBy("source").orderBy("shard"))
    seats = dealt.withColumn("upto", upto).where("quota > 0").select("source", "shard", F.explode(F.sequence(F.col("upto") - F.col("quota"), F.col("upto") - 1)).alias("rank"))
    e, s = every.alias("e"), seats.alias("s")
    shard = F.coalesce("s.shard", F.pmod(F.xxhash64(F.lit(seed), "e.source"), F.lit(shards))).cast("int")
    blocks = settle(e.join(s, F.col("e.source").eqNullSafe(F.col("s.source")) & (F.col("e.rank") == F.col("s.rank")), "left").select("e.source", "e.block", shard.alias("shard")))
    discard(dealt)
    return plan, blocks


def mixed_documents(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, shards: int = SHARDS, blocks_per_source: int = BLOCKS_PER_SOURCE, seed: int = SEED) -> DataFrame:
    """The mix as document rows: each row as often as its words are taken, to the nearest whole number (at most `cap`).

    Only the document at the end of a source's last block is taken in part, so rounding moves a source by half a
    document at most. Equal rows share what they take. Rows without words are not taken.
    """
    key = F.xxhash64(F.col("doc_id"), F.crc32(F.col("text").cast("binary")), F.col("source"))
    order = F.xxhash64(F.col("doc_id"), F.col("text_crc32"), F.col("source"))
    taken = _taken(documents, weights, share, cap, shards, blocks_per_source, seed)[0].select(order.alias("key"), "size", "taken")
    per_key = settle(taken.groupBy("key").agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("share")))
    rows = documents.select(F.struct("*").alias("row"), key.alias("key")).join(small(per_key, per_key.count(), 16), "key")
    times = F.floor(F.col("share") + 0.5).cast("int")
    return rows.where(times > 0).select(F.explode(F.array_repeat("row", times)).alias("row")).select("row.*")
