"""Benchmark decontamination over a distributed positional inverted index (DataFrame functions only).

1. Count the benchmark's terms over the whole corpus.
2. In every benchmark window choose the `anchors` rarest terms. Store the postings (term, document, position) of
   those terms only, and subtract the term's offset in the item: postings of one occurrence meet on one diagonal.
3. Intersect: a diagonal stays if some window has all of its anchors there (`phrases`). Near matches have postings of
   their own, of each item's rarest terms: a place stays if enough of them lie within a slack of it (`near_places`).
4. Compare the whole item with the document along each diagonal that is left: exact runs of window length are hits.
   Only documents with candidates are cut up for this; an item's words stay in a table of their own, so what is broadcast
   holds places, and joins shuffle where the counted places are too many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.llm.common import BROADCAST_BYTES, discard, row_key, settle, small

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW, ANCHORS = 10, 2
#: A key with more than this part of all rows is dealt over several tasks; at most so many keys are.
PARTS = 4096


def fits(rows: int, width: int) -> bool:
    """Whether so many rows, of about `width` bytes each, may be broadcast."""
    return rows * (width + 32) <= BROADCAST_BYTES


def meet(rows: DataFrame, side: DataFrame, key: str, counts: DataFrame, n_side: int, width: int) -> DataFrame:
    """rows joined to side by key; counts: (key, n), n being the key's number of rows.

    A side of few counted rows is broadcast. Else the join shuffles, and a key with more than 1 / PARTS of all rows is dealt
    over as many lots as it has such parts, with the side's rows of that key in each: no task joins a hot key by itself.
    There are at most PARTS such keys, so they are broadcast.
    """
    if fits(n_side, width):
        return rows.join(F.broadcast(side), key)
    counts = settle(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("n") * PARTS > total).select(key, F.ceil(F.col("n") * PARTS / max(total, 1)).cast("int").alias("lots")))
    lots = F.coalesce("lots", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("lot", F.pmod(F.xxhash64(*rows.columns), lots).cast("int")).drop("lots")
    each = side.join(hot, key, "left").withColumn("lot", F.explode(F.sequence(F.lit(0), lots - 1))).drop("lots")
    return dealt.join(each, [key, "lot"]).drop("lot")


def terms(text: F.Column) -> F.Column:
    """Words of a text: A-Z lower-cased, cut at ASCII that is neither digit nor letter. Null has none."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, UPPER, LOWER), BREAKS), ""), F.array().cast("array<string>"))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words): items with at least one word; equal rows count once."""
    items = benchmark.select("item_id", terms(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    return items.withColumn("item", F.xxhash64("item_id", "words"))


def lines_of(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item, line): an item's terms in order, as (at, n, term), n being the term's count in the corpus."""
    places = items.select("item", F.posexplode("words").alias("at", "term"))
    vocabulary = settle(places.select("term").distinct())
    words = docs.select(F.explode(terms(F.col("text"))).alias("term"))
    if fits(vocabulary.count(), 24):
        counts = words.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count("*").alias("n"))
    else:  # counted before the shuffle, so that a frequent term is one row of each task
        counts = words.groupBy("term").agg(F.count("*").alias("n")).join(vocabulary, "term", "left_semi")
    counts = settle(counts)
    ranked = places.join(small(counts, counts.count(), 32), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return ranked.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", "n", "term"))).alias("line"))


def anchors_of(items: DataFrame, docs: DataFrame, window: int, anchors: int) -> DataFrame:
    """(term, item, at, n): the terms of every window that are rarest in the corpus, n being their count there."""
    by_item = lines_of(items, docs)
    width = F.least(F.size("line"), F.lit(window))
    windows = by_item.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.size("line") - width), lambda s: F.slice("line", s + 1, width))).alias("w"))
    rarest = F.slice(F.array_sort(F.transform("w", lambda x: F.struct(x["n"].alias("n"), x["at"].alias("at"), x["term"].alias("term")))), 1, anchors)
    # a window with a term that the corpus lacks can't occur
    return windows.select("item", rarest.alias("r")).where(F.col("r")[0]["n"] > 0).select("item", F.explode("r").alias("x")).select(F.col("x.term").alias("term"), "item", F.col("x.at").alias("at"), F.col("x.n").alias("n")).distinct()


def phrases(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, anchors: int = ANCHORS) -> DataFrame:
    """(key, item, diagonal): where an item may lie in a document, `diagonal` being the item's start (may be negative)."""
    docs = documents.select(row_key().alias("key"), "text")
    items = settle(benchmark_items(benchmark))
    chosen = settle(anchors_of(items, docs, window, anchors))
    n_chosen = chosen.count()
    postings = docs.select("key", F.posexplode(terms(F.col("text"))).alias("pos", "term"))
    met = meet(postings, chosen.drop("n"), "term", chosen.select("term", "n").distinct(), n_chosen, 48)
    diagonals = met.groupBy("key", "item", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("seen"))
    lines = chosen.groupBy("item").agg(F.collect_set("at").alias("all_at")).join(items.select("item", F.size("words").alias("n")), "item")
    width = F.least(F.col("n"), F.lit(window))
    # a diagonal can hold a window only if every anchor inside that window was seen there
    holds = F.exists(F.sequence(F.lit(0), F.col("n") - width), lambda s: F.size(F.array_intersect(F.filter("all_at", lambda a: (a >= s) & (a < s + width)), "seen")) == F.size(F.filter("all_at", lambda a: (a >= s) & (a < s + width))))
    enough = F.size("seen") >= F.least(F.lit(anchors), width)
    n_lines = n_chosen + items.count()
    if not fits(n_lines, 32):
        diagonals = settle(diagonals)  # counted by item, to deal out items that many documents hold
    return meet(diagonals, lines, "item", diagonals.groupBy("item").agg(F.count("*").alias("n")), n_lines, 32).where(enough & holds).select("key", "item", "diagonal")


def at_places(documents: DataFrame, found: DataFrame, items: DataFrame, before: int = 0) -> DataFrame:
    """found, plus item_id, words, and `doc`: the document's words from `first` on, `before` words ahead of the item's start to
    as many behind its end. found: (key, item, start), settled. A document is cut up once, whatever the number of its places."""
    sizes = items.select("item", F.size("words").alias("n"))
    n_items, n_found = items.count(), found.count()
    by_item = found.groupBy("item").agg(F.count("*").alias("n"))
    places = meet(found, sizes, "item", by_item, n_items, 16).groupBy("key").agg(F.collect_list(F.struct("item", "start", "n")).alias("places"))
    docs = documents.select(row_key().alias("key"), "text").join(small(places, n_found, 24), "key")
    # explode, not a plain column: the text would otherwise be cut into words again for each place
    cut = docs.select("key", "places", F.explode(F.array(terms(F.col("text")))).alias("doc")).select("key", "doc", F.explode("places").alias("p"))
    first = F.greatest(F.col("p.start") - before, F.lit(0))
    part = F.slice("doc", first + 1, F.greatest(F.col("p.start") + F.col("p.n") + before - first, F.lit(0)))
    rows = cut.select("key", "p.item", "p.start", first.alias("first"), part.alias("doc"))
    return meet(rows, items, "item", by_item, n_items, 1024)


def window_hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, anchors: int = ANCHORS) -> DataFrame:
    """(key, hits: distinct (item_id, start, words) of each occurrence of a window), for documents with any; settled."""
    items = settle(benchmark_items(benchmark))
    found = settle(phrases(documents, benchmark, window, anchors).withColumnRenamed("diagonal", "start"))
    rows = at_places(documents, found, items)
    at = lambda j: F.get("doc", F.col("start") + j - F.col("first"))
    same = F.transform("words", lambda w, j: (F.col("start") + j >= 0) & F.coalesce(at(j) == w, F.lit(False)))
    width = F.least(F.size("words"), F.lit(window))
    rows = rows.select("key", "item_id", "start", width.alias("width"), F.explode(F.array(same)).alias("same"))
    starts = F.filter(F.sequence(F.lit(0), F.size("same") - F.col("width")), lambda s: F.forall(F.slice("same", s + 1, F.col("width")), lambda x: x))
    hits = rows.select("key", F.explode(F.transform(starts, lambda s: F.struct("item_id", (F.col("start") + s).alias("start"), F.col("width").alias("words")))).alias("hit"))
    hits = settle(hits.groupBy("key").agg(F.collect_set("hit").alias("hits")))
    discard(items, found)
    return hits


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, anchors: int = ANCHORS) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits.

    A window is `window` consecutive words of an item (a shorter item is one window). Words of a document inside any
    occurrence of a window are hit. Null or wordless texts have no words and no hits; an empty benchmark hits nothing;
    items without words match nothing; an item with a null id marks words but is not counted or named. Repeated rows
    get equal results. Other columns are ignored.
    """
    hits = window_hits(documents, benchmark, window, anchors)
    hit_at = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["words"] - 1))))
    named = F.array_sort(F.array_distinct(F.filter(F.transform("hits", lambda h: h["item_id"].cast("string")), lambda x: x.isNotNull())))
    told = hits.select("key", F.size(hit_at).cast("long").alias("n_hit"), named.alias("named"), "hits")
    rows = documents.select("doc_id", F.size(terms(F.col("text"))).cast("long").alias("n_words"), row_key().alias("key")).join(told, "key", "left")
    names = F.coalesce("named", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    none = F.array().cast(hits.schema["hits"].dataType)
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("hits", none).alias("hits"))


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, anchors: int = ANCHORS) -> DataFrame:
    """The document rows without any benchmark window, as they are; same rules as `contamination`."""
    hits = window_hits(documents, benchmark, window, anchors).select(F.col("key").alias("hit"))
    rows = documents.select(F.struct("*").alias("row"), row_key().alias("key"))
    return rows.join(small(hits, hits.count(), 8), F.col("key") == F.col("hit"), "left_anti").select("row.*")


def near_places(documents: DataFrame, items: DataFrame, within: int, share: float, anchors: int) -> DataFrame:
    """(key, item, lane, starts): where an item may lie near its words' places in a document; lanes part the starts.

    Of an item's n words `lost` may be missing, so of any lost + k words k must be near. The rarest are chosen, k being
    `anchors` where the item has so many: no place with enough words is left out. Words that the corpus lacks are the
    rarest, have no postings and use up what may be missing.
    """
    docs = documents.select(row_key().alias("key"), "text")
    n = F.size("line")
    lost = n - F.ceil(F.lit(share) * n).cast("int")
    chosen = lines_of(items, docs).select("item", F.least(F.greatest(n - lost, F.lit(1)), F.lit(anchors)).alias("k"), lost.alias("lost"), "line")
    rarest = F.slice(F.array_sort(F.transform("line", lambda x: F.struct(x["n"].alias("n"), x["at"].alias("at"), x["term"].alias("term")))), 1, F.col("k") + F.col("lost"))
    chosen = settle(chosen.select("item", "k", F.explode(rarest).alias("x")).where("x.n > 0").select("item", "k", F.col("x.term").alias("term"), F.col("x.at").alias("at"), F.col("x.n").alias("n")))
    postings = docs.select("key", F.posexplode(terms(F.col("text"))).alias("pos", "term"))
    met = meet(postings, chosen.drop("n"), "term", chosen.select("term", "n").distinct(), chosen.count(), 48)
    # the diagonals within the slack of a start make one lane's width, so they lie in two lanes that follow each other
    width = 2 * within + 1
    lane = F.floor((F.col("pos") - F.col("at")) / F.lit(width)).cast("int")
    dealt = met.select("key", "item", "k", F.struct("at", (F.col("pos") - F.col("at")).alias("diagonal")).alias("hit"), F.explode(F.array(lane - 1, lane)).alias("lane"))
    lanes = dealt.groupBy("key", "item", "lane").agg(F.first("k").alias("k"), F.collect_set("hit").alias("hits")).where(F.size("hits") >= F.col("k"))
    first = F.col("lane") * width + within
    met_at = lambda d: F.size(F.array_distinct(F.transform(F.filter("hits", lambda h: F.abs(h["diagonal"] - d) <= within), lambda h: h["at"])))
    return lanes.select("key", "item", "lane", F.filter(F.sequence(first, first + (width - 1)), lambda d: met_at(d) >= F.col("k")).alias("starts")).where(F.size("starts") > 0)


def near_hits(documents: DataFrame, benchmark: DataFrame, within: int = 3, share: float = 0.7, anchors: int = ANCHORS) -> DataFrame:
    """(key, near: (item_id, start, matched, n) of each place of an item), for documents with any; settled. Rules of `proximity`."""
    items = settle(benchmark_items(benchmark))
    found = near_places(documents, items, within, share, anchors)
    found = settle(found.select("key", "item", F.explode("starts").alias("start")).distinct())
    rows = at_places(documents, found, items, before=within)

    def near(w, j):  # whether the word stands within the slack of its place
        low = F.greatest(F.col("start") + j - within, F.lit(0))
        return (F.col("start") + j + within >= 0) & F.array_contains(F.slice("doc", low - F.col("first") + 1, F.greatest(F.col("start") + j + within + 1 - low, F.lit(0))), w)

    rows = rows.select("key", "item", "item_id", "start", F.size("words").alias("n"), F.size(F.filter(F.transform("words", near), lambda x: x)).alias("matched"))
    rows = rows.where(F.col("matched") >= F.lit(share) * F.col("n"))
    told = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("matched")).alias("lost"), "start", "item", "item_id", "n"))).alias("told"))
    # the starts with most words first; those too near to one that is kept tell of its place
    known = lambda kept, x: F.exists(kept, lambda y: (y["item"] == x["item"]) & (F.abs(y["start"] - x["start"]) <= 2 * within))
    kept = F.aggregate("told", F.filter("told", lambda x: F.lit(False)), lambda kept, x: F.when(known(kept, x), kept).otherwise(F.concat(kept, F.array(x))))
    near_of = settle(told.select("key", F.transform(kept, lambda x: F.struct(x["item_id"].alias("item_id"), x["start"].alias("start"), (-x["lost"]).alias("matched"), x["n"].alias("n"))).alias("near")))
    discard(items, found)
    return near_of


def proximity(documents: DataFrame, benchmark: DataFrame, within: int = 3, share: float = 0.7, anchors: int = ANCHORS) -> DataFrame:
    """(doc_id, item_id, start, matched, n): items of which `share` of the words stand near their place in a document.

    `matched` is the number of item words found within `within` positions of where an item that starts at `start` would
    have them, so inserted, lost and replaced words don't hide it. Every start with enough words is told or lies within
    2 * `within` of a told one that has as many. Nulls and empty texts match nothing.
    """
    rows = documents.select("doc_id", row_key().alias("key")).join(near_hits(documents, benchmark, within, share, anchors), "key")
    return rows.select("doc_id", F.explode("near").alias("m")).select("doc_id", "m.*")


def near_contamination(documents: DataFrame, benchmark: DataFrame, within: int = 3, share: float = 0.7, anchors: int = ANCHORS) -> DataFrame:
    """One row per document row: doc_id, n_near, near: the places of `proximity`, as item:start:matched:n in order."""
    told = F.array_sort(F.transform("near", lambda m: F.concat_ws(":", F.coalesce(m["item_id"].cast("string"), F.lit("")), m["start"].cast("string"), m["matched"].cast("string"), m["n"].cast("string"))))
    near = near_hits(documents, benchmark, within, share, anchors)
    rows = documents.select("doc_id", row_key().alias("key")).join(near.select("key", F.size("near").cast("long").alias("n_near"), F.array_join(told, ",").alias("near")), "key", "left")
    return rows.select("doc_id", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.coalesce("near", F.lit("")).alias("near"))
