"""N-gram Jaccard join by parity sketches.

A document is its set of word shingles. Shingles are dealt by hash into the parts of a parity sketch; each toggles bits
of its part, so sketches of two sets differ in at most as many places as the sets do. Sets of n and m shingles that link
at 90 % differ in at most (n + m) / 19 shingles (at 80 % in (n + m) / 9), and that is fewer than the parts of their size band: one part at least
is equal (pigeonhole), and documents that share no part of a band can't link.

1. Sets as digests of 128 bits; equal sets are one from here on, named by a number.
2. Parts of all size bands pass a count-min sketch; only parts that repeat are shuffled. There are twice as many parts as
   a link needs, so linked sets share many, and each set can do without its most frequent ones: it keeps as many of its
   rarest parts, in one order for all sets, as it may differ in, and one more (`part_groups`). Parts that a template
   puts into many texts go first; a text with that many parts of its own has no candidates at all.
3. Stars, in two rounds. First every set is compared with one other, of the sets that are least in its parts the one that
   shares most of them: this joins most groups of copies. Then, where a part's sets still lie in two or more
   components, its least and greatest set are compared with those of other components. The Hamming distance of the
   sketches (a few bits for each shingle), a lower bound, discards pairs; only sets of the others are shuffled with
   their shingles, to verify them.
4. What is left: parts whose other sets still lie in two or more components. The sketches of each such part's sets are
   compared, in pairs of blocks of bounded size; sets that may link by them are cut into blocks anew and verified on
   their shingles, but for those that are joined already. Only this step is quadratic, in the sketches of sets that
   share one part, four or more of them, and yet don't link by way of a star.
5. Components of the links; each takes the least doc_id of its documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hostloom.llm import countmin
from hostloom.llm.common import SLICE, as_bytes, discard, mix, rolling, row_key, settle, small, word_hashes
from hostloom.llm.components import components

SHINGLE, PERCENT = 3, 90
#: Cells in each row of the sketch, as a power of two: 2 rows of 2 ** 27 bits are broadcast, 32 MB.
SKETCH_BITS = 27
#: Sets and bytes of shingles in a block of a candidate group; sets that one task compares with a star's centre.
BLOCK_SETS, BLOCK_BYTES, STAR_SETS = 512, 8 << 20, 4096
#: Ways to deal a set's shingles to parts before empty parts count.
LEVELS = 8
#: Bytes of shingles that a task hands on at once.
BATCH_BYTES = 32 << 20


def shingles(data: bytes, size: int = SHINGLE, seed: int = 0) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; a text of fewer words is one shingle, without words it has none.
    Hashes of two seeds are independent."""
    words = word_hashes(data.lower(), seed)  # of bytes: A-Z only
    if len(words) == 0:
        return words
    return np.unique(rolling(words, min(size, len(words)), 61 + 4 * max(0, size - len(words))))


def digest(found: np.ndarray) -> int:
    """A signed 64-bit sum that names the set."""
    return int(mix(found, 71).sum(dtype=np.uint64).view(np.int64)) if len(found) else 0


def difference(n: int, percent: int) -> int:
    """Most shingles in which a set of n can differ from a larger set that it links with."""
    return (100 - percent) * n // percent


def part_groups(found: np.ndarray, percent: int = PERCENT) -> list[tuple[int, np.ndarray, int]]:
    """(group, keys, keep) of the parts of a set's parity sketch, in its size band and, if it can link there, in the band below.

    Sizes from 2 ** b to 2 ** (b + 1) - 1 are band b. It has twice as many parts as are more than any two linked sets of
    the band differ in. A part's key is the XOR of its shingles' hashes. Parts without a shingle have no key: where more
    parts have one than the set can differ in, an equal part is among them. Other sets deal their shingles anew, by the
    next of LEVELS hashes, so two sets neither of which was done at a level meet at the next. Only after the last one empty
    parts get keys too.

    `keep`: a set with c keys that may differ in d parts shares c - d keys of the group or more with each set that it
    links with. Where all sets drop their last keys in one common order, such that each keeps d + 1 of them, linked sets
    still share one. Groups whose shared keys have no such bound (c <= d, or empty parts with keys) keep all.
    """
    n = len(found)
    if not n:
        return []
    band, most = n.bit_length() - 1, difference(n, percent)
    groups = []
    for b in (band, band - 1) if band and n * percent <= 100 * ((1 << band) - 1) else (band,):
        top = difference((2 << b) - 1, percent) + 1
        top += top
        for level in range(LEVELS):
            part = ((mix(found, 81 + 16 * level) >> np.uint64(32)) * np.uint64(top) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part = part[order]
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            value, at = np.bitwise_xor.reduceat(mix(found, 82)[order], first), part[first]
            done = len(at) > most
            if not done and level == LEVELS - 1:
                full = np.zeros(top, dtype=np.uint64)
                full[at] = value
                value, at = full, np.arange(top)
            groups.append((b << 8 | level, mix(value ^ mix(at.astype(np.uint64) + np.uint64((b << 8 | level) << 40), 84)), most + 1 if done else len(at)))
            if done:
                break
    return groups


def parts(found: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The keys of all groups."""
    return np.concatenate([keys for _, keys, _ in part_groups(found, percent)]) if len(found) else found


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets of distinct hashes link."""
    least, most = sorted((len(a), len(b)))
    if 100 * least < percent * most:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (least + most - both)


def parity(found: np.ndarray) -> bytes:
    """The parity sketch: each shingle toggles one of 4 * 2 ** band bits, 64 at least. Sketches of the next band fold to this one's."""
    bits = max(64, 4 << (max(1, len(found)).bit_length() - 1))
    return np.packbits(np.bincount((mix(found, 83) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def fold(sketches: np.ndarray) -> np.ndarray:
    half = sketches.shape[-1] // 2
    return sketches[..., :half] ^ sketches[..., half:]


def most(n: np.ndarray | int, m: int, percent: int):
    """Most shingles in which linked sets of n and m differ."""
    return (100 - percent) * (n + m) // (100 + percent)


def may_link(n: int, a: bytes, m: int, b: bytes, percent: int) -> bool:
    """Whether sizes and sketches of two sets allow a link."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    if abs(n - m) > most(n, m, percent):
        return False
    while len(x) != len(y):
        x, y = (fold(x), y) if len(x) > len(y) else (x, fold(y))
    return int(np.bitwise_count(x ^ y).sum()) <= most(n, m, percent)


def joins(n: np.ndarray, sketches: list[bytes], left: np.ndarray, right: np.ndarray, percent: int, known: np.ndarray, verify: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Pairs between sets of `left` and of `right` (masks; the same array: all its pairs) of different `known` components that
    the sketches allow, as far as they join sets that no earlier pair has joined. With `verify`, pairs that it confirms;
    sets of one component are then joined from the start."""
    width = np.array([len(x) for x in sketches]) // 8
    at = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}
    rows = {w: np.frombuffer(b"".join(sketches[i] for i in ids), dtype=np.uint64).reshape(len(ids), w) for w, ids in at.items()}
    _, first, of = np.unique(known, return_index=True, return_inverse=True)
    root = first[of] if verify else np.arange(len(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    out = []
    for w, ids in at.items():
        wider = (at[2 * w], fold(rows[2 * w])) if 2 * w in at else (ids[:0], rows[w][:0])
        for r, i in enumerate(ids.tolist()):
            for others, table in ((ids[r + 1 :], rows[w][r + 1 :]), wider):
                fits = (known[others] != known[i]) & (np.abs(n[others] - n[i]) <= most(n[others], n[i], percent))
                fits &= right[others] if left is right or left[i] else left[others]
                if left is right and not left[i]:
                    continue
                others, table = others[fits], table[fits]
                near = np.bitwise_count(table ^ rows[w][r]).sum(axis=1) <= most(n[others], n[i], percent)
                for j in others[near].tolist():
                    a, b = find(i), find(j)
                    if a != b and (verify is None or verify(i, j)):
                        root[a] = b
                        out.append((i, j))
    return out


def near_duplicates(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bits: int = SKETCH_BITS) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id.

    A set: distinct `size`-word shingles (A-Z lower-cased; fewer words: the whole sequence as one). Documents link when
    100 * intersection >= percent * union; component_id is the least doc_id that links reach. Null, empty and wordless
    texts have no shingles and stand alone. Rows are judged by their own texts, also where they share a doc_id. Rows with
    a null id link like others; only a component without any id has component_id null. Sets are compared by 64-bit
    hashes of shingles and named by 128 bits; texts are read whole.
    """
    rows, named = classes(documents, size, percent, bits)
    full = rows.where("n_shingles > 0").join(named, ["s1", "s2"]).select("doc_id", "n_shingles", "component_id")
    return full.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def classes(documents: DataFrame, size: int, percent: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows, named), both settled: rows of doc_id, key, n_shingles, s1, s2; named sets of s1, s2, component, component_id."""

    def describe(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in as_bytes(batch.column(1)):
                found = shingles(data or b"", size)
                out.append((len(found), digest(found), digest(shingles(data or b"", size, 200)), parity(found) if len(found) else None))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary())], ["doc_id", "key", "n_shingles", "s1", "s2", "sketch"])

    docs = documents.select(F.col("doc_id").cast("long"), "text").withColumn("key", row_key())
    rows = settle(docs.mapInArrow(describe, "doc_id long, key long, n_shingles long, s1 long, s2 long, sketch binary"))
    sets = rows.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n"), F.min("key").alias("key"), F.min("sketch").alias("sketch"))
    sets = settle(sets.withColumn("node", F.monotonically_increasing_id()))
    joined = joined_sets(docs, sets, size, percent, bits)
    of = settle(sets.join(joined, "node", "left").select("s1", "s2", "id", F.coalesce("component", "node").alias("component")))
    least = of.groupBy("component").agg(F.min("id").alias("component_id"))
    named = settle(of.join(least, "component").select("s1", "s2", "component", "component_id"))
    discard(sets, of, joined)
    return rows, named


def joined_sets(docs: DataFrame, sets: DataFrame, size: int, percent: int, bits: int) -> DataFrame:
    """(node, component) of the sets that link with others."""
    found = shared_parts(docs, sets, size, percent, bits)
    least = found.groupBy("part").agg(F.min("node").alias("hub"), F.max("node").alias("high")).where(F.col("hub") < F.col("high")).select("part", "hub")
    shared = found.join(least, "part").where(F.col("node") != F.col("hub")).groupBy("node", "hub").agg(F.count("*").alias("n"))
    near = settle(shared.groupBy("node").agg(F.max(F.struct("n", "hub")).alias("m")).select("node", "m.hub"))
    links = settle(star_links(docs, sets, near, size, percent))
    joined = components(links)

    # rows of parts whose sets lie in two or more components
    ends = [F.min("label").alias("a"), F.max("label").alias("b"), F.min("node").alias("low"), F.max("node").alias("high"), F.min_by("label", "node").alias("low_label"), F.max_by("label", "node").alias("high_label")]
    labelled = lambda rows, joined: rows.join(small(joined, joined.count(), 16), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    rows = labelled(found, joined)
    undone = settle(rows.groupBy("part").agg(*ends).where(F.col("a") < F.col("b")).drop("a", "b"))
    rows = settle(rows.join(undone, "part"))
    stars = rows.select("node", "label", F.explode(F.array(F.struct(F.col("low").alias("hub"), F.col("low_label").alias("hub_label")), F.struct(F.col("high").alias("hub"), F.col("high_label").alias("hub_label")))).alias("e"))
    stars = stars.where((F.col("node") != F.col("e.hub")) & (F.col("label") != F.col("e.hub_label"))).select("node", "e.hub").distinct()
    stars = settle(stars.join(near, ["node", "hub"], "left_anti"))
    discard(found, near, undone)
    if stars.first() is None:
        discard(rows, links, stars)
        return joined
    more = settle(star_links(docs, sets, stars, size, percent))
    discard(joined)
    links = settle(links.unionByName(more))
    joined = components(links)
    others = settle(labelled(rows.where((F.col("node") != F.col("low")) & (F.col("node") != F.col("high"))).select("part", "node"), joined))
    crowded = others.groupBy("part").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n_part")).where(F.col("a") < F.col("b")).select("part", "n_part")
    rest = settle(others.join(crowded, "part"))
    discard(rows, stars, more, others)
    if rest.first() is not None:
        more = settle(block_links(docs, sets, rest, size, percent))
        discard(joined)
        joined = components(links.unionByName(more))
        discard(more)
    discard(links, rest)
    return joined


def shared_parts(docs: DataFrame, sets: DataFrame, size: int, percent: int, bits: int) -> DataFrame:
    """(part, node), settled: of the parts that the sketch counts twice or more each set's rarest ones, as many as it must
    keep. A part is as frequent as the sets that have it; parts that the sketch counts once come before all others."""
    texts = docs.where(F.col("text").isNotNull()).select("text")

    def keys(columns: dict) -> Iterator[np.ndarray]:
        for data in as_bytes(columns["text"]):
            yield parts(shingles(data, size), percent)

    sketch = countmin.build(texts, keys, bits)

    def repeated(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list[np.ndarray]] = [[], [], [], []]
            for data in as_bytes(batch.column(0)):
                found = shingles(data, size)
                name = digest(found)
                for group, key, keep in part_groups(found, percent):
                    again = countmin.repeated(sketch.value, key, bits)
                    keep -= len(key) - int(again.sum())
                    if keep > 0:
                        key = key[again].view(np.int64)
                        for column, value in zip(made, (key, name, group, keep), strict=True):
                            column.append(np.broadcast_to(np.asarray(value, dtype=np.int64), key.shape))
            if made[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in made], ["part", "s1", "grp", "keep"])

    found = settle(texts.mapInArrow(repeated, "part long, s1 long, grp long, keep long").distinct())
    often = found.groupBy("part").agg(F.count("*").alias("often")).where("often > 1")
    place = F.row_number().over(Window.partitionBy("s1", "grp").orderBy(F.coalesce("often", F.lit(1)), "part"))
    every, found = found, found.join(often, "part", "left").withColumn("place", place).where("place <= keep AND often > 1").select("part", "s1")
    # half of the digest finds the set: should two sets share it, both get the part and are verified later
    found = settle(found.join(small(sets.select("s1", "node"), sets.count(), 16), "s1").select("part", "node"))
    sketch.destroy()
    discard(every)
    return found


def dealt(docs: DataFrame, sets: DataFrame, places: DataFrame, size: int) -> DataFrame:
    """(g, i, j, tag, node, label, found): the shingles of sets, dealt to all their places; places: node, label, place: struct
    of g, i, j, tag. A set's text is read and hashed once, and its shingles are shuffled once for each place."""
    to = places.groupBy("node").agg(F.min("label").alias("label"), F.collect_set("place").alias("places"))
    wanted = settle(to.join(sets, "node").select("key", "s1", "node", "label", "places"))
    n = wanted.agg(F.sum(F.size("places") + 2)).first()[0] or 0
    names = ["g", "i", "j", "tag", "node", "label", "found"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def gather(batches) -> Iterator[pa.RecordBatch]:
        out, n, done = [], 0, set()
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names)
        for batch in batches:
            for data, s1, node, label, places in zip(as_bytes(batch.column(0)), *[batch.column(k).to_pylist() for k in range(1, 5)], strict=True):
                if node in done:  # repeated rows of a text: one from each task will do
                    continue
                found = shingles(data or b"", size)
                if digest(found) != s1:  # another text has the key's hash
                    continue
                done.add(node)
                raw = found.tobytes()
                out += [(p["g"], p["i"], p["j"], p["tag"], node, label, raw) for p in places]
                n += len(raw) * len(places)
                if n >= BATCH_BYTES:
                    yield pack(out)
                    out, n = [], 0
        yield pack(out)

    read = docs.join(small(wanted, n, 24), "key").select("text", "s1", "node", "label", "places")
    return read.mapInArrow(gather, "g long, i int, j int, tag int, node long, label long, found binary")


def allowed(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub, node) that sizes and sketches allow to link."""

    def near(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may_link(*x, percent) for x in zip(*[batch.column(k).to_pylist() for k in range(2, 6)], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["hub", "node"]).filter(pa.array(keep, pa.bool_()))

    of = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    pairs = stars.join(of("node"), "node").join(of("hub"), "hub")
    return pairs.select("hub", "node", "n_hub", "s_hub", "n_node", "s_node").mapInArrow(near, "hub long, node long")


def star_links(docs: DataFrame, sets: DataFrame, stars: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v): the links between stars' centres and the others. A star is dealt in chunks, each led by its centre; a task
    holds two sets at a time."""
    stars = settle(allowed(stars, sets, percent))
    chunks = stars.groupBy("hub").agg(F.ceil(F.count("*") / STAR_SETS).cast("int").alias("chunks"))
    place = lambda chunk, tag: F.struct(F.col("hub").alias("g"), chunk.alias("i"), F.lit(0).alias("j"), F.lit(tag).alias("tag")).alias("place")
    rays = stars.join(chunks, "hub").select("node", F.col("node").alias("label"), place(F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"), 1))
    centres = chunks.select("hub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c")).select(F.col("hub").alias("node"), F.col("hub").alias("label"), place(F.col("c"), 0))
    led = dealt(docs, sets, rays.unionByName(centres), size).repartition("g", "i").sortWithinPartitions("g", "i", "tag")

    def compare(batches) -> Iterator[pa.RecordBatch]:
        at, centre = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            u, v = [], []
            for k in range(0, len(batch), SLICE):
                for hub, tag, node, data in zip(*[c.to_pylist() for c in batch.slice(k, SLICE).columns], strict=True):
                    found = np.frombuffer(data, dtype=np.uint64)
                    if not tag:
                        at, centre = hub, found
                    elif at == hub and linked(centre, found, percent):
                        u.append(hub)
                        v.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return led.select("g", "tag", "node", "found").mapInArrow(compare, "u long, v long")


def grouped(batches) -> Iterator[pa.Table]:
    """The rows of each (g, i, j), of which rows stand together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        key = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("g", "i", "j")])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if held and tuple(key[:, s]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = tuple(key[:, s])
    if held:
        yield pa.Table.from_batches(held)


def _told(groups: Iterator[pa.Table], joined: Callable[[pa.Table, np.ndarray, np.ndarray], list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """(u, v) of what is joined in each group; a group is a pair of blocks, or one block with itself."""
    for group in groups:
        i, j, tag = (np.asarray(group.column(c)) for c in ("i", "j", "tag"))
        left = tag == i[0]
        pairs = joined(group, left, left if i[0] == j[0] else tag == j[0])
        if pairs:
            node = np.asarray(group.column("node"))
            at = np.array(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(node[at[:, 0]]), pa.array(node[at[:, 1]])], ["u", "v"])


def _paired(rows: DataFrame, blocks: F.Column) -> DataFrame:
    """rows once for each pair of blocks of their group `g` that holds them: adds i, j, and the own block `tag`."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("blocks", blocks.cast("int")).withColumn("tag", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("tag", "other")).withColumn("j", F.greatest("tag", "other")).drop("blocks", "other")


def block_links(docs: DataFrame, sets: DataFrame, rest: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v): links between sets that parts join and stars have not; rest: part, node, label, n_part (its rows)."""

    def sketched(group: pa.Table, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        return joins(np.asarray(group.column("n")), group.column("sketch").to_pylist(), left, right, percent, np.asarray(group.column("label")))

    def verified(group: pa.Table, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        found = [np.frombuffer(b, dtype=np.uint64) for b in group.column("found").to_pylist()]
        check = lambda i, j: linked(found[i], found[j], percent)
        return joins(np.array([len(f) for f in found]), [parity(f) for f in found], left, right, percent, np.asarray(group.column("label")), check)

    first = _paired(rest.withColumnRenamed("part", "g"), F.ceil(F.col("n_part") / BLOCK_SETS)).drop("n_part")
    first = first.join(sets.select("node", "n", "sketch"), "node").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").select("g", "i", "j", "tag", "node", "label", "n", "sketch")
    may = settle(first.mapInArrow(lambda batches: _told(grouped(batches), sketched), "u long, v long").distinct())
    labels = rest.groupBy("node").agg(F.min("label").alias("label"))
    members = settle(components(may).withColumnRenamed("component", "g").join(labels, "node").join(sets.select("node", "n"), "node"))
    cuts = members.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).alias("cut"))
    places = _paired(members.join(cuts, "g"), F.col("cut")).select("node", "label", F.struct("g", "i", "j", "tag").alias("place"))
    second = dealt(docs, sets, places, size).repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    return second.mapInArrow(lambda batches: _told(grouped(batches), verified), "u long, v long")


def one_of_each(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bits: int = SKETCH_BITS) -> DataFrame:
    """The documents, one of each component: of those with the least doc_id (null only where none has an id) one row.
    Rows without words are in no component and stay, repeated or not."""
    rows, named = classes(documents, size, percent, bits)
    of = settle(rows.where("n_shingles > 0").join(named, ["s1", "s2"]).select("doc_id", "key", "component"))
    best = of.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("m"), F.count("*").alias("n_rows")).where("n_rows > 1")
    odd = settle(of.join(best, "component").select(F.col("key").alias("odd"), (F.col("key") == F.col("m.key")).alias("stays")).distinct())
    discard(rows, named, of)
    packed = documents.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("key"))  # whatever the other columns are called
    marked = packed.join(small(odd, odd.count(), 9), F.col("key") == F.col("odd"), "left")
    once = marked.where(F.col("stays").isNull()).select("row.*")
    return once.unionByName(marked.where("stays").dropDuplicates(["key"]).select("row.*"))
