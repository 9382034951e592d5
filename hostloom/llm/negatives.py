"""Hard-negative mining: a multiway hyperplane tree with distance ranges between siblings, exact in its leaves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hostloom.llm.common import discard, settle

#: Split points of a node, rows that split points are drawn from (fewer if their components exceed SAMPLE_CELLS), and rows that a leaf should hold.
FAN, SAMPLE, SAMPLE_CELLS, LEAF = 8, 4096, 1 << 22, 4096
#: A leaf of more rows is dealt into chunks by id; a task holds one chunk and BLOCK queries at a time.
CHUNK, BLOCK = 1 << 15, 256
#: Positives of an anchor, negatives of a positive.
BEST = 5
_LOW, _HIGH = -(1 << 62), 1 << 62


def labelled(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, x): rows with an id, a label and finite components only; where 7 divides the id the label moves on by one, modulo 10."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return rows.where(F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), x.alias("x"))


# --- vectors in tasks ---------------------------------------------------------------------------


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Components floor(256 * x), a row for each vector; short vectors are filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim))
    out[np.arange(dim) < sizes[:, None]] = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False))
    return out


def _pack(x: np.ndarray) -> list[bytes]:
    """Each vector as 16-bit integers where they fit, else as doubles."""
    return [(row.astype("<i2") if fits else row.astype("<f8")).tobytes() for row, fits in zip(x, (np.abs(x) < 1 << 15).all(axis=1), strict=True)]


def _unpack(column: pa.Array, dim: int) -> np.ndarray:
    out = np.empty((len(column), dim))
    for k, data in enumerate(column.to_pylist()):
        out[k] = np.frombuffer(data, dtype="<i2" if len(data) == 2 * dim else "<f8")
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: doubles while every sum is exact, Python's integers beyond."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in b]
    return np.array([[sum(int(x) * y for x, y in zip(row, other, strict=True)) for other in whole] for row in a], dtype=object).astype(np.int64)


# --- the tree -----------------------------------------------------------------------------------


class Tree:
    """Nodes of up to FAN split points. A vector goes to its nearest split point, so siblings part at hyperplanes.

    `child[n][j]` is a node, or -1 - leaf. After `measure`, `low[n][i, j]` and `high[n][i, j]` hold the range of
    distances from split point i to all vectors below sibling j, and `norm[n][j]` the range of their squared lengths.
    """

    def __init__(self, sample: np.ndarray, leaves: int, fan: int = FAN):
        self.points, self.child, self.leaves = [], [], 0
        self.root = self._grow(np.unique(sample, axis=0), leaves, fan)

    def _grow(self, rows: np.ndarray, leaves: int, fan: int) -> int:
        if leaves < 2 or len(rows) < 2:
            self.leaves += 1
            return -self.leaves
        size = min(fan, leaves, len(rows))
        chosen = [len(rows) // 2]
        far = _distances(rows, rows[chosen])[:, 0]
        while len(chosen) < size:  # the sample row that is farthest from the points so far
            chosen.append(int(far.argmax()))
            far = np.minimum(far, _distances(rows, rows[chosen[-1:]])[:, 0])
        points = rows[chosen]
        nearest = _distances(rows, points).argmin(axis=1)
        node = len(self.points)
        self.points.append(points)
        self.child.append([0] * size)
        for j in range(size):
            below = rows[nearest == j]
            self.child[node][j] = self._grow(below, round(leaves * len(below) / len(rows)), fan)
        return node

    def descend(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each node that rows of x reach: the node, those rows, their distances to its points, the nearest of these."""
        waiting = [(self.root, np.arange(len(x)))] if self.root >= 0 else []
        while waiting:
            node, rows = waiting.pop()
            away = _distances(x[rows], self.points[node])
            nearest = away.argmin(axis=1)
            yield node, rows, away, nearest
            waiting += [(c, part) for j, c in enumerate(self.child[node]) if c >= 0 and len(part := rows[nearest == j])]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), 0 if self.root < 0 else -1, dtype=np.int32)
        for node, rows, _, nearest in self.descend(x):
            to = np.array(self.child[node])[nearest]
            out[rows[to < 0]] = -1 - to[to < 0]
        return out

    def measure(self, ranges: list) -> None:
        """Take in (node, i, j, least, most) from all rows; i is -1 for squared lengths. A sibling without rows stays unreachable."""
        self.low = [np.full((len(p), len(p)), np.inf) for p in self.points]
        self.high = [np.full((len(p), len(p)), -np.inf) for p in self.points]
        self.norm = [np.tile([np.inf, -np.inf], (len(p), 1)) for p in self.points]
        for node, i, j, least, most in ranges:
            if i < 0:
                self.norm[node][j] = least, most
            else:
                self.low[node][i, j], self.high[node][i, j] = least, most

    def reach(self, x: np.ndarray, own: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which leaves (columns) may hold a vector that scores between lo and hi with x[own], for each window (rows).

        A score s with a vector of squared length n lies at the squared distance |x|^2 + n - 2 s, so a window and the
        range of n below a sibling give an annulus around x. A sibling goes if for any split point the distances that
        the triangle inequality allows to vectors in the annulus miss the range stored for that sibling.
        """
        out = np.zeros((len(lo), self.leaves), dtype=bool)
        if self.root < 0:
            out[:] = True
            return out
        length = (x * x).sum(axis=1)
        waiting = [(self.root, np.arange(len(lo)))]
        while waiting:
            node, rows = waiting.pop()
            anchor = own[rows]
            away = _distances(x[anchor], self.points[node])[:, :, None]
            least, most = self.norm[node].T
            slack = 1e-9 * (length[anchor][:, None] + np.where(np.isfinite(most), most, 0)) + 1e-6
            inner = np.sqrt(np.maximum(length[anchor][:, None] + least - 2.0 * hi[rows][:, None] - slack, 0))[:, None, :]
            square = length[anchor][:, None] + most - 2.0 * lo[rows][:, None] + slack
            outer = np.sqrt(np.maximum(square, 0))[:, None, :]
            room = 1e-6 + 1e-7 * (np.sqrt(length[anchor][:, None]) + np.sqrt(np.where(np.isfinite(most), most, 0)))[:, None, :]
            meets = (away + outer + room >= self.low[node]) & (np.maximum(away - outer, inner - away) - room <= self.high[node])
            alive = meets.all(axis=1) & (square >= 0)
            for j, c in enumerate(self.child[node]):
                part = rows[alive[:, j]]
                if c < 0:
                    out[part, -1 - c] = True
                elif len(part):
                    waiting.append((c, part))
        return out


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2 * (x @ points.T), 0))


# --- the index ----------------------------------------------------------------------------------

_ROW = "leaf int, vec_id long, label long, vec binary"


class Index:
    """Every labelled row in a leaf of the tree, settled; the tree with its ranges is broadcast.

    Split points come from SAMPLE rows, by hash order; routing, ranges and leaves cover all rows. The tree's size is
    bounded by the sample, whatever the number of rows; larger leaves are dealt into more chunks.
    """

    def __init__(self, rows: DataFrame, fan: int = FAN, leaf: int = LEAF, chunk: int = CHUNK):
        spark = rows.sparkSession
        n, dim = rows.agg(F.count("*"), F.max(F.size("x"))).first()
        self.dim = dim = dim or 0
        size = min(SAMPLE, max(2, SAMPLE_CELLS // max(1, dim)))
        found = rows.select("x", F.xxhash64("vec_id").alias("h")).orderBy("h", "x").limit(size).collect() if n > leaf else []
        sample = np.zeros((len(found), dim))
        for k, r in enumerate(found):
            sample[k, : len(r.x)] = np.floor(256 * np.array(r.x, dtype=float))
        self.tree = tree = Tree(sample, min(-(-n // leaf), max(1, size // 8)), fan)
        shared = spark.sparkContext.broadcast(tree)

        def route(batches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(2), dim)
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.leaf(x)), batch.column(0), batch.column(1), pa.array(_pack(x), pa.binary())], ["leaf", "vec_id", "label", "vec"])

        def ranges(batches) -> Iterator[pa.RecordBatch]:
            seen: dict[tuple, list] = {}

            def take(key: tuple, values: np.ndarray) -> None:
                old = seen.setdefault(key, [np.inf, -np.inf])
                old[:] = min(old[0], values.min()), max(old[1], values.max())

            for batch in batches:
                x = _unpack(batch.column(0), dim)
                length = (x * x).sum(axis=1)
                for node, rows, away, nearest in shared.value.descend(x):
                    for j in np.unique(nearest).tolist():
                        here = nearest == j
                        take((node, -1, j), length[rows[here]])
                        for i in range(away.shape[1]):
                            take((node, i, j), away[here, i])
            out = [(*key, *map(float, span)) for key, span in seen.items()]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["node", "i", "j", "least", "most"])

        self.routed = settle(rows.select("vec_id", "label", "x").mapInArrow(route, _ROW))
        spans = self.routed.select("vec").mapInArrow(ranges, "node int, i int, j int, least double, most double")
        tree.measure(spans.groupBy("node", "i", "j").agg(F.min("least"), F.max("most")).collect())  # bounded by the tree
        self.shared = spark.sparkContext.broadcast(tree)
        counted = {r.leaf: -(-r.n // chunk) for r in self.routed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
        self.chunks = F.element_at(F.lit([counted.get(k, 0) for k in range(tree.leaves)]).cast("array<int>"), F.col("leaf") + 1)
        self.rows = self.routed.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.greatest(self.chunks, F.lit(1))).cast("int"))

    def reachable(self, queries: DataFrame) -> DataFrame:
        """queries(anchor, anchor_id, label, vec, home, lo, hi) -> one row for each leaf but the home that the windows may reach, with `leaf`."""
        shared, dim = self.shared, self.dim

        def run(batches) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, BLOCK):
                    batch = whole.slice(start, BLOCK)
                    lo, hi = batch.column("lo"), batch.column("hi")
                    sizes = np.diff(lo.offsets.to_numpy())
                    own = np.repeat(np.arange(len(sizes)), sizes)
                    may = shared.value.reach(_unpack(batch.column("vec"), dim), own, lo.flatten().to_numpy(), hi.flatten().to_numpy())
                    any_of = np.zeros((len(sizes), may.shape[1]), dtype=bool)
                    np.logical_or.at(any_of, own, may)
                    any_of[np.arange(len(sizes)), batch.column("home").to_numpy()] = False
                    at, leaf = np.nonzero(any_of)
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(leaf.astype(np.int32))], [*batch.schema.names, "leaf"])

        return queries.mapInArrow(run, f"{_QUERY}, leaf int")

    def search(self, queries: DataFrame, same: bool) -> DataFrame:
        """queries with a `leaf` each -> (anchor, hi, vec_id, score): of each chunk of that leaf, the BEST rows of each window.

        `same`: rows of the query's label but with another id; else rows of other labels. Rows come before queries, chunk
        by chunk, so a task holds one chunk. Of rows that share vector and label only the BEST + 1 least ids are scored:
        no others can be among the first BEST.
        """
        dim = self.dim
        queries = queries.where(self.chunks > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), self.chunks - 1)))
        none = [F.lit(None).cast(t).alias(c) for c, t in (("anchor", "long"), ("lo", "array<long>"), ("hi", "array<long>"))]
        both = self.rows.select("leaf", "chunk", F.lit(0).alias("kind"), "vec_id", "label", "vec", *none).unionByName(queries.select("leaf", "chunk", F.lit(1).alias("kind"), F.col("anchor_id").alias("vec_id"), "label", "vec", "anchor", "lo", "hi"))
        ordered = both.repartition("leaf", "chunk").sortWithinPartitions("leaf", "chunk", "kind")

        def run(batches) -> Iterator[pa.RecordBatch]:
            now, held, ready = None, [], None
            for whole in batches:
                marks = np.stack([whole.column(k).to_numpy() for k in range(3)], axis=1)
                cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
                for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(marks)], strict=True):
                    if start == end:
                        continue
                    leaf, chunk, kind = marks[start].tolist()
                    if now != (leaf, chunk):
                        now, held, ready = (leaf, chunk), [], None
                    part = whole.slice(start, end - start)
                    if kind == 0:
                        held.append((part.column("vec_id").to_numpy(), part.column("label").to_numpy(), _unpack(part.column("vec"), dim)))
                        continue
                    if held and ready is None:
                        ready = _distinct(*map(np.concatenate, zip(*held, strict=True)))
                    for k in range(0, part.num_rows if ready else 0, BLOCK):
                        yield _best(part.slice(k, BLOCK), ready, same, dim)

        return ordered.mapInArrow(run, "anchor long, hi long, vec_id long, score long")

    def discard(self) -> None:
        discard(self.routed)


def _distinct(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows in order of id; of equal vectors of one label the BEST + 1 least ids, and of repeated rows one."""
    order = np.argsort(ids, kind="stable")
    ids, labels, x = ids[order], labels[order], np.ascontiguousarray(x[order]) + 0.0
    kind = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1] if x.shape[1] else np.zeros(len(ids), dtype=np.int64)
    by = np.lexsort((ids, labels, kind))
    fresh = np.append(True, (np.diff(kind[by]) != 0) | (np.diff(labels[by]) != 0))
    new = fresh | np.append(True, np.diff(ids[by]) != 0)
    by, fresh = by[new], fresh[new]
    place = np.arange(len(by)) - np.maximum.accumulate(np.where(fresh, np.arange(len(by)), 0))
    keep = np.sort(by[place <= BEST])
    return ids[keep], labels[keep], x[keep]


def _best(part: pa.RecordBatch, rows: tuple[np.ndarray, np.ndarray, np.ndarray], same: bool, dim: int) -> pa.RecordBatch:
    ids, labels, x = rows
    scores = _scores(_unpack(part.column("vec"), dim), x)
    out: list[tuple[int, int, int, int]] = []
    columns = [part.column(c).to_pylist() for c in ("anchor", "vec_id", "label", "lo", "hi")]
    for line, (anchor, own, label, los, his) in zip(scores, zip(*columns, strict=True), strict=True):
        fits = (labels == label) & (ids != own) if same else labels != label
        for lo, hi in zip(los, his, strict=True):
            at = np.flatnonzero(fits & (line >= lo) & (line <= hi))
            if len(at) > BEST:
                least = np.partition(line[at], len(at) - BEST)[len(at) - BEST]
                at = at[line[at] >= least]
                at = at[np.lexsort((ids[at], -line[at]))[:BEST]]
            out += [(anchor, hi, i, s) for i, s in zip(ids[at].tolist(), line[at].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], ["anchor", "hi", "vec_id", "score"])


# --- mining -------------------------------------------------------------------------------------

_QUERY = "anchor long, anchor_id long, label long, vec binary, home int, lo array<long>, hi array<long>"


def _first(found: DataFrame) -> DataFrame:
    """The BEST rows of each window: higher scores first, then smaller ids."""
    place = F.row_number().over(Window.partitionBy("anchor", "hi").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).where(F.col("place") <= BEST)


def _ask(index: Index, queries: DataFrame, same: bool) -> DataFrame:
    """The BEST rows of each window over all leaves: first the home leaf, whose results narrow the windows, then the leaves that these reach."""
    at_home = settle(_first(index.search(queries.withColumn("leaf", F.col("home")), same)))
    full = at_home.where(F.col("place") == BEST).select("anchor", "hi", F.col("score").alias("least"))
    window = queries.select("anchor", F.explode(F.arrays_zip("lo", "hi")).alias("w")).select("anchor", "w.lo", "w.hi")
    narrow = window.join(full, ["anchor", "hi"], "left").groupBy("anchor").agg(F.collect_list(F.struct(F.greatest("lo", "least").alias("lo"), "hi")).alias("w"))
    rest = queries.drop("lo", "hi").join(narrow, "anchor").select("anchor", "anchor_id", "label", "vec", "home", "w.lo", "w.hi")
    found = settle(_first(at_home.drop("place").unionByName(index.search(index.reachable(rest), same))))
    discard(at_home)
    return found


def mine(embeddings: DataFrame, every: int = 100, low: int = 80, fan: int = FAN, leaf: int = LEAF, chunk: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id `every` divides; an anchor's positives are the BEST rows of its label by inner
    product, and the negatives of each are the BEST rows of other labels that score from low % of the positive's
    score up to all of it. Ties go by id; a negative positive score leaves an empty window. Exact: every row lies in a
    leaf, and leaves are passed over only where no row can lie in a window.

    Rows without id, label or vector, or with a null or non-finite component, take no part; short vectors are filled
    up with zeros; rows equal in id, label and vector count once, rows that share only the id are rows of their own but
    never each other's positives. An empty table, a label of one row, or no row in a window: no result rows. Scores must
    fit a long. Other columns are left out.
    """
    index = Index(labelled(embeddings), fan, leaf, chunk)
    distinct = index.routed.where(F.col("vec_id") % every == 0).distinct()
    anchors = settle(distinct.select(F.monotonically_increasing_id().alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "vec", F.col("leaf").alias("home")))
    ends = [F.array(F.lit(v).cast("long")).alias(c) for v, c in ((_LOW, "lo"), (_HIGH, "hi"))]
    positives = _ask(index, anchors.select("*", *ends), True).select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    window = positives.select("anchor", F.col("positive_score").alias("hi"), F.ceil(F.col("positive_score") * F.lit(low).cast("decimal(3,0)") / 100).cast("long").alias("lo")).distinct()
    windows = window.where("lo <= hi").groupBy("anchor").agg(F.collect_list(F.struct("lo", "hi")).alias("w"))
    negatives = _ask(index, anchors.join(windows, "anchor").select("anchor", "anchor_id", "label", "vec", "home", "w.lo", "w.hi"), False)
    out = positives.join(negatives, (positives.anchor == negatives.anchor) & (positives.positive_score == negatives.hi)).drop(negatives.anchor)
    index.discard()
    return out.join(anchors.select("anchor", "anchor_id"), "anchor").select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
