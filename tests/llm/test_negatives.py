"""Hard negatives against brute force: random, clustered, tied, repeated and broken vectors; leaves that are passed over."""

import math

import numpy as np
import pytest

from hostloom.llm import negatives, queries
from hostloom.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, leaf string, score string, anchor string, x int"


def brute(rows, every=100):
    kept = {}
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        kept[(i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in e))] = True
    out = []
    for i, label, a in [k for k in kept if k[0] % every == 0]:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), j, other == label) for j, other, b in kept)
        for s, j, _ in [r for r in scored if r[2] and r[1] != i][:5]:
            fits = [r for r in scored if not r[2] and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(i, j, k, n, -s, -t) for k, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **sizes):
    df = spark.createDataFrame([(i, e, label, "z", "z", "z", 1) for i, e, label in rows], SCHEMA).repartition(5)
    return sorted(map(tuple, negatives.mine(df, **sizes).collect()))


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 0.2, (12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(0, 0.03, 16)], int(rng.integers(0, 4))) for i in range(0, 2600, 4)]
    rows += [(5000 + i, rows[0][1], i % 3) for i in range(0, 400)]  # one vector in many rows
    rows += [(100, rows[7][1], 2), (100, rows[7][1], 2), rows[25], rows[25]]  # one id twice, repeated rows
    rows += [(9000, None, 1), (9100, [1.0] * 16, None), (9200, [1.0, None] * 8, 1), (9300, [float("nan")] * 16, 1), (9400, [float("inf")] * 16, 1), (None, [0.1] * 16, 1), (9500, [], 1), (9600, [0.3, 0.2], 2), (9700, [0.0] * 16, 3), (-100, rows[3][1], 1), (9800, [-0.1] * 16, 1)]
    want = brute(rows)
    assert want
    for sizes in ({}, {"leaf": 40, "fan": 3, "chunk": 25}, {"leaf": 8, "fan": 5, "chunk": 7}):
        assert mined(spark, rows, **sizes) == want


def test_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [0.5, 0.5], 1)]) == []
    assert mined(spark, [(100, [0.5, 0.5], 1), (1, [0.5, 0.5], 1)]) == []
    assert mined(spark, [(100, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [-0.5, 0.5], 2)]) == []
    assert mined(spark, [(100, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 2)]) == [(100, 1, 1, 2, 32768, 32768)]
    large = [(100, [1e6, 3.0], 1), (1, [1e6, 3.0], 1), (2, [999_999.0, 2.0], 2)]
    assert mined(spark, large) == brute(large) != []


def test_windows_reach_few_leaves_of_clustered_vectors_and_miss_none():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 60, (40, 32))
    x = np.floor(np.repeat(centres, 50, axis=0) + rng.normal(0, 4, (2000, 32)))
    tree = negatives.Tree(x[rng.permutation(2000)[:600]], 50)
    spans: dict = {}
    for node, rows, away, nearest in tree.descend(x):
        for j in set(nearest.tolist()):
            here = nearest == j
            spans[(node, -1, j)] = ((n := (x[rows[here]] ** 2).sum(axis=1)).min(), n.max())
            for i in range(away.shape[1]):
                spans[(node, i, j)] = (away[here, i].min(), away[here, i].max())
    tree.measure([(*k, *v) for k, v in spans.items()])
    leaf = tree.leaf(x)
    assert set(leaf.tolist()) <= set(range(tree.leaves)) and tree.leaves >= 20
    queries_, scores = x[::40], x[::40] @ x.T
    hi = np.sort(scores, axis=1)[:, -2]
    lo = np.ceil(0.95 * hi)
    reached = tree.reach(queries_, np.arange(len(queries_)), lo.astype(np.int64), hi.astype(np.int64))
    for k in range(len(queries_)):
        holds = set(leaf[(scores[k] >= lo[k]) & (scores[k] <= hi[k])].tolist())
        assert holds <= set(np.flatnonzero(reached[k]).tolist())
    assert reached.mean() < 0.25


def test_large_components_score_exactly():
    a, b = np.array([[2.0**30, 3.0]]), np.array([[2.0**31, 5.0], [1.0, 1.0]])
    assert negatives._scores(a, b).tolist() == [[2**61 + 15, 2**30 + 3]]
    assert np.array_equal(negatives._unpack(negatives.pa.array(negatives._pack(a)), 2), a)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_the_query_against_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, sf, "embeddings").collect()]
    assert sorted(map(tuple, queries.op12_hard_negatives(spark, sf).collect())) == brute(rows)
