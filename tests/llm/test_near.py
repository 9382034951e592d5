"""Candidates of the near-copy join: the rarest parts lose no link, and templated texts have few."""

from collections import Counter

import numpy as np
import pytest

from hostloom.llm import near


def kept(sets, percent, order):
    """Of each set's groups the keys that stay when all sets drop their last ones in one order."""
    out = []
    for found in sets:
        keys = set()
        for _, group, keep in near.part_groups(found, percent):
            keys |= set(sorted(group.tolist(), key=order)[:keep])
        out.append(keys)
    return out


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_one_of_their_rarest_parts(percent):
    rng = np.random.default_rng(percent)
    for n in (1, 2, 3, 5, 8, 9, 15, 16, 31, 32, 33, 60, 64, 100, 127, 128, 255, 700):
        base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        sets = [base]
        for _ in range(30):
            drop, add = rng.integers(0, max(2, len(base) * (100 - percent) // 100 + 2), 2)
            some = rng.permutation(base)[: max(0, len(base) - int(drop))]
            sets.append(np.unique(np.concatenate([some, rng.integers(0, 2**63, int(add)).astype(np.uint64)])))
        sets = [s for s in sets if len(s)]
        often = Counter(k for s in sets for k in set(near.parts(s, percent).tolist()))
        for order in (lambda k: (often[k], k), lambda k: (-often[k], k), lambda k: k):
            rare = kept(sets, percent, order)
            pairs = linked = 0
            for i in range(len(sets)):
                for j in range(i):
                    if near.linked(sets[i], sets[j], percent):
                        linked += 1
                        pairs += bool(rare[i] & rare[j])
            assert pairs == linked > 0 or n < 3


def test_short_templated_texts_that_do_not_link_have_few_candidates(spark, monkeypatch):
    # 20,000 texts of one template, a fifth of whose words are their own
    n = 20_000
    text = lambda i: " ".join(f"t{k}" if k % 5 else f"own{i}x{k}" for k in range(40))
    seen = []
    real = near.shared_parts

    def counted(*args):
        out = real(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(near, "shared_parts", counted)
    df = spark.range(n, numPartitions=8).rdd.map(lambda r: (r[0], text(r[0]))).toDF("doc_id long, text string")
    got = near.near_duplicates(df, bits=22)
    assert got.where("component_id <> doc_id").count() == 0
    assert seen[0] <= 2 * n


def test_copies_among_templated_texts_are_found(spark):
    rng = np.random.default_rng(4)
    texts = {}
    for i in range(400):
        words = [f"t{k}" if k % 3 else f"own{i}x{k}" for k in range(120)]
        texts[2 * i] = words
        if i % 4 == 0:
            texts[2 * i + 1] = [w if k != 60 else "changed" for k, w in enumerate(words)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in sorted(texts.items(), key=lambda _: rng.random())], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near.near_duplicates(df, bits=20).collect()}
    assert got == {i: i - i % 2 for i in texts}
