"""Queries over the smallest test tables: against SQL, held-out accuracy, and the pipeline stage by stage."""

from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from hostloom.llm import near, queries, substrings
from hostloom.llm.common import settle, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_one_row_each(spark, name):
    source, key = {"op2_url_filter": ("pages", "page_id"), "op11_conversation_repair": ("conversations", "conv_id")}.get(name, ("documents", "doc_id"))
    got = Counter(r[0] for r in queries.QUERIES[name](spark, SF).select(key).collect())
    want = Counter(r[0] for r in table(spark, SF, source).select(key).collect())
    assert got == (Counter(set(want)) if key == "conv_id" else want)


def test_language_is_right_on_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in table(spark, SF, "documents").select("doc_id", "lang").collect()}
    held = [r for r in queries.op9_language(spark, SF).collect() if r.held_out and r.lang_pred != "und"]
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_quality_keeps_the_good_and_drops_most_of_the_bad(spark):
    label = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    got = [(r.kept, label[r.doc_id]) for r in queries.op7_quality(spark, SF).collect() if r.doc_id in label]
    assert sum(k for k, q in got if q == 1) >= 0.9 * sum(q == 1 for _, q in got)
    assert sum(not k for k, q in got if q == 0) >= 0.8 * sum(q == 0 for _, q in got)


def test_pipeline(spark):
    docs = first = table(spark, SF, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, settle(stage(spark, docs, SF))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.subtract(before).count() == 0, name
        if name.startswith("n-gram"):
            assert near.near_duplicates(docs).where("component_id <> doc_id").count() == 0
        if name.startswith("benchmark"):
            assert queries.decontaminate.contamination(docs, table(spark, SF, "benchmark")).where("contaminated").count() == 0
    assert docs.select("doc_id").subtract(first.select("doc_id")).count() == 0
    assert docs.count() == before.count()
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_a_stage_of_repeats_finds_a_planted_passage(spark):
    passage = " ".join(f"planted{i}" for i in range(55))
    df = spark.createDataFrame([(i, f"before{i} {passage} after{i}") for i in range(3)] + [(9, " ".join(f"clean{i}" for i in range(90)))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.strip_repeats(df).collect()} == {0: 55, 1: 55, 2: 55, 9: 0}


def test_the_stage_of_near_copies_against_brute_force(spark):
    rng, plain = np.random.default_rng(5), {}
    for group in range(12):
        first = [f"g{group}w{k}" for k in range(int(rng.integers(3, 300)))] if group else [f"v{k}" for k in range(200)]
        plain[10 * group] = first
        for copy in range(1, 6):
            out = list(first)
            for k in (25, 75, 125, 175) if not group and copy == 1 else rng.choice(len(first), int(len(first) * copy * 0.008), replace=False):
                out[k] = f"changed{group}x{copy}x{k}"
            plain[10 * group + copy] = out + ["more"] * int(rng.integers(0, 3)) * (group > 0)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} for i, w in plain.items()}
    least = {i: i for i in plain}
    for _ in plain:
        least = {i: min(least[j] for j in plain if len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j])) for i in plain}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in plain.items()], "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert least[1] == 0 and 1 not in kept
    assert kept == sorted(set(least.values())) and len(kept) > 12


def test_parts_lose_no_link_at_the_stage_s_similarity():
    rng = np.random.default_rng(2)
    for n in (1, 2, 4, 5, 7, 8, 15, 16, 31, 32, 33, 63, 64, 100, 127, 128, 500, 2000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop, add = rng.integers(0, n // 4 + 2, 2)
            b = np.unique(np.concatenate([a[: max(0, n - drop)], rng.integers(0, 2**63, add).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= corpus_pipeline.PERCENT * (len(a) + len(b) - both):
                assert len(np.intersect1d(near.parts(a, 80), near.parts(b, 80))), (n, drop, add)


def test_the_pipeline_takes_an_empty_table_and_clashing_columns(spark, tmp_path):
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = table(spark, SF, "documents")
    clash = docs.selectExpr("*", "'r' AS row", "1 AS key", "'s' AS shard", "2 AS component", "array(1) AS hits")
    for rows, n in ((docs.limit(0), 0), (clash, None)):
        rows.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path))
        assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
        assert out.count() == n if n is not None else out.count() > 20


def test_labels_that_disagree_give_one_verdict_a_row(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    both = labels.unionByName(labels.selectExpr("doc_id", "1 - quality AS quality", "toxic")).unionByName(labels)
    got = queries.quality.judge(docs, both.select(labels.columns))
    assert Counter(r.doc_id for r in got.select("doc_id").collect()) == Counter(r.doc_id for r in docs.select("doc_id").collect())
