"""Byte-level BPE against the tokenizer library, the perfect hash, and the stated edge cases."""

import hashlib
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from hostloom.llm import bpe, queries
from hostloom.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokens():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(tokens):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})


def test_the_perfect_hash_is_minimal_and_tells_strangers_apart(tokens):
    v = bpe.Vocabulary(tokens)
    assert sorted(v.hash.at.tolist()) == list(range(len(tokens)))
    assert v.whole(tokens) == list(range(len(tokens)))
    strangers = [t + b"\x00zq" for t in tokens[:5000]]
    assert set(v.whole(strangers)) == {-1}
    for n in (0, 1, 2, 7, 1000):
        words = [f"w{i}".encode() for i in range(n)]
        h = bpe.PerfectHash(words)
        assert h.candidates(words).tolist() == list(range(n))
    assert bpe.PerfectHash([]).candidates([b"x"]).tolist() == [-1]
    with pytest.raises(ValueError):
        bpe.PerfectHash([b"a", b"a"])


def test_against_the_library(spark, tokens, library):
    want = {}
    for r in table(spark, SF, "documents").select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_byte_bpe(spark, SF).collect()} == want


def test_edges(spark, tokens, library, monkeypatch):
    rng = np.random.default_rng(3)
    odd = ["", None, " ", "\n\n  x", "a" * 50_000, "ab" * 9_999, "é中\U0001f600" * 500, " " * 40_000 + "y", "<|endoftext|>", "don't WE'LL 12 345", "\x00\x01￾", "é‍ z"]
    odd += ["".join(chr(int(c)) for c in rng.integers(1, 0x2FFF, 300)) for _ in range(20)]
    monkeypatch.setattr(bpe, "MEMO_TOKENS", 40)
    texts = [(k, t, "clash", 1, "x") for k, t in enumerate(odd + odd)] + [(None, "no id", None, None, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string, ids string, n_tokens int, decoded string")
    out = bpe.decode(bpe.encode(df, tokens, public_tokenizers.PATTERN), tokens).collect()
    assert len(out) == len(texts)
    text = {k: t for k, t, *_ in texts}
    for r in out:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text[r.doc_id] or "")
        assert bytes(r.decoded) == (text[r.doc_id] or "").encode() and r.n_tokens == len(r.ids) // 4
    assert bpe.encode(df.limit(0), tokens, public_tokenizers.PATTERN).count() == 0


def test_bad_rank_files_are_refused(tmp_path):
    (tmp_path / "gap").write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(tmp_path / "gap"))
    with pytest.raises(ValueError):
        bpe.Vocabulary([b"a", b"b"])
