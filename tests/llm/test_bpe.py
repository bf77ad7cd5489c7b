"""Encoding against the public tokenizer itself, and as an exact round trip."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinspan.llm import bpe

PATH = os.path.join(bpe.TOKENIZER_DIR, bpe.BYTE_BPE_50K)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return bpe.parse_ranks(f.read())


@pytest.fixture(scope="module")
def public(ranks):
    import tiktoken

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=80) | st.text("ab \n\t'sréé漢🙂\u0085\x1c½²=<|endoftext|>", max_size=60))
def test_equals_public_tokenizer(ranks, public, text):
    text = text.encode("utf-8", "replace").decode()
    assert bpe.Encoder(ranks).encode_batch([text])[0].tolist() == public.encode_ordinary(text)


def test_very_long_pre_tokens(ranks, public):
    rng = random.Random(6)
    texts = ["a" * 30_000, "ab" * 9_000, "".join(rng.choice("abcdefgh") for _ in range(40_000)), "=" * 5000, " " * 7000 + "x"]
    got = bpe.Encoder(ranks).encode_batch(texts)
    assert [g.tolist() for g in got] == [public.encode_ordinary(t) for t in texts]


def test_long_texts_in_segments(ranks, public):
    rng = random.Random(9)
    text = "".join(rng.choice(["word", " two", "  ", "\n\n", " 12", "é", "-", " x\t"]) for _ in range(4000))
    assert "".join(bpe.segments(text, 100)) == text and len(list(bpe.segments(text, 100))) > 50
    encoder = bpe.Encoder(ranks)
    assert [i for s in bpe.segments(text, 100) for i in encoder.encode_batch([s])[0].tolist()] == public.encode_ordinary(text)
    assert list(bpe.segments("a" * 500, 100)) == ["a" * 500] and encoder.count(text) == len(public.encode_ordinary(text)) and encoder.encode("").tolist() == []
    assert [len(c) for c in bpe.text_chunks(["a" * 5, "b" * 50, "c", "d"], 20)] == [1, 1, 2]


def test_a_lower_rank_made_by_a_merge_comes_first():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"abc": 256, b"bc": 400, b"xab": 257}
    assert bpe.rank_queue_merge([b"abcxabab", b"bc"], ranks, bpe.byte_pair_table(ranks)) == [(256, 257, 300), (400,)]


def test_corpus_cases(spark, ranks):
    inverse = {v: k for k, v in ranks.items()}
    rows = [(1, None, 9), (2, "", 9), (None, "x", 9), (3, "def f(x):\n    return x\n", 9), (3, "twice", 9), (4, " \n", 9), (5, "<|endoftext|>", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = [(r["doc_id"], r["ids"]) for r in bpe.encode_corpus(df).collect()]
    assert [g[0] for g in got] == [r[0] for r in rows] and got[0][1] == got[1][1] == []
    assert [b"".join(inverse[i] for i in ids).decode() for _, ids in got] == [r[1] or "" for r in rows]
    assert bpe.encode_corpus(df.limit(0)).count() == 0
