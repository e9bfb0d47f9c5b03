"""The merge transducer against the library that the vocabulary was made for, and exact round trips."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from matrica.llm.encoding import PATTERN, TOKENIZERS, decode_ids, encode_texts, load_codec

tiktoken = pytest.importorskip("tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")), reason="no vocabulary files")


@pytest.fixture(scope="module")
def peer():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_codec().transducer.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    ids = load_codec().encode(text)
    peer = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_codec().transducer.ranks, special_tokens={})
    assert ids == peer.encode_ordinary(text) and load_codec().decode(ids) == text


def test_words_and_long_runs(peer):
    rng, codec = random.Random(1), load_codec()
    for k in range(400):
        text = "".join(rng.choice(["ing", "the", " ", "er", "a", "Ġ", "é", "中", "\n", "1", "'s", "  ", "🔧"]) for _ in range(rng.randint(0, 80)))
        assert codec.encode(text) == peer.encode_ordinary(text)
    for text in ("ab" * 200_000, " " * 100_000, "<|endoftext|>"):
        assert codec.encode(text) == peer.encode_ordinary(text)


def test_emission_is_bounded(peer):
    machine = load_codec().transducer
    assert max(len(pending) for _, pending, _ in machine.states) <= 2 * machine.longest


def test_streamed_decoding_gives_whole_characters():
    pieces = list(load_codec().decode_stream(load_codec().encode("naïve 中文 🔧")))
    assert "".join(pieces) == "naïve 中文 🔧" and "�" not in pieces
    assert load_codec().decode([load_codec().transducer.ranks[b"\xe4"]]) == "�"


def test_tables(spark, peer):
    texts = ["a b", "", None, "a b", "中文 ﬁ﻿", "x" * 300_000]
    df = spark.createDataFrame([(i, t, [0]) for i, t in enumerate(texts)], "doc_id bigint, text string, ids array<int>")
    encoded = encode_texts(df, "doc_id", "text")
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == {i: peer.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["text"] for r in decode_ids(encoded, "doc_id", "ids").collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0
