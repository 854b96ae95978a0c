"""Byte-level BPE against the tiktoken library, and round trips."""

import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken

from listwright.llm import byte_bpe
from listwright.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def coders(request):
    import public_tokenizers

    path = public_tokenizers.path(request.param)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return byte_bpe.ByteBpe(path, public_tokenizers.PATTERN), library


def listed(data):
    return np.frombuffer(data, "<u4").tolist()


def test_odd_texts(coders):
    own, library = coders
    texts = [
        "", " ", "  ", "\n", " \n\n a", "a  b", "a   ", "it's we'LL they'd 'S x's", "Straße ÀÖ×÷ŉſ ẞ", "١٢٣ ½ ² 12a34",
        "你好，世界。これは長い文です", "🤷🏽‍♀️ ​﻿  x", "\x00\x1c\x1d\x1f \x85\xa0 a\x85b", "é́ 한국어 ไทย",
        "<|endoftext|>", "a\tb\r\nc\x0b\x0cd", "𝔘𝔫𝔦 ퟿\U0010ffff", "x" * 70, " " * 300, "-" * 129, "ab" * 4000, "ß" * 65,
    ]
    for text, data in zip(texts, own.encode(texts)):
        assert listed(data) == library.encode_ordinary(text), text[:40]
        assert own.decode([data]) == [text.encode()]


def test_random_words(coders):
    """Words on both sides of LONG_WORD, of few letters, so that pairs overlap and ranks go up and down."""
    own, library = coders
    rng = random.Random(5)
    words = [
        "".join(rng.choice(letters) for _ in range(n))
        for letters in ("ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz", "éàüñß", "的一是不")
        for n in (1, 2, 3, 7, 20, 60, 64, 65, 90, 300) for _ in range(8)
    ]
    for word, data in zip(words, own.encode(words)):
        assert listed(data) == library.encode_ordinary(word), word


def test_all_at_once_is_one_by_one(coders, monkeypatch):
    """Both queries give the same ids, also when a long piece stops after each round."""
    own, library = coders
    monkeypatch.setattr(byte_bpe, "STATE_ROWS", 1)
    rng = random.Random(6)
    for n in (2, 5, 30, 64):
        data = bytes(rng.choice(b"etaoinshrdlu ") for _ in range(n))
        own._short([("w", data)])
        assert own._long(data) == own._known.pop("w")


def test_long_texts(coders):
    own, library = coders
    for text in ("x" * 100_000, "word and more " * 20_000, "A1" * 5_000):
        data, = own.encode([text])
        assert listed(data) == library.encode_ordinary(text)
        assert own.decode([data]) == [text.encode()]


def test_decode_in_runs(coders, monkeypatch):
    own, library = coders
    monkeypatch.setattr(byte_bpe, "DECODE_TOKENS", 3)
    texts = ["", "one two three four five", "", "é", "a b", "six seven eight nine ten eleven"]
    assert own.decode(own.encode(texts)) == [t.encode() for t in texts]
    assert own.decode([]) == []
    assert own.decode([np.array([60_000, 100], "<u4").tobytes()]) == own.decode([np.array([100], "<u4").tobytes()])


def test_cache_starts_over(coders, monkeypatch):
    own, library = coders
    monkeypatch.setattr(byte_bpe, "CACHE_WORDS", 1)
    for text in ("some qwertyuiop words", "other asdfghjkl words", "some qwertyuiop words"):
        assert listed(own.encode([text])[0]) == library.encode_ordinary(text)


def expected(texts, library):
    return sorted(
        ((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
         for i, t in texts for ids in [library.encode_ordinary(t or "")]), key=str)


def test_query(spark, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.default_ranks()[0], "rb"))}
    library = tiktoken.Encoding("own", pat_str=byte_bpe.default_ranks()[1], mergeable_ranks=ranks, special_tokens={})
    got = QUERIES["op12_byte_bpe"](spark, SF_DIR).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(texts.items(), library)


def test_odd_rows(spark, nasty, monkeypatch):
    tokens = byte_bpe.encode(nasty)
    rows = [(r["doc_id"], r["text"] or "") for r in nasty.select("doc_id", "text").collect()]
    assert sorted(((r["id"], r["n_tokens"]) for r in tokens.collect()), key=str)[0][1] >= 0
    back = [(r["id"], bytes(r["data"]).decode()) for r in byte_bpe.decode(tokens).collect()]
    assert sorted(back, key=str) == sorted(rows, key=str)
    at_once = [(r["id"], bytes(r["data"]).decode()) for r in byte_bpe.encode(nasty, decoded=True).collect()]
    assert sorted(at_once, key=str) == sorted(rows, key=str)
    assert byte_bpe.decode(byte_bpe.encode(nasty.limit(0))).collect() == []
    nulls = spark.createDataFrame([(1, None)], "id long, ids binary")
    assert [tuple(r) for r in byte_bpe.decode(nulls).collect()] == [(1, bytearray())]
