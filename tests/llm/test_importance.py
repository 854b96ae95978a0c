"""Importance resampling against plain Python and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from listwright.llm import importance
from listwright.llm.common import LOWER, UPPER, WORD

ASCII_LOWER = str.maketrans(UPPER, LOWER)


def features(text):
    words = re.findall(WORD, (text or "").translate(ASCII_LOWER))
    return words, [" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(docs, target, percent=5, least_words=20, buckets=10_000, seed=42):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets

    found = [(i, *features(t)) for i, t in docs]
    s = Counter(bucket(f) for _, _, fs in found for f in fs)
    t = Counter(bucket(f) for text in target for f in features(text)[1])
    n_s, n_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1.0) * (n_s + buckets) / ((s[b] + 1.0) * (n_t + buckets))))

    rows = []
    for i, words, fs in found:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        rows.append([i, len(words), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    eligible = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = eligible[:percent * len(eligible) // 100]
    return rows, drawn


def check(spark, docs, target, **options):
    got = importance.resample(docs, target, **options).collect()
    rows, drawn = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()],
                        [r["text"] for r in target.select("text").collect()], **options)
    key = str
    assert sorted(([r["id"], r["n_words"], r["n_features"], r["weight"], r["score"]] for r in got), key=key) == sorted(rows, key=key)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["id"], r["score"]) for r in ranked] == [(r[0], r[4]) for r in drawn]


def test_documents(spark, documents):
    check(spark, documents, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))


@pytest.mark.parametrize("percent", [0, 34, 100])
def test_odd_rows(spark, nasty, percent):
    target = spark.createDataFrame([("Five six SEVEN, wort wort",), (None,), ("",)], "text string")
    check(spark, nasty, target, percent=percent, least_words=3, buckets=97, seed=7)


def test_empty_tables(spark, nasty):
    nothing = nasty.limit(0)
    assert importance.resample(nothing, nasty).collect() == []
    check(spark, nasty, nothing, percent=50, least_words=1)


def test_ties_and_repeats(spark):
    """A third of the rows are one row; equal scores go to the smaller id."""
    docs = spark.createDataFrame([(5, "a b c")] * 40 + [(i, "x y z") for i in range(20)] + [(None, "a b c")] * 60, "doc_id long, text string")
    check(spark, docs, docs.limit(3), percent=70, least_words=1)


def test_blocks_of_words(spark, nasty, monkeypatch):
    """Runs of words cross the borders of blocks, and matrices are cut."""
    monkeypatch.setattr(importance, "BLOCK_WORDS", 7)
    monkeypatch.setattr(importance, "MATRIX_CELLS", 40)
    texts = [r["text"] or "" for r in nasty.select("text").collect() if len(r["text"] or "") < 1000]
    words = importance.Words(pa.array(texts))
    got = Counter()
    for _, found in words.buckets(10_000):
        got.update(found[found >= 0].tolist())
    assert got == Counter(zlib.crc32(f.encode()) % 10_000 for t in texts for f in features(t)[1])


def test_many_distinct_words():
    """Numbers of runs of words go beyond 32 bits."""
    text = " ".join(f"w{i % 60_000}" for i in range(150_000))
    got = Counter()
    for _, found in importance.Words(pa.array([text])).buckets(10_000):
        got.update(found[found >= 0].tolist())
    assert got == Counter(zlib.crc32(f.encode()) % 10_000 for f in features(text)[1])


def test_crc_of_rows():
    rows = np.random.default_rng(1).integers(0, 256, (50, 37), dtype=np.uint8)
    assert importance.crc_of_rows(rows).tolist() == [zlib.crc32(r.tobytes()) for r in rows]
    assert importance.crc_of_rows(rows[:, :0]).tolist() == [0] * 50


def test_target_like_documents_are_drawn(spark):
    """The draw prefers documents made of the target's words."""
    import random

    random.seed(3)
    def text(words):
        return " ".join(random.choice(words) for _ in range(40))

    ours, theirs = [f"w{i}" for i in range(300)], [f"v{i}" for i in range(300)]
    docs = spark.createDataFrame([(i, text(theirs if i % 10 == 0 else ours)) for i in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([(text(theirs),) for _ in range(50)], "text string")
    drawn = importance.resample(docs, target).filter(F.col("rank").isNotNull()).collect()
    assert len(drawn) == 20 and all(r["id"] % 10 == 0 for r in drawn)
