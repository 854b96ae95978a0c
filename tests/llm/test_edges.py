"""Each operator on odd rows and on an empty table."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from listwright.llm import decontamination, exact_dedup, language, line_dedup, near_dedup, packing, pii, sharding, url_filter, warc
from listwright.llm.common import new_path

N = 15


@pytest.fixture(params=["nasty", "empty"])
def docs(request, nasty):
    return nasty if request.param == "nasty" else nasty.limit(0)


def rows_of(docs):
    return docs.count()


def test_packing(spark, docs):
    rows = packing.pack(docs, size=64, keep_ids=True).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert len(r["ids"]) == r["length"]
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    if rows_of(docs):
        assert sum(r["start"] == 0 for r in rows) == N
        assert [r["ids"] for r in rows if r["id"] == 4] == [[0]]
    else:
        assert rows == []


def test_url_filter(spark, docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), "*").withColumn(
        "url", F.when(F.col("doc_id") == 1, "http://a.b.COM").when(F.col("doc_id") == 2, "https://WWW.Example.com/en/x?y#z")
        .when(F.col("doc_id") == 7, "http://x.net/es/1").otherwise(F.col("text"))
    )
    rows = url_filter.filter_urls(pages).collect()
    assert len(rows) == rows_of(docs)
    if rows:
        got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows if r["id"] in (1, 2, 3, 7)}
        assert got[1][:3] == ("a.b.com", "", None)
        assert got[2] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
        assert got[7] == ("x.net", "/es/1", "net/es/", "block")
        assert got[3][:3] == ("", "", None)


def test_language(spark, docs):
    model = language.learn(docs)
    answer = language.predicted(spark, model, F.col("text"))
    got = docs.select("doc_id", answer.alias("a")).collect()
    assert len(got) == rows_of(docs)
    for r in got:
        assert 0 <= r["a"]["score"] <= 1
        if r["doc_id"] in (3, 4, 9):
            assert r["a"]["lang"] == "und"


def test_language_without_model(spark, nasty):
    model = language.learn(nasty.limit(0))
    got = nasty.select(language.predicted(spark, model, F.col("text")).alias("a")).collect()
    assert {(r["a"]["lang"], r["a"]["score"]) for r in got} == {("und", 0.0)}


def test_decontamination(spark, docs):
    items = spark.createDataFrame(
        [("i1", "five six seven mail"), ("i2", None), (None, "one two"), ("i3", ""), ("i4", "two three"), ("i1", "zzz")],
        "item_id string, text string",
    )
    found = decontamination.find_contamination(docs, items).collect()
    assert len(found) == rows_of(docs)
    by = {r["doc_id"]: r["contamination"] for r in found}
    if by:
        assert by[1]["items"] == ["i1", "i4"]
        assert [(s["start"], s["end"]) for s in by[1]["spans"]] == [(1, 3), (4, 8)]
        assert by[3]["n_words"] == 0 and by[3]["spans"] == []
    kept = decontamination.decontaminate(docs, items)
    assert kept.columns == docs.columns
    if by:
        text = {r["doc_id"]: r["text"] for r in kept.collect()}
        assert text[1].startswith("One  four  bob@")
        assert text[3] is None and text[4] == ""
    assert decontamination.decontaminate(docs, items.limit(0)).count() == rows_of(docs)


def test_sharding(spark, docs):
    rows = sharding.hilbert_shards(docs, shards=4).collect()
    assert len(rows) == rows_of(docs)
    counts = [sum(r["shard"] == k for r in rows) for k in range(4)]
    assert max(counts) - min(counts) <= 1
    for k in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(counts[k]))


def test_line_dedup(spark, docs):
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns
    text = {}
    for r in kept.collect():
        text.setdefault(r["doc_id"], []).append(r["text"])
    if rows_of(docs):
        assert len(text[1]) == 1 and "many documents" in text[1][0]
        assert 2 not in text  # all its lines are in 1
        assert text[7] == ["short\n"]
        assert text[3] == [None] and text[4] == [""] and text[9] == ["\n\n \t\r\n"]
    else:
        assert text == {}


def test_pii(spark, docs):
    found = pii.find_pii(docs)
    assert set(found.columns) == set(docs.columns)
    rows = found.withColumn("clean", pii.redacted(F.coalesce("text", F.lit("")), F.col("pii"))).collect()
    assert len(rows) == rows_of(docs)
    by = {r["doc_id"]: r for r in rows}
    if by:
        assert [(s["start"], s["rank"], s["end"]) for s in by[1]["pii"]] == [(40, 0, 53), (57, 3, 75)]
        assert "mail [email] or [phone]." in by[1]["clean"]
        assert by[3]["pii"] == [] and by[4]["pii"] == []


def test_warc(spark, docs):
    path = new_path(spark, "warc-test")
    pages = docs.withColumn("url", F.lit("http://x.test/a b\r\nc"))
    manifest = warc.write_warc(pages, path, "doc_id", "url", "text", roll_bytes=300).collect()
    back = warc.read_warc(spark, path).collect()
    assert len(back) == rows_of(docs) == sum(m["records"] for m in manifest)
    want = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    first = {}
    for i, t in want.items():
        if i is not None:
            first[t] = min(first.get(t, i), i)
    for r in back:
        if r["id"] is not None:
            text = want[r["id"]]
            assert r["payload_bytes"] == len(text.encode())
            if first[text] == r["id"]:
                assert (r["record_type"], r["payload"], r["refers_to"]) == ("response", text, None)
            else:
                assert (r["record_type"], r["payload"], r["refers_to"]) == ("revisit", None, first[text])
    again = new_path(spark, "warc-test")
    second = warc.write_warc(pages.repartition(3), again, "doc_id", "url", "text", roll_bytes=300).collect()
    assert sorted(second) == sorted(manifest)  # the same files, byte for byte


def test_near_duplicates(spark, docs):
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == rows_of(docs)
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append(r)
    if rows:
        assert {r["class_id"] for i in (1, 2, 10) for r in by[i]} == {1}
        assert by[1][0]["n_copies"] == 5 and by[1][0]["n_links"] == 0
        assert by[3][0]["class_id"] == 3 and by[4][0]["class_id"] == 4
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    if rows:
        ids = [r["doc_id"] for r in kept.collect()]
        assert 1 in ids and 2 not in ids and 10 not in ids and 3 in ids and 4 in ids


def test_exact_dedup(spark, docs):
    index = exact_dedup.DigestIndex(spark, new_path(spark, "index-test"), 4)
    rows = exact_dedup.exact_dedup(docs, index).collect()
    assert len(rows) == rows_of(docs)
    if rows:
        by = {r["id"]: r for r in rows if r["id"] is not None}
        assert by[1]["keep_id"] == 10 and by[1]["group_size"] == 5 and not by[1]["kept"] and by[10]["kept"]
        assert by[3]["keep_id"] == 4 and by[4]["kept"]
        assert bytes(by[4]["digest"]) == hashlib.sha256(b"").digest()
        assert by[12]["keep_id"] == 12
    before = index.rows().count()
    again = exact_dedup.exact_dedup(docs.withColumn("doc_id", F.col("doc_id") + 100), index)
    assert again.filter("kept").count() == 0
    assert index.rows().count() == before


def test_exact_dedup_of_batches_with_null_ids(spark):
    """Three batches against plain Python: texts of rows with and without ids, in one batch or in several."""
    import random

    rng = random.Random(2)
    batches = [[(None if rng.random() < 0.4 else 100 * b + i, rng.choice("abcdefghijkl") + ("X" if rng.random() < 0.3 else "x"))
                for i in range(14)] for b in range(3)]
    batches[0] += [(None, "only null"), (None, "Only null")]
    batches[1] += [(None, "only null"), (7, "ONLY NULL"), (None, None), (None, "")]
    batches[2] += [(8, ""), (None, "only null")]
    index = exact_dedup.DigestIndex(spark, new_path(spark, "index-batches"), 4)
    held = {}
    for batch in batches:
        got = exact_dedup.exact_dedup(spark.createDataFrame(batch, "doc_id long, text string"), index).collect()
        by_text = {}
        for i, text in batch:
            by_text.setdefault((text or "").lower(), []).append(i)
        assert len(got) == len(batch)
        by_digest = {hashlib.sha256(t.encode()).digest(): t for t in by_text}
        kept = {}
        for r in got:
            text = by_digest[bytes(r["digest"])]
            ids = [i for i in by_text[text] if i is not None]
            keep = held[text] if text in held else max(ids, default=None)
            assert (r["keep_id"], r["group_size"]) == (keep, len(by_text[text])), text
            kept.setdefault(text, []).append((r["id"], r["kept"]))
        for text, rows in kept.items():
            if text in held:
                assert all(k == (i is not None and i == held[text]) for i, k in rows)
            elif any(i is not None for i, _ in rows):
                assert all(k == (i is not None and i == max(j for j, _ in rows if j is not None)) for i, k in rows)
            else:
                assert sum(k for _, k in rows) == 1
        for text, ids in by_text.items():
            held.setdefault(text, max((i for i in ids if i is not None), default=None))
    assert index.rows().count() == len(held)


def test_pipeline_stages(spark, docs):
    frame = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, "/root/testdata/sf0.001")
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert frame.filter("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, "/root/testdata/sf0.001")
    assert packed.select("doc_id").distinct().count() == frame.select("doc_id").distinct().count()


@pytest.mark.parametrize("ids", [[*range(300), 10**15], [-9 * 10**18, *range(50), 9 * 10**18], [7] * 40 + [8], [None, 3, None]])
def test_warc_shards_of_sparse_ids(spark, ids, monkeypatch):
    """Far ids, the ends of the range of longs, one id in most rows: all come back, in shards of about equal size."""
    import random

    rng = random.Random(1)
    rows = [(i, f"http://a.test/{k}", "".join(rng.choice("abcdefgh") for _ in range(2000))) for k, i in enumerate(ids)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = new_path(spark, "sparse")
    manifest = warc.write_warc(pages, path, shard_bytes=20_000).collect()
    got = warc.read_warc(spark, path).collect()
    assert sorted(((r["id"], r["payload"]) for r in got), key=str) == sorted(((i, t) for i, _, t in rows), key=str)
    if len(set(ids)) > 100:
        assert max(r["records"] for r in manifest) <= 25
    assert warc.read_warc(spark, path).rdd.getNumPartitions() == min(len(manifest), spark.sparkContext.defaultParallelism)


def test_warc_file_of_a_lost_attempt_is_replaced(tmp_path, monkeypatch):
    import pyarrow.fs as pa_fs

    monkeypatch.setattr(warc, "TaskContext", type("Context", (), {"get": staticmethod(lambda: type("T", (), {"taskAttemptId": lambda self: 5})())}))
    for text in (b"older", b"newer"):
        file = warc._File(pa_fs.LocalFileSystem(), str(tmp_path), 0, 0)
        file.add(1, warc.record(1, "http://a.test/", text, None))
        file.commit()
    assert [p.name for p in tmp_path.iterdir()] == ["shard-0000000-00000.warc.gz"]
