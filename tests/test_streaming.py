"""Streams give what the batch plans give, also when a batch is run twice."""

import datetime
import json

from pyspark.sql import functions as F

from listwright.plans import ingest
from listwright.schemas import LANDING, LISTING
from listwright.sources.registry import normalize
from listwright.streaming import activity
from listwright.plans.alerts import with_notified_at
from listwright.streaming.alerts import alert_batch, outbox
from listwright.streaming.ingest import Paths, StreamConfig, drop_repeats, ingest_batch, start_ingest, stored

AT = datetime.datetime(2024, 1, 31, 12, 0)
SOURCES = ["remotive", "arbeitnow"]
CONFIG = StreamConfig(sources=SOURCES)


def remotive(*ids):
    jobs = [{"id": i, "url": f"https://j.test/{i}", "title": f"Python Developer {i}"} for i in ids]
    return json.dumps({"jobs": jobs})


def arbeitnow(*ids):
    jobs = [{"slug": f"a{i}", "url": f"https://J.test/{i} ", "title": f"Web Developer {i}", "remote": True} for i in ids]
    return json.dumps({"data": jobs})


def land(spark, path, rows):
    df = spark.createDataFrame(
        [(cycle, s, "0", "http://f/", status, "application/json", AT, body) for cycle, s, status, body in rows], LANDING
    )
    df.coalesce(1).write.mode("append").parquet(path)
    return df


def paths_in(tmp_path):
    return Paths(*[str(tmp_path / n) for n in ("landing", "listings", "runs", "checkpoint")])


def test_stream_equals_batch(spark, tmp_path):
    paths = paths_in(tmp_path)
    first = land(spark, paths.landing, [(1, "remotive", 200, remotive(1, 2, 2)), (1, "arbeitnow", 200, arbeitnow(2, 3))])
    start_ingest(spark, paths, CONFIG, once=True).awaitTermination()
    second = land(spark, paths.landing, [(2, "remotive", 200, remotive(3, 4)), (2, "arbeitnow", 403, "blocked"),
                                         (2, "wwr", 200, "<rss/>")])
    start_ingest(spark, paths, CONFIG, once=True).awaitTermination()

    rows = {r.url: r for r in stored(spark, paths.listings).collect()}
    assert set(rows) == {"https://j.test/1", "https://j.test/2", "https://J.test/3", "https://j.test/4"}
    assert sorted(r.id for r in rows.values()) == [1, 2, 3, 4]
    assert rows["https://j.test/4"].id == 4 and rows["https://J.test/3"].source == "arbeitnow"
    assert rows["https://j.test/1"].fetched_at == AT

    ok = first.unionByName(second.filter("source = 'remotive'"))
    batch = ingest.new_listings(normalize(ok, SOURCES), None, ingest.IngestConfig(), F.lit(AT))
    assert {(r.url, r.source) for r in batch.collect()} == {(u, r.source) for u, r in rows.items()}

    runs = {(r.cycle_id, r.source): r for r in spark.read.parquet(paths.runs).collect()}
    assert (runs[1, "remotive"].fetched, runs[1, "remotive"].inserted) == (3, 2)
    assert (runs[1, "arbeitnow"].fetched, runs[1, "arbeitnow"].inserted) == (2, 1)
    assert (runs[2, "arbeitnow"].fetched, runs[2, "arbeitnow"].error_class) == (0, "blocked")
    assert runs[2, "(all)"].inserted == 1


def test_batch_can_be_run_again(spark, tmp_path):
    paths = paths_in(tmp_path)
    landing = land(spark, paths.landing, [(1, "remotive", 200, remotive(1, 2))])
    for _ in range(2):
        ingest_batch(landing, 0, paths, CONFIG)
    assert sorted(r.id for r in stored(spark, paths.listings).collect()) == [1, 2]
    ingest_batch(landing, 1, paths, CONFIG)
    assert stored(spark, paths.listings).count() == 2


def test_good_responses_of_a_failing_source_count(spark, tmp_path):
    paths = paths_in(tmp_path)
    landing = land(spark, paths.landing, [(1, "remotive", 200, remotive(1, 2)), (1, "remotive", 500, "oops")])
    ingest_batch(landing, 0, paths, CONFIG)
    assert {r.url for r in stored(spark, paths.listings).collect()} == {"https://j.test/1", "https://j.test/2"}
    runs = {r.source: r for r in spark.read.parquet(paths.runs).collect()}
    assert (runs["remotive"].fetched, runs["remotive"].inserted, runs["remotive"].error) == (2, 2, "HTTP 500")


def test_disabled_source_is_not_read(spark, tmp_path):
    paths = paths_in(tmp_path)
    landing = land(spark, paths.landing, [(1, "remotive", 200, remotive(1)), (1, "arbeitnow", 200, arbeitnow(5))])
    ingest_batch(landing, 0, paths, StreamConfig(sources=SOURCES, enabled={"arbeitnow": False}))
    assert [r.source for r in stored(spark, paths.listings).collect()] == ["remotive"]


def test_warnings_are_replaced(spark, tmp_path):
    names = ("landing", "listings", "runs", "checkpoint", "warnings")
    paths = Paths(*[str(tmp_path / n) for n in names])
    feed = "<rss><channel><item><title>Python Dev</title><link>http://u.test/1</link></item></channel></rss>"
    config = StreamConfig(sources=["upwork_rss"])
    ingest_batch(land(spark, paths.landing, [(1, "upwork_rss", 403, "")]), 0, paths, config)
    (warning,) = spark.read.parquet(paths.warnings).collect()
    assert warning.warning.startswith("HTTP 403 — login wall")
    ingest_batch(land(spark, paths.landing, [(2, "upwork_rss", 200, feed)]), 1, paths, config)
    assert spark.read.parquet(paths.warnings).count() == 0
    assert stored(spark, paths.listings).count() == 1


def _listings(spark, path, n):
    rows = spark.range(n).select(
        *[
            {
                "id": F.col("id"), "source": F.when(F.col("id") % 3 == 0, "hn").otherwise("wwr"),
                "title": F.lit("T"), "url": F.lit("u"), "status": F.lit("new"),
                "ai_score": (F.col("id") % 11).cast("int"), "dedupe_hash": (F.col("id") % 7).cast("string"),
                "fetched_at": F.lit(AT) - F.make_dt_interval(days=(F.col("id") % 5).cast("int")),
                "applied_at": F.lit(AT) - F.make_dt_interval(days=(F.col("id") % 20).cast("int")),
            }.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in LISTING
        ]
    )
    rows.write.parquet(path)
    return rows


def _run(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_running_counts(spark, tmp_path):
    rows = _listings(spark, str(tmp_path / "l"), 200)
    stream = spark.readStream.schema(LISTING).parquet(str(tmp_path / "l"))
    got = _run(activity.listings_per_day(stream), "per_day", "complete")
    want = rows.groupBy(F.to_date("fetched_at").alias("day"), "source").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

    got = _run(activity.applications_per_week(stream), "per_week", "complete")
    want = rows.groupBy(F.to_date(F.date_trunc("week", "applied_at")).alias("week")).agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_bounded_dedupe(spark, tmp_path):
    _listings(spark, str(tmp_path / "l"), 50)
    stream = spark.readStream.schema(LISTING).parquet(str(tmp_path / "l"))
    got = _run(drop_repeats(stream, "30 days"), "repeats", "append")
    assert got.count() == 7


def test_alerts_at_most_once(spark, tmp_path):
    rows = _listings(spark, str(tmp_path / "l"), 110)
    path = str(tmp_path / "outbox")
    for batch in (0, 0, 1):
        alert_batch(rows, batch, path, F.lit(f"2024-02-0{batch + 1} 00:00:00"), limit=20)
    sent = outbox(spark, path).collect()
    # 30 listings score 8 or more: 20 in the first batch, the other 10 in the second.
    assert len(sent) == 30 and len({r.id for r in sent}) == 30
    assert {r.batch_id for r in sent} == {0, 1}
    # The outbox says when each listing was told about.
    noted = {r.id: r.notified_at for r in with_notified_at(rows, outbox(spark, path)).collect()}
    assert all(noted[r.id] == r.sent_at and r.sent_at.day == r.batch_id + 1 for r in sent)
