"""What is stored and read again: streams, files, tables from before late columns, sources added later."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import HASH_SQL, ORACLES, check, jobs, table, with_jobs
from checks.feed import event_log
from checks.ingest import BLOCKED_SQL, CONFIG, KEYWORD_SQL
from checks.sources import BUILDERS, landed, obj, pages_of
from listwright import fixed_values as fv
from listwright.operators.match import read_profile_files
from listwright.plans import lifecycle
from listwright.schemas import LISTING, read_listings
from listwright.session import scratch_path, spread, written
from listwright.sources import html_feeds, registry
from listwright.sources.json_feeds import remotive
from listwright.sources.registry import feed_health, normalize
from listwright.streaming import activity
from listwright.streaming.alerts import alert_batch, outbox
from listwright.streaming.ingest import Paths, StreamConfig, start_ingest, stored


def _listing_rows(spark, d):
    """The fixture in the shape of the listing table."""
    rows = jobs(spark, d).withColumn("dedupe_hash", F.sha2(F.lower(F.trim("url")), 256)).withColumn("contact_emails", F.lit(None))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LISTING])


# ------------------------------------------------------------------ streams
@check(
    "stream_cycle",
    with_jobs(
        """SELECT row_number() OVER (ORDER BY cycle, id) AS id, trim(url) AS url, title, dedupe_hash
        FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_hash ORDER BY cycle, id) AS rn
              FROM (SELECT *, 1 + (id // 50) % 2 AS cycle FROM titled WHERE passes)) WHERE rn = 1""",
        f"""titled AS (SELECT id, url, title, {HASH_SQL} AS dedupe_hash, NOT {BLOCKED_SQL} AND {KEYWORD_SQL} AS passes
          FROM (SELECT id, url, title, '' AS description FROM jobs))""",
    ),
)
def stream_cycle(spark, d):
    """Two landings of one source, each worked off by the ingest stream."""
    paths = Paths(*[scratch_path(spark, name) for name in ("landing", "listings", "runs", "stream")], address_buckets=8)
    item = obj(id=F.col("id"), url=F.col("url"), title=F.col("title"))
    pages = written(pages_of(jobs(spark, d).select("id", "url", "title"), item), "stream-pages")
    body = F.concat(F.lit('{"jobs":['), "items", F.lit("]}"))
    for parity in (0, 1):
        landing = landed(pages.filter(F.col("page") % 2 == parity), "remotive", body)
        landing.withColumn("cycle_id", F.lit(1 + parity).cast("long")).write.mode("append").parquet(paths.landing)
        start_ingest(spark, paths, StreamConfig(ingest=CONFIG, sources=["remotive"]), once=True).awaitTermination()
    return stored(spark, paths.listings).select("id", "url", "title", "dedupe_hash")


@check(
    "alerts_at_most_once",
    with_jobs(
        """SELECT id, CAST((n - 1) // 20 AS BIGINT) AS batch_id FROM (
          SELECT id, row_number() OVER (ORDER BY ai_score DESC, fetched_at DESC, id) AS n FROM jobs
          WHERE ai_score >= 8 AND notified_at IS NULL AND status <> 'ignored') WHERE n <= 60"""
    ),
)
def alerts_at_most_once(spark, d):
    """Three batches of alerts, two of them run twice."""
    rows, path = jobs(spark, d), scratch_path(spark, "outbox")
    for batch_id in (0, 0, 1, 2, 2):
        alert_batch(rows, batch_id, path, F.lit(f"2024-02-0{batch_id + 1} 00:00:00"))
    return outbox(spark, path).select("id", "batch_id")


@check(
    "running_listings_per_day",
    with_jobs(
        """SELECT CAST(fetched_at AS DATE) AS day, source, count(*) AS n FROM jobs
        WHERE fetched_at IS NOT NULL GROUP BY ALL"""
    ),
)
def running_listings_per_day(spark, d):
    """The counts that a stream over the listing table has arrived at once it has read all of it."""
    path, name = scratch_path(spark, "listings"), "running_counts_" + scratch_path(spark, "x").rsplit("-", 1)[-1]
    _listing_rows(spark, d).write.parquet(path)
    stream = activity.listings_per_day(spark.readStream.schema(LISTING).parquet(path))
    stream.writeStream.format("memory").queryName(name).outputMode("complete").option(
        "checkpointLocation", scratch_path(spark, "running-counts")
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


# ------------------------------------------------------------------ tables and files
@check(
    "late_columns",
    with_jobs(
        """SELECT id, CASE WHEN id % 2 = 0 THEN ai_attempts ELSE 0 END AS ai_attempts,
          CASE WHEN id % 2 = 0 THEN notes END AS notes, CAST(NULL AS VARCHAR) AS emails FROM jobs"""
    ),
)
def late_columns(spark, d):
    """A listing table one half of which was written before some columns came, and none with e-mails."""
    path = scratch_path(spark, "listings")
    rows = _listing_rows(spark, d).drop("contact_emails")
    rows.filter(F.col("id") % 2 == 0).write.parquet(path)
    rows.filter(F.col("id") % 2 == 1).drop("notes", "ai_attempts").write.mode("append").parquet(path)
    return read_listings(spark, path).select("id", "ai_attempts", "notes", F.array_join("contact_emails", ",").alias("emails"))


@check(
    "profile_files",
    """SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN c_name || chr(10) || c_mktsegment END AS text,
      CASE WHEN c_custkey % 7 = 0 THEN 'no text' END AS error
    FROM customer WHERE c_nationkey = 3""",
)
def profile_files(spark, d):
    """A file for each customer of one nation, read as profiles; some are blank."""
    text = F.when(F.col("c_custkey") % 7 == 0, " \n ").otherwise(F.concat("c_name", F.lit("\n"), "c_mktsegment", F.lit(" \n")))
    path = scratch_path(spark, "profiles")
    # A file takes its time to make: all cores write, and a customer's rows are in one task.
    rows = spread(table(spark, d, "customer").filter("c_nationkey = 3"), "c_custkey")
    rows.select("c_custkey", text.alias("value")).write.partitionBy("c_custkey").text(path)
    found = read_profile_files(spark, f"{path}/*")
    return found.select(F.regexp_extract("path", r"c_custkey=(\d+)/", 1).cast("long").alias("c_custkey"), "text", "error")


# ------------------------------------------------------------------ sources
@check(
    "registered_source",
    with_jobs("SELECT 'later' AS source, trim(url) AS url, title FROM jobs WHERE title <> 'Nurse'"),
)
def registered_source(spark, d):
    """A source that is added to the registry takes part like any other."""
    registry.register("later", lambda landing: remotive(
        landing.filter("source = 'later'").withColumn("source", F.lit("remotive"))
    ).withColumn("source", F.lit("later")))
    try:
        rows = jobs(spark, d).select("id", "url", F.when(F.col("title") != "Nurse", F.col("title")).alias("title"))
        body = F.concat(F.lit('{"jobs":['), "items", F.lit("]}"))
        landing = landed(pages_of(rows, obj(url=F.col("url"), title=F.col("title"))), "later", body)
        return normalize(landing, ["later"]).select("source", F.trim("url").alias("url"), "title")
    finally:
        del registry.NORMALIZERS["later"]


@check(
    "blocked_pages",
    f"""SELECT 'wellfound' AS source, count(DISTINCT page) AS responses, CAST(0 AS BIGINT) AS failed,
      count(DISTINCT CASE WHEN page % 3 = 1 THEN page END) AS blocked, count(*) FILTER (page % 3 <> 1) AS items
    FROM (SELECT item_ord // 2147483648 AS page FROM ({ORACLES["normalize_wellfound"]}))""",
)
def blocked_pages(spark, d):
    """Every third page is a challenge page instead of listings: told as blocked, and no source of rows."""
    page = F.col("feed_key").cast("long")
    challenge = F.concat(F.lit("<html><title>"), F.element_at(F.array(*map(F.lit, fv.BLOCK_MARKERS)), (page % 2 + 1).cast("int")), F.lit("</title>"), "body")
    landing = written(
        BUILDERS["wellfound"](spark, d).withColumn("body", F.when(page % 3 == 1, challenge).otherwise(F.col("body"))), "blocked-pages"
    )
    health = feed_health(landing, html_feeds.wellfound(landing))
    return health.select("source", "responses", "failed", "blocked", "items")


# ------------------------------------------------------------------ notes
@check(
    "lifecycle_notes",
    """SELECT user_id AS job_id, 'Note ' || CAST(first(event_id ORDER BY ts DESC, event_id DESC) AS VARCHAR) AS notes
    FROM events WHERE event_type = 'view' GROUP BY user_id""",
)
def lifecycle_notes(spark, d):
    """The last note of each listing, of a log in which views are notes."""
    is_note = F.col("kind") == "shortlist"
    log = event_log(spark, d).withColumn("text", F.when(is_note, F.concat(F.lit("Note "), "seq")).otherwise(F.col("text")))
    log = log.withColumn("kind", F.when(is_note, "notes").otherwise(F.col("kind")))
    return lifecycle.fold_texts(log).filter("notes is not null").select("job_id", "notes")
