"""Gate, dedupe, accounting, manual rows, contact e-mails."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from checks.base import B0, B1, HASH_SQL, as_of, check, jobs, table, with_jobs
from listwright import fixed_values as fv
from listwright.functions.scalars import dedupe_key, extract_emails
from listwright.operators import predicates as p
from listwright.operators.dedupe import first_per_key, not_in, number_rows
from listwright.plans import ingest
from listwright.session import scratch_path
from listwright.sources.manual import check_manual, manual_listings
from listwright.streaming.ingest import Paths, store_batch, stored

CONFIG = ingest.IngestConfig(
    keywords=["laravel", "php", "python", "next.js", "react", "node", "full stack", "api", "ai",
              "developer", "software engineer", "backend", "frontend", "web"]
)
_WORDS = "|".join(re.escape(k).replace(r"\ ", " ") for k in CONFIG.keywords)
TEXT = "lower(trim(title) || chr(10) || description)"
KEYWORD_SQL = f"regexp_matches({TEXT}, '{B0}({_WORDS})(s|js|\\p{{Nd}}+|\\.js)?{B1}')"
BLOCKED_SQL = "(" + " OR ".join(f"contains({TEXT}, '{b}')" for b in fv.DEFAULT_BLOCKED) + ")"
GATE_SQL = f"(NOT {BLOCKED_SQL} AND (source = 'rozee' OR {KEYWORD_SQL}))"
JUDGED = f"""judged AS (
  SELECT *, {HASH_SQL} AS dedupe_hash,
    CASE WHEN trim(url) = '' THEN 'no_url' WHEN NOT {GATE_SQL} THEN 'gated' ELSE 'eligible' END AS verdict
  FROM jobs)"""
RANKED = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dedupe_hash ORDER BY source_ord, id) AS rn
  FROM judged WHERE verdict = 'eligible')"""
# What is stored already: the addresses of ignored listings.
KNOWN = f"known AS (SELECT DISTINCT {HASH_SQL} AS dedupe_hash FROM jobs WHERE status = 'ignored')"


def known_hashes(spark, d):
    return jobs(spark, d).filter("status = 'ignored'").select(dedupe_key("url").alias("dedupe_hash")).distinct()


def emails_sql(text: str, domains: list[str]) -> str:
    skip_local = " OR ".join(f"contains(split_part(e, '@', 1), '{s}')" for s in fv.EMAIL_SKIP_LOCALS)
    ends = "|".join(s.replace(".", r"\.") for s in fv.EMAIL_SKIP_ENDINGS)
    listed = "|".join(d.replace(".", r"\.") for d in domains)
    cleaned = f"""list_filter(
        list_transform(regexp_extract_all({text}, '{fv.EMAIL_PATTERN}'), lambda e: trim(lower(e), '.')),
        lambda e: NOT ({skip_local}) AND NOT regexp_matches(e, '({ends})$')
          AND NOT regexp_matches(e, '(@|\\.)({listed})$'))"""
    distinct = f"list_filter({cleaned}, lambda x, i: list_position({cleaned}, x) = i)"
    return f"array_to_string(list_slice({distinct}, 1, 5), ',')"


EMAILS_SQL = emails_sql("(title || chr(10) || description)", fv.EMAIL_SKIP_DOMAINS)


@check(
    "url_dedupe_first_wins",
    with_jobs(
        f"""SELECT id, source, dedupe_hash FROM (
          SELECT id, source, {HASH_SQL} AS dedupe_hash,
            row_number() OVER (PARTITION BY {HASH_SQL} ORDER BY source_ord, id) AS rn FROM jobs)
        WHERE rn = 1"""
    ),
)
def url_dedupe_first_wins(spark, d):
    rows = jobs(spark, d).select("id", "source", "source_ord", dedupe_key("url").alias("dedupe_hash"))
    return first_per_key(rows, ["dedupe_hash"], ["source_ord", "id"]).select("id", "source", "dedupe_hash")


@check(
    "new_row_anti_join",
    with_jobs(
        f"""SELECT id, dedupe_hash FROM (
          SELECT id, {HASH_SQL} AS dedupe_hash,
            row_number() OVER (PARTITION BY {HASH_SQL} ORDER BY source_ord, id) AS rn FROM jobs)
        WHERE rn = 1 AND dedupe_hash NOT IN (SELECT dedupe_hash FROM known)""",
        KNOWN,
    ),
)
def new_row_anti_join(spark, d):
    rows = jobs(spark, d).select("id", "source_ord", dedupe_key("url").alias("dedupe_hash"))
    first = first_per_key(rows, ["dedupe_hash"], ["source_ord", "id"])
    return not_in(first, known_hashes(spark, d), "dedupe_hash").select("id", "dedupe_hash")


@check("keyword_gate", with_jobs(f"SELECT id, {KEYWORD_SQL} AS passes FROM jobs"))
def keyword_gate(spark, d):
    return jobs(spark, d).select("id", p.passes_keywords(p.gate_text(), CONFIG.keywords).alias("passes"))


@check("blocked_gate", with_jobs(f"SELECT id, {BLOCKED_SQL} AS blocked FROM jobs"))
def blocked_gate(spark, d):
    return jobs(spark, d).select("id", p.is_blocked(p.gate_text(), CONFIG.blocked).alias("blocked"))


@check("prefiltered_bypass", with_jobs(f"SELECT id, source FROM jobs WHERE {GATE_SQL}"))
def prefiltered_bypass(spark, d):
    passed = p.passes_gate(F.col("source"), p.gate_text(), CONFIG.keywords, CONFIG.blocked)
    return jobs(spark, d).filter(passed).select("id", "source")


@check(
    "ingest_new_listings",
    with_jobs(
        f"""SELECT source, external_id, trim(url) AS url, title, dedupe_hash, 'new' AS status,
          CAST(0 AS INTEGER) AS ai_attempts, {EMAILS_SQL} AS emails
        FROM ranked WHERE rn = 1 AND dedupe_hash NOT IN (SELECT dedupe_hash FROM known)""",
        KNOWN, JUDGED, RANKED,
    ),
)
def ingest_new_listings(spark, d):
    rows = ingest.new_listings(jobs(spark, d), known_hashes(spark, d), CONFIG, as_of())
    return rows.select(
        "source", "external_id", "url", "title", "dedupe_hash", "status", "ai_attempts",
        F.array_join("contact_emails", ",").alias("emails"),
    )


@check(
    "ingest_replay",
    with_jobs(
        """SELECT row_number() OVER (ORDER BY cycle, source_ord, id) AS id, cycle - 1 AS batch_id, source, external_id, dedupe_hash
        FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_hash ORDER BY cycle, source_ord, id) AS rn
              FROM (SELECT *, 1 + id % 3 AS cycle FROM judged WHERE verdict = 'eligible')) WHERE rn = 1""",
        JUDGED,
    ),
)
def ingest_replay(spark, d):
    """Three cycles over the listings, the second one run twice: each stores what no earlier one has."""
    raw = jobs(spark, d).withColumn("cycle_id", 1 + F.col("id") % 3)
    paths = Paths(*[scratch_path(spark, name) for name in ("landing", "listings", "runs", "stream")], address_buckets=8)
    for batch_id in (0, 1, 1, 2):
        store_batch(raw.filter(F.col("cycle_id") == batch_id + 1), batch_id, paths, CONFIG)
    return stored(spark, paths.listings).select("id", "batch_id", "source", "external_id", "dedupe_hash")


@check(
    "ingest_cycle_summary",
    with_jobs(
        """SELECT CAST(1 AS BIGINT) AS cycle_id, coalesce(source, '(all)') AS source,
            count(*) AS fetched, CAST(sum(ins) AS BIGINT) AS inserted,
            CAST(count(*) - sum(ins) AS BIGINT) AS skipped,
            count(*) FILTER (verdict = 'no_url') AS skipped_no_url,
            count(*) FILTER (verdict = 'gated') AS skipped_gated,
            CAST(count(*) FILTER (verdict = 'eligible') - sum(ins) AS BIGINT) AS skipped_duplicate
        FROM (SELECT j.source, j.verdict,
                CASE WHEN r.rn = 1 AND j.dedupe_hash NOT IN (SELECT dedupe_hash FROM known) THEN 1 ELSE 0 END AS ins
              FROM judged j LEFT JOIN ranked r ON r.id = j.id)
        GROUP BY GROUPING SETS ((source), ())""",
        KNOWN, JUDGED, RANKED,
    ),
)
def ingest_cycle_summary(spark, d):
    return ingest.cycle_summary(jobs(spark, d), known_hashes(spark, d), CONFIG)


@check(
    "extract_emails_documents",
    f"SELECT doc_id, {emails_sql('text', ['example.org'])} AS emails FROM documents",
)
def extract_emails_documents(spark, d):
    found = extract_emails("text", skip_domains=["example.org"])
    return table(spark, d, "documents").select("doc_id", F.array_join(found, ",").alias("emails"))


@check(
    "email_backfill",
    with_jobs(
        f"SELECT id, CASE WHEN status = 'new' THEN 'kept@acme.test' ELSE {EMAILS_SQL} END AS emails FROM jobs"
    ),
)
def email_backfill(spark, d):
    late = F.when(F.col("status") == "new", F.array(F.lit("kept@acme.test")))
    rows = ingest.backfill_emails(jobs(spark, d).withColumn("contact_emails", late))
    return rows.select("id", F.array_join("contact_emails", ",").alias("emails"))


@check(
    "dense_numbering",
    with_jobs("SELECT id, row_number() OVER (ORDER BY fetched_at DESC, id) AS n FROM jobs"),
)
def dense_numbering(spark, d):
    rows = jobs(spark, d).select("id", "fetched_at")
    return number_rows(rows, [F.desc("fetched_at"), F.asc("id")], "n").select("id", "n")


# Rows typed in by hand: some without address or title, some with a wrong scheme.
_TYPED_SQL = """typed AS (
  SELECT *, trim(u) <> '' AND t <> '' AND regexp_matches(lower(trim(u)), '^https?://') AS good,
    sha256(lower(trim(u))) AS h
  FROM (SELECT id, company, CASE WHEN location IS NULL THEN '' WHEN location = 'London' THEN 'ftp:' || trim(url) ELSE url END AS u,
          CASE WHEN title = 'Nurse' THEN '' ELSE title END AS t FROM jobs))"""
_CHECKED_SQL = """checked AS (
  SELECT *, CASE WHEN trim(u) = '' OR t = '' THEN 'URL and title are required.'
      WHEN NOT good THEN 'URL must start with http:// or https://'
      WHEN min(id) OVER (PARTITION BY h, good) <> id OR h IN (SELECT dedupe_hash FROM known)
        THEN 'That job is already in your feed.' END AS reason
  FROM typed)"""


@check("manual_batch", with_jobs("SELECT id AS item_ord, reason FROM checked", KNOWN, _TYPED_SQL, _CHECKED_SQL))
def manual_batch(spark, d):
    return check_manual(_typed_in(spark, d), known_hashes(spark, d)).select("item_ord", "reason")


def _typed_in(spark, d):
    url = (
        F.when(F.col("location").isNull(), "")
        .when(F.col("location") == "London", F.concat(F.lit("ftp:"), F.trim("url")))
        .otherwise(F.col("url"))
    )
    title = F.when(F.col("title") == "Nurse", "  ").otherwise(F.col("title"))
    return jobs(spark, d).select(
        "item_ord", url.alias("url"), title.alias("title"), "company", "description"
    )


@check(
    "manual_listings",
    with_jobs(
        """SELECT 'manual' AS source, trim(u) AS url, t AS title, company, h AS dedupe_hash
        FROM checked WHERE reason IS NULL""",
        KNOWN, _TYPED_SQL, _CHECKED_SQL,
    ),
)
def manual_accepted(spark, d):
    checked = check_manual(_typed_in(spark, d), known_hashes(spark, d))
    return manual_listings(checked, as_of()).select("source", "url", "title", "company", "dedupe_hash")


@check(
    "source_flag_overlay",
    with_jobs(
        """SELECT coalesce(a.source, b.source) AS source, coalesce(b.enabled, a.enabled, false) AS enabled
        FROM (SELECT source, bool_or(ai_score >= 5) AS enabled FROM jobs GROUP BY source) a
        FULL JOIN (SELECT 'src:' || status AS source, true AS enabled FROM jobs GROUP BY status
          UNION ALL SELECT source, bool_and(ai_score >= 5) AS enabled FROM jobs WHERE source IN ('hn', 'wwr') GROUP BY source) b
        ON a.source = b.source"""
    ),
)
def source_flag_overlay(spark, d):
    rows = jobs(spark, d)
    good = F.col("ai_score") >= 5
    defaults = rows.groupBy("source").agg(F.bool_or(good).alias("enabled"))
    stored = (
        rows.groupBy("status").agg(F.lit(True).alias("enabled"))
        .select(F.concat(F.lit("src:"), "status").alias("source"), "enabled")
        .unionByName(
            rows.filter(F.col("source").isin("hn", "wwr")).groupBy("source").agg(F.bool_and(good).alias("enabled"))
        )
    )
    return ingest.overlay_flags(defaults, stored)


@check(
    "enabled_source_scan",
    with_jobs("SELECT source, count(*) AS n FROM jobs WHERE source IN ('remoteok', 'upwork_rss', 'rozee') GROUP BY source"),
)
def enabled_source_scan(spark, d):
    # Stored switches: two sources off; 'manual' is unknown to the switches, so it is off.
    rows = ingest.enabled_only(jobs(spark, d), {"wwr": False, "hn": False})
    return rows.groupBy("source").agg(F.count("*").alias("n"))
