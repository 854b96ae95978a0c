"""The check registry and the listing fixture shared by the checks.

``jobs`` derives a listing table from ``documents`` and ``events``. It exists twice, as a
DataFrame and as SQL (the ``jobs`` CTE), and covers all documents with their whole text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.session import ship_package, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def as_of() -> Column:
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its oracle (with the jobs CTE in front when it uses it)."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# Tables of long texts, and the column their rows are spread by.
_TEXT_TABLES = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, _TEXT_TABLES[name]) if name in _TEXT_TABLES else df


SOURCES = ["remoteok", "wwr", "hn", "upwork_rss", "rozee", "manual"]
TITLES = [
    "Senior Payroll Clerk", "PHP8 Maintainer", "Cloud Security Auditor", "Nurse", "Full Stack Mentor",
    "Warehouse Picker", "Support Desk Intern", "React Native Contractor", "Web Shop Operator",
    "Data Pipeline Lead", "Cloud Cost Analyst", "Junior Translator II",
]
LOCATIONS = ["Remote (US)", "Worldwide", "Lahore, Pakistan", "Berlin, Germany", "London",
             "come join us", "South America", "EU only"]
TAGS = ["Full-time,Python", "part_time", "contractor,API", "", "Kubernetes,Go"]
SUFFIXES = [
    " Requires 5+ years of experience.", " Experience of at least 3 yrs.",
    " 100+ years of experience!", " Unpaid trial.", " We care about website security.",
    " No experience required, APIs and ReactJS.", " Mail jobs@acme.test or noreply@acme.test.",
    "", "", "",
]
STATUS_OF = {3: "shortlisted", 4: "applied", 5: "replied", 6: "interview", 7: "won", 8: "lost", 9: "ignored"}


def _choose(index: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    i = F.col("doc_id")
    rows = d.join(e, F.col("event_id") == i, "left")
    number = F.when(i % 10 == 9, i - 1).otherwise(i).cast("string")
    host = F.when(i % 2 == 0, "HTTPS://Jobs.Example.org/L/").otherwise("https://jobs.example.org/l/")
    at = F.col("ts")
    hours = lambda n: at + F.expr(f"interval {n} hours")
    status = F.lit("new")
    for k, v in STATUS_OF.items():
        status = F.when(i % 11 == k, v).otherwise(status)
    return rows.select(
        i.alias("id"),
        F.lit(1).cast("long").alias("cycle_id"),
        i.alias("item_ord"),
        (i % 6).alias("source_ord"),
        _choose(i % 6, SOURCES).alias("source"),
        i.cast("string").alias("external_id"),
        F.concat(F.when(i % 7 == 0, "  ").otherwise(""), host, number).alias("url"),
        _choose(i % 12, TITLES).alias("title"),
        F.when(F.col("user_id") % 11 != 0, F.concat(F.lit("Company "), F.col("user_id") % 40)).alias("company"),
        F.when(i % 9 < 8, _choose(F.least(i % 9, F.lit(7)), LOCATIONS)).alias("location"),
        F.filter(F.split(_choose(i % 5, TAGS), ","), lambda t: t != "").alias("tags"),
        F.when(i % 8 == 0, "$20/hr").when(i % 8 == 1, "$100,000 - $130,000").alias("budget"),
        F.concat(F.col("text"), _choose(i % 10, SUFFIXES)).alias("description"),
        F.when(i % 13 != 0, at).alias("posted_at"),
        hours(1).alias("fetched_at"),
        F.when(F.col("event_type") != "signup", (F.floor("value") % 11).cast("int")).alias("ai_score"),
        (i % 7).cast("int").alias("ai_attempts"),
        F.when(i % 3 == 0, F.concat(F.lit("=fit "), i)).alias("ai_reason"),
        F.when(i % 4 == 0, F.concat(F.lit("Dear "), i)).alias("ai_proposal"),
        status.alias("status"),
        F.when((i % 11).between(4, 8) & (i % 4 != 0), hours(48)).alias("applied_at"),
        F.when(i % 17 == 0, hours(24)).alias("notified_at"),
        F.when(i % 19 == 0, F.concat(F.lit("-note "), i)).otherwise("").alias("notes"),
    )


def _sql_case(index: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {n} THEN '{v}'" for n, v in enumerate(values))
    return f"CASE {index} {arms} END"


_STATUS_SQL = "CASE doc_id % 11 " + " ".join(
    f"WHEN {k} THEN '{v}'" for k, v in STATUS_OF.items()
) + " ELSE 'new' END"

JOBS_SQL = f"""
jobs AS (
  SELECT doc_id AS id, doc_id % 6 AS source_ord,
    {_sql_case('doc_id % 6', SOURCES)} AS source,
    CAST(doc_id AS VARCHAR) AS external_id,
    (CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE '' END)
      || (CASE WHEN doc_id % 2 = 0 THEN 'HTTPS://Jobs.Example.org/L/' ELSE 'https://jobs.example.org/l/' END)
      || CAST(CASE WHEN doc_id % 10 = 9 THEN doc_id - 1 ELSE doc_id END AS VARCHAR) AS url,
    {_sql_case('doc_id % 12', TITLES)} AS title,
    CASE WHEN user_id % 11 <> 0 THEN 'Company ' || CAST(user_id % 40 AS VARCHAR) END AS company,
    {_sql_case('doc_id % 9', LOCATIONS)} AS location,
    {_sql_case('doc_id % 5', TAGS)} AS tags_csv,
    replace({_sql_case('doc_id % 5', TAGS)}, ',', ' ') AS tags_text,
    CASE doc_id % 8 WHEN 0 THEN '$20/hr' WHEN 1 THEN '$100,000 - $130,000' END AS budget,
    text || {_sql_case('doc_id % 10', SUFFIXES)} AS description,
    CASE WHEN doc_id % 13 <> 0 THEN ts END AS posted_at,
    ts + INTERVAL 1 HOUR AS fetched_at,
    CASE WHEN event_type <> 'signup' THEN CAST(CAST(floor(value) AS BIGINT) % 11 AS INTEGER) END AS ai_score,
    CAST(doc_id % 7 AS INTEGER) AS ai_attempts,
    CASE WHEN doc_id % 3 = 0 THEN '=fit ' || CAST(doc_id AS VARCHAR) END AS ai_reason,
    CASE WHEN doc_id % 4 = 0 THEN 'Dear ' || CAST(doc_id AS VARCHAR) END AS ai_proposal,
    {_STATUS_SQL} AS status,
    CASE WHEN doc_id % 11 BETWEEN 4 AND 8 AND doc_id % 4 <> 0 THEN ts + INTERVAL 48 HOUR END AS applied_at,
    CASE WHEN doc_id % 17 = 0 THEN ts + INTERVAL 24 HOUR END AS notified_at,
    CASE WHEN doc_id % 19 = 0 THEN '-note ' || CAST(doc_id AS VARCHAR) ELSE '' END AS notes
  FROM documents LEFT JOIN events ON event_id = doc_id
)"""


def with_jobs(sql: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([JOBS_SQL.strip(), *ctes]) + "\n" + sql


# Building blocks for SQL patterns: RE2 has no look-around, so boundaries are consumed.
B0, B1 = r"(^|[^\pL\pN_])", r"([^\pL\pN_]|$)"
HASH_SQL = "sha256(lower(trim(url)))"
GATE_TEXT_SQL = "lower(trim(title) || chr(10) || description)"
