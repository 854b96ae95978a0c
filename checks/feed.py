"""Facets, feed, pages, statistics, board and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import B0, B1, as_of, check, jobs, table, with_jobs
from checks.ingest import CONFIG
from listwright import fixed_values as fv
from listwright.functions.scalars import required_years
from listwright.operators import predicates as p
from listwright.operators.dedupe import first_per_key
from listwright.plans import export, feed, lifecycle, stats
from listwright.plans.ingest import judge
from listwright.schemas import source_order

CARD = ["id", "source", "title", "company", "location", "ai_score", "status"]
CARD_SQL = ", ".join(CARD)
FEED_ORDER = "coalesce(ai_score, -1) DESC, coalesce(posted_at, fetched_at) DESC, fetched_at DESC, id"


def _join_sql(*parts: str) -> str:
    return "concat_ws(' ', " + ", ".join(f"nullif({x}, '')" for x in parts) + ")"


def _any(text: str, body: str, open_end: bool = False) -> str:
    return f"regexp_matches({text}, '{B0}({body}){'' if open_end else B1}')"


def _quote(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def region_sql(key: str) -> str:
    phrases, tokens = next((p_, t) for k, p_, t in fv.REGIONS if k == key)
    text = _join_sql("location", "title", "tags_text")
    hit = _any(f"lower({text})", _quote(phrases))
    if tokens:
        hit += f" OR regexp_matches({text}, '(^|[^A-Za-z])({_quote(tokens)})([^A-Za-z]|$)')"
    return f"({hit})"


def employment_sql(key: str) -> str:
    pattern, open_end = next((p_, o) for k, p_, o in fv.EMPLOYMENT_TYPES if k == key)
    text = f"lower({_join_sql('title', 'tags_text', 'budget', 'description')})"
    hit = _any(text, pattern, open_end)
    return f"({hit} OR source = 'upwork_rss')" if key == "freelance" else hit


def level_sql(key: str) -> str:
    pattern, deep = next((p_, x) for k, p_, x in fv.EXPERIENCE_LEVELS if k == key)
    text = "title || ' ' || tags_text" + (" || ' ' || description" if deep else "")
    return _any(f"lower({text})", pattern)


def tags_sql(keys: list[str], test) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {test(k)} THEN '{k}' END" for k in keys) + ")"


_FREELANCE_TEXT = f"lower({_join_sql('title', 'tags_text', 'budget')})"
FREELANCE_SQL = (
    "(source = 'upwork_rss' OR "
    + " OR ".join(f"contains({_FREELANCE_TEXT}, '{w}')" for w in fv.FREELANCE_SUBSTRINGS)
    + f" OR regexp_matches({_FREELANCE_TEXT}, '{B0}({'|'.join(fv.FREELANCE_WORDS)})'))"
)
_BEFORE = r"(\d{1,2})\s*\+?\s*(?:years?|yrs?)[^.\n;]{0,40}?(?:experience|exp\b)"
_AFTER = r"experience[^.\n;]{0,40}?(\d{1,2})\s*\+?\s*(?:years?|yrs?)\b"
_TEXT = "lower(title || chr(10) || description)"
YEARS_SQL = (
    f"list_max(list_filter(list_transform(list_concat(regexp_extract_all({_TEXT}, '{_BEFORE}', 1), "
    f"regexp_extract_all({_TEXT}, '{_AFTER}', 1)), lambda n: CAST(n AS INTEGER)), lambda n: n BETWEEN 1 AND 30))"
)


def show(rows):
    return rows.select(*CARD)


# ------------------------------------------------------------------ flagship
_WORDS = _quote(CONFIG.keywords)
_GATE = f"lower(trim(title) || chr(10) || description)"


@check(
    "flagship_feed",
    with_jobs(
        f"""SELECT {CARD_SQL}, n FROM (
          SELECT *, row_number() OVER (ORDER BY {FEED_ORDER}) AS n FROM (
            SELECT *, row_number() OVER (PARTITION BY sha256(lower(trim(url))) ORDER BY source_ord, id) AS rn
            FROM jobs WHERE NOT ({" OR ".join(f"contains({_GATE}, '{b}')" for b in fv.DEFAULT_BLOCKED)})
              AND (source = 'rozee' OR regexp_matches({_GATE}, '{B0}({_WORDS})(s|js|\\p{{Nd}}+|\\.js)?{B1}')))
          WHERE rn = 1 AND status <> 'ignored') WHERE n <= 25"""
    ),
)
def flagship_feed(spark, d):
    eligible = judge(jobs(spark, d), CONFIG).filter("verdict = 'eligible'")
    # The gate has read the texts; cards do not need them any more.
    thin = eligible.select(*CARD, "posted_at", "fetched_at", "dedupe_hash", "item_ord")
    unique = first_per_key(thin, ["dedupe_hash"], [source_order(F.col("source")), "item_ord"])
    request = feed.FeedRequest()
    page = feed.feed_page(unique, request, as_of())
    return _numbered(page, feed.feed_order(request))


def _numbered(page, order):
    """Positions on a page (at most one page of rows)."""
    from pyspark.sql import Window

    return page.withColumn("n", F.row_number().over(Window.orderBy(*order)).cast("long")).select(*CARD, "n")


# ------------------------------------------------------------------ facets
@check("required_years", with_jobs(f"SELECT id, {YEARS_SQL} AS years FROM jobs"))
def years(spark, d):
    return jobs(spark, d).select("id", required_years("title", "description").alias("years"))


@check(
    "max_years_filter",
    with_jobs(f"SELECT id FROM (SELECT id, {YEARS_SQL} AS y FROM jobs) WHERE y IS NULL OR y <= 3"),
)
def max_years_filter(spark, d):
    return jobs(spark, d).filter(p.max_years(3)).select("id")


@check(
    "region_facets",
    with_jobs(f"SELECT id, {tags_sql([k for k, *_ in fv.REGIONS], region_sql)} AS regions FROM jobs"),
)
def region_facets(spark, d):
    return jobs(spark, d).select("id", F.array_join(p.region_tags(), ",").alias("regions"))


@check(
    "employment_facets",
    with_jobs(f"SELECT id, {tags_sql([k for k, *_ in fv.EMPLOYMENT_TYPES], employment_sql)} AS types FROM jobs"),
)
def employment_facets(spark, d):
    return jobs(spark, d).select("id", F.array_join(p.employment_tags(), ",").alias("types"))


@check(
    "experience_facets",
    with_jobs(f"SELECT id, {tags_sql([k for k, *_ in fv.EXPERIENCE_LEVELS], level_sql)} AS levels FROM jobs"),
)
def experience_facets(spark, d):
    return jobs(spark, d).select("id", F.array_join(p.experience_tags(), ",").alias("levels"))


# ------------------------------------------------------------------ feeds
# A clock inside the time span of the fixture, where the default one leaves nothing.
EARLY_SQL = "TIMESTAMP '2024-01-03 12:00:00'"


def early():
    return F.lit("2024-01-03 12:00:00").cast("timestamp_ntz")


def _feed(name: str, where: str, request: feed.FeedRequest, first: int = 1, last: int | None = 25, clock=as_of):
    bounds = f"WHERE n BETWEEN {first} AND {last}" if last else ""
    sql = with_jobs(
        f"""SELECT {CARD_SQL}, n FROM (SELECT *, row_number() OVER (ORDER BY {FEED_ORDER}) AS n
        FROM jobs WHERE {where}) {bounds}"""
    )

    @check(name, sql)
    def run(spark, d):
        rows = jobs(spark, d)
        return _numbered(feed.feed_page(rows, request, clock()), feed.feed_order(request)).withColumn(
            "n", F.col("n") + (first - 1)
        )


_feed("active_feed_top25", "status <> 'ignored'", feed.FeedRequest())
_feed("feed_page_3", "status <> 'ignored'", feed.FeedRequest(page=3), 51, 75)
_feed("freelance_feed", f"status <> 'ignored' AND {FREELANCE_SQL}", feed.FeedRequest(freelance=True))
_feed(
    "posted_within_1d",
    f"status <> 'ignored' AND coalesce(posted_at, fetched_at) >= {EARLY_SQL} - INTERVAL 1 DAY",
    feed.FeedRequest(posted_within=1), clock=early,
)
_feed(
    "feed_by_source_status_score",
    "source IN ('hn', 'wwr') AND status = 'new' AND ai_score >= 4",
    feed.FeedRequest(sources=["hn", "wwr"], status="new", min_score=4),
)
_feed(
    "feed_all_facets",
    f"{region_sql('usa')} AND ({employment_sql('full_time')} OR {employment_sql('contract')}) "
    f"AND ({level_sql('senior')} OR {level_sql('principal')} OR {level_sql('manager')} OR {level_sql('no_experience')})",
    feed.FeedRequest(status="all", region="usa", employment=["full_time", "contract", "no such type"],
                     levels=["senior", "principal", "manager", "no_experience"], max_years=11),
)


@check(
    "feed_last_page_clamped",
    with_jobs(
        f"""SELECT {CARD_SQL} FROM (SELECT *, row_number() OVER (ORDER BY {FEED_ORDER}) AS n,
            count(*) OVER () AS total FROM jobs WHERE status = 'won')
        WHERE ceil(n / 25.0) = ceil(total / 25.0)"""
    ),
)
def feed_last_page_clamped(spark, d):
    # The page asked for is far behind the end whatever the table holds at this status.
    request = feed.FeedRequest(status="won", page=1000)
    return show(feed.feed_page(jobs(spark, d), request, as_of()))


@check(
    "low_match_split",
    with_jobs(
        f"""SELECT id, low, n FROM (SELECT id, coalesce(ai_score < 6, false) AS low, row_number() OVER (
          ORDER BY coalesce(ai_score < 6, false), {FEED_ORDER}) AS n FROM jobs WHERE status <> 'ignored')
        WHERE n <= 25"""
    ),
)
def low_match_split(spark, d):
    request = feed.FeedRequest(low_match_below=fv.DEFAULT_MIN_SCORE)
    page = feed.feed_page(jobs(spark, d), request, as_of())
    return _numbered(page, feed.feed_order(request)).select(
        "id", F.coalesce(F.col("ai_score") < fv.DEFAULT_MIN_SCORE, F.lit(False)).alias("low"), "n"
    )


@check(
    "page_totals",
    with_jobs(
        """SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 25.0)) AS BIGINT) AS pages,
          CAST(greatest(1, least(7, ceil(count(*) / 25.0))) AS BIGINT) AS page
        FROM jobs WHERE status <> 'ignored'"""
    ),
)
def page_totals(spark, d):
    return feed.page_info(jobs(spark, d).filter(p.status_filter(None)), 7)


def _registry_sql() -> str:
    rows = [(k, i, label) for i, (k, label, *_) in enumerate(fv.SOURCES)]
    rows.append((fv.MANUAL_SOURCE[0], len(rows), fv.MANUAL_SOURCE[1]))
    return "registry(source, source_ord, label) AS (VALUES " + ", ".join(
        f"('{k}', CAST({i} AS INTEGER), '{label}')" for k, i, label in rows
    ) + ")"


@check(
    "source_choices",
    with_jobs(
        """SELECT source, source_ord, label FROM registry UNION ALL
        SELECT DISTINCT 'old_' || status, CAST(1000 AS INTEGER), 'old_' || status FROM jobs""",
        _registry_sql(),
    ),
)
def source_choices(spark, d):
    rows = jobs(spark, d).select(F.explode(F.array("source", F.concat(F.lit("old_"), "status"))).alias("source"))
    return feed.source_choices(rows)


# ------------------------------------------------------------------ statistics
def _label_sql() -> str:
    return "CASE source " + " ".join(
        f"WHEN '{k}' THEN '{label}'" for k, label in [(k, x) for k, x, *_ in fv.SOURCES] + [fv.MANUAL_SOURCE[:2]]
    ) + " ELSE source END"


def _color_sql() -> str:
    pairs = [(k, c) for k, _, c, _ in fv.SOURCES] + [(fv.MANUAL_SOURCE[0], fv.MANUAL_SOURCE[2])]
    return "CASE source " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in pairs) + f" ELSE '{fv.DEFAULT_COLOR}' END"


def _chart_sql() -> str:
    return "CAST(CASE source " + " ".join(
        f"WHEN '{k}' THEN {i + 1}" for i, k in enumerate(fv.CHART_ORDER)
    ) + f" ELSE {len(fv.CHART_ORDER) + 1} END AS INTEGER)"


@check(
    "listings_per_source_day",
    with_jobs(
        f"""SELECT s.source, {_label_sql().replace('source', 's.source')} AS label,
          {_color_sql().replace('CASE source', 'CASE s.source')} AS color,
          {_chart_sql().replace('CASE source', 'CASE s.source')} AS chart_ord, days.day, count(r.source) AS n
        FROM (SELECT DISTINCT source FROM recent) s CROSS JOIN days
        LEFT JOIN recent r ON r.source = s.source AND CAST(r.fetched_at AS DATE) = days.day
        GROUP BY ALL""",
        """days AS (SELECT CAST(unnest(generate_series(DATE '2023-12-21', DATE '2024-01-03', INTERVAL 1 DAY)) AS DATE) AS day)""",
        """recent AS (SELECT source, fetched_at FROM jobs WHERE CAST(fetched_at AS DATE)
          BETWEEN DATE '2023-12-21' AND DATE '2024-01-03')""",
    ),
)
def listings_per_source_day(spark, d):
    return stats.listings_per_source_day(jobs(spark, d), early())


@check(
    "event_listings_per_day",
    """SELECT s.source, s.source AS label, '#8fa3bd' AS color, CAST(23 AS INTEGER) AS chart_ord, days.day, count(r.source) AS n
    FROM (SELECT DISTINCT event_type AS source FROM events WHERE ts >= DATE '2024-01-18') s
    CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '2024-01-18', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day) days
    LEFT JOIN (SELECT event_type AS source, CAST(ts AS DATE) AS day FROM events) r
      ON r.source = s.source AND r.day = days.day
    GROUP BY ALL""",
)
def event_listings_per_day(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("ts").alias("fetched_at"))
    return stats.listings_per_source_day(rows, as_of())


_WEEKS = """weeks AS (SELECT CAST(unnest(generate_series(DATE '2023-12-11', DATE '2024-01-29', INTERVAL 7 DAY)) AS DATE) AS week)"""


@check(
    "applications_per_week",
    with_jobs(
        """SELECT weeks.week, count(j.id) AS n FROM weeks
        LEFT JOIN jobs j ON CAST(date_trunc('week', j.applied_at) AS DATE) = weeks.week GROUP BY ALL""",
        _WEEKS,
    ),
)
def applications_per_week(spark, d):
    return stats.applications_per_week(jobs(spark, d), as_of())


@check(
    "order_applications_per_week",
    """SELECT weeks.week, count(o_orderkey) AS n
    FROM (SELECT CAST(unnest(generate_series(DATE '1998-06-15', DATE '1998-08-03', INTERVAL 7 DAY)) AS DATE) AS week) weeks
    LEFT JOIN orders ON CAST(date_trunc('week', o_orderdate) AS DATE) = weeks.week GROUP BY ALL""",
)
def order_applications_per_week(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderdate").alias("applied_at"))
    return stats.applications_per_week(rows, F.lit("1998-08-07 00:00:00").cast("timestamp_ntz"))


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@check(
    "funnel_tiles",
    with_jobs(
        f"""SELECT total_jobs, scored_jobs, high_fit, applied,
          CAST(round_even(100.0 * replied / applied, 0) AS BIGINT) AS reply_rate,
          CAST(round_even(100.0 * interviews / applied, 0) AS BIGINT) AS interview_rate, CAST(8 AS INTEGER) AS threshold
        FROM (SELECT count(*) AS total_jobs, count(ai_score) AS scored_jobs,
            count(*) FILTER (ai_score >= 8) AS high_fit,
            count(*) FILTER (applied_at IS NOT NULL OR status IN {_in(fv.APPLIED_OR_BEYOND)}) AS applied,
            count(*) FILTER (status IN {_in(fv.REPLIED_STATUSES)}) AS replied,
            count(*) FILTER (status IN {_in(fv.INTERVIEW_STATUSES)}) AS interviews FROM jobs)"""
    ),
)
def funnel_tiles(spark, d):
    return stats.funnel(jobs(spark, d), 0)


@check("distinct_sources", with_jobs("SELECT DISTINCT source FROM jobs"))
def distinct_sources(spark, d):
    return stats.sources_present(jobs(spark, d))


# ------------------------------------------------------------------ lifecycle on events
def event_log(spark, d):
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"),
        F.when(kind == "view", "shortlist").when(kind == "click", "move").when(kind == "purchase", "apply")
        .when(kind == "error", "ignore").otherwise("rescore").alias("kind"),
        F.when(kind == "click", F.when(F.col("value") < 3, "applied").otherwise("replied")).alias("status"),
        F.when(kind == "signup", F.concat(F.lit("Draft "), F.col("event_id"))).alias("text"),
        F.when(kind == "signup", (F.floor("value") % 11).cast("int")).alias("score"),
        F.when(kind == "signup", "again").alias("reason"),
    )


_LAST = "ORDER BY ts DESC, event_id DESC"
STATE_SQL = f"""
  SELECT user_id AS job_id,
    CASE last_type WHEN 'view' THEN 'shortlisted' WHEN 'purchase' THEN 'applied' WHEN 'error' THEN 'ignored'
      ELSE CASE WHEN last_value < 3 THEN 'applied' ELSE 'replied' END END AS status,
    coalesce(last_apply, first_move) AS applied_at
  FROM (SELECT user_id,
      first(event_type {_LAST}) FILTER (event_type <> 'signup') AS last_type,
      first(value {_LAST}) FILTER (event_type <> 'signup') AS last_value,
      max(ts) FILTER (event_type = 'purchase') AS last_apply,
      min(ts) FILTER (event_type = 'click' AND value < 3) AS first_move
    FROM events GROUP BY user_id) WHERE last_type IS NOT NULL"""


@check("lifecycle_state", STATE_SQL)
def lifecycle_state(spark, d):
    return lifecycle.fold_status(event_log(spark, d)).select("job_id", "status", "applied_at")


@check(
    "lifecycle_rescore",
    f"""SELECT user_id AS job_id, 'Draft ' || CAST(first(event_id {_LAST}) AS VARCHAR) AS ai_proposal,
      CAST(CAST(floor(first(value {_LAST})) AS BIGINT) % 11 AS INTEGER) AS ai_score
    FROM events WHERE event_type = 'signup' GROUP BY user_id""",
)
def lifecycle_rescore(spark, d):
    return lifecycle.fold_texts(event_log(spark, d)).filter("rescored").select(
        "job_id", "ai_proposal", "ai_score"
    )


@check(
    "retry_counter",
    """SELECT e.user_id AS job_id, CAST(count(*) AS INTEGER) AS ai_attempts FROM events e
    LEFT JOIN (SELECT user_id, max(ts) AS reset FROM events WHERE event_type = 'signup' GROUP BY user_id) r
      ON r.user_id = e.user_id
    WHERE e.event_type = 'error' AND (r.reset IS NULL OR e.ts > r.reset) GROUP BY e.user_id""",
)
def retry_counter(spark, d):
    log = event_log(spark, d).withColumn(
        "kind", F.when(F.col("kind") == "ignore", "score_failed").otherwise(F.col("kind"))
    )
    return lifecycle.fold_attempts(log)


@check(
    "current_state",
    with_jobs(
        f"""SELECT j.id, coalesce(s.status, j.status) AS status,
          coalesce(s.last_apply, j.applied_at, s.first_move) AS applied_at,
          coalesce(r.ai_score, j.ai_score) AS ai_score, coalesce(r.ai_proposal, j.ai_proposal) AS ai_proposal,
          CASE WHEN r.job_id IS NOT NULL THEN 0 ELSE j.ai_attempts END AS ai_attempts, j.notes
        FROM jobs j
        LEFT JOIN (SELECT st.*, m.last_apply, m.first_move FROM ({STATE_SQL}) st JOIN (
            SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS last_apply,
              min(ts) FILTER (event_type = 'click' AND value < 3) AS first_move FROM events GROUP BY user_id) m
          ON m.user_id = st.job_id) s ON s.job_id = j.id
        LEFT JOIN (SELECT user_id AS job_id, 'Draft ' || CAST(first(event_id {_LAST}) AS VARCHAR) AS ai_proposal,
            CAST(CAST(floor(first(value {_LAST})) AS BIGINT) % 11 AS INTEGER) AS ai_score
          FROM events WHERE event_type = 'signup' GROUP BY user_id) r ON r.job_id = j.id"""
    ),
)
def current_state(spark, d):
    return lifecycle.current_state(jobs(spark, d), event_log(spark, d)).select(
        "id", "status", "applied_at", "ai_score", "ai_proposal", "ai_attempts", "notes"
    )


# ------------------------------------------------------------------ board and export
_ORD = "CAST(CASE status " + " ".join(
    f"WHEN '{s}' THEN {i + 1}" for i, s in enumerate(fv.TRACKER_COLUMNS)
) + " END AS INTEGER)"


@check(
    "tracker_board",
    with_jobs(
        f"""SELECT status, {_ORD} AS column_ord, id, row_number() OVER (
          ORDER BY {_ORD}, coalesce(applied_at, fetched_at) DESC, id) AS n
        FROM jobs WHERE status <> 'ignored'"""
    ),
)
def tracker_board(spark, d):
    from listwright.operators.dedupe import number_rows

    cards = lifecycle.board(jobs(spark, d)).select("status", "column_ord", "id", "applied_at", "fetched_at")
    numbered = number_rows(cards, ["column_ord", *lifecycle.board_order()], "n")
    return numbered.select("status", "column_ord", "id", "n")


@check(
    "board_counts",
    with_jobs(
        f"""SELECT c.status, c.column_ord, count(j.id) AS n
        FROM (VALUES {", ".join(f"('{s}', CAST({i + 1} AS INTEGER))" for i, s in enumerate(fv.TRACKER_COLUMNS))}) c(status, column_ord)
        LEFT JOIN jobs j ON j.status = c.status GROUP BY ALL"""
    ),
)
def board_counts(spark, d):
    return lifecycle.board_counts(jobs(spark, d))


def _safe_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches(coalesce({c}, ''), '^[=+@\\t\\r-]') THEN '''' || {c} ELSE coalesce({c}, '') END AS {c}"


def _iso_sql(c: str) -> str:
    return f"coalesce(strftime({c}, '%Y-%m-%dT%H:%M:%S'), '') AS {c}"


@check(
    "tracker_export",
    with_jobs(
        f"""SELECT id, {", ".join(_safe_sql(c) for c in ("source", "title", "company", "url", "status", "ai_reason", "notes"))},
          coalesce(CAST(ai_score AS VARCHAR), '') AS ai_score,
          {", ".join(_iso_sql(c) for c in ("applied_at", "posted_at", "fetched_at"))}
        FROM jobs WHERE status <> 'ignored'"""
    ),
)
def tracker_export(spark, d):
    return export.tracker_export(jobs(spark, d))
