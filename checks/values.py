"""Scalar rules on whole table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import AS_OF_SQL, as_of, check, jobs, table, with_jobs
from listwright.functions import scalars as s
from listwright.functions.html import html_to_text
from listwright.functions.text import clean_tags
from listwright.sources.html_feeds import classify_chips, page_links, page_texts


@check(
    "iso_dates",
    """SELECT event_id, ts AS plain, CAST(date_trunc('second', ts) AS TIMESTAMP) - INTERVAL 330 MINUTE AS offset_ts,
      CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS compact,
      CAST(NULL AS TIMESTAMP) AS bad
    FROM events""",
)
def iso_dates(spark, d):
    ts = F.col("ts")
    seconds = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, d, "events").select(
        "event_id",
        s.parse_iso(ts.cast("string")).alias("plain"),
        s.parse_iso(F.concat(seconds, F.lit("+05:30"))).alias("offset_ts"),
        s.parse_iso(F.date_format("ts", "yyyy-MM-dd")).alias("day"),
        s.parse_iso(F.date_format("ts", "yyyyMMdd")).alias("compact"),
        F.coalesce(
            s.parse_iso(F.date_format("ts", "yyyy-MM")), s.parse_iso(F.date_format("ts", "HH:mm")),
            s.parse_iso("event_type"),
        ).alias("bad"),
    )


@check(
    "epoch_dates",
    "SELECT event_id, date_trunc('second', ts) AS at FROM events",
)
def epoch_dates(spark, d):
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return table(spark, d, "events").select("event_id", s.parse_epoch(seconds.cast("double")).alias("at"))


@check(
    "feed_dates",
    "SELECT event_id, date_trunc('second', ts) AS gmt, date_trunc('second', ts) + INTERVAL 5 HOUR AS est FROM events",
)
def feed_dates(spark, d):
    text = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss")
    return table(spark, d, "events").select(
        "event_id", s.parse_feed_date(F.concat(text, F.lit(" GMT"))).alias("gmt"),
        s.parse_feed_date(F.concat(text, F.lit(" EST"))).alias("est"),
    )


@check(
    "relative_dates",
    f"""SELECT event_id, CASE event_type WHEN 'view' THEN {AS_OF_SQL} - to_days(CAST(user_id AS INTEGER))
        WHEN 'click' THEN {AS_OF_SQL} - to_hours(user_id) WHEN 'purchase' THEN {AS_OF_SQL} - to_days(CAST(user_id * 30 AS INTEGER))
        WHEN 'error' THEN {AS_OF_SQL} - INTERVAL 1 DAY END AS at FROM events""",
)
def relative_dates(spark, d):
    kind, n = F.col("event_type"), F.col("user_id")
    label = (
        F.when(kind == "view", F.concat(F.lit(" Posted "), n, F.lit(" Days ago")))
        .when(kind == "click", F.concat(n, F.lit(" hrs ago")))
        .when(kind == "purchase", F.concat(n, F.lit(" month ago")))
        .when(kind == "error", "Yesterday").otherwise("Featured")
    )
    return table(spark, d, "events").select("event_id", s.parse_relative(label, as_of()).alias("at"))


@check(
    "relative_ages",
    f"""SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm ago'
        WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h ago'
        WHEN s < 86400 * 30 THEN CAST(s // 86400 AS VARCHAR) || 'd ago'
        WHEN s < 86400 * 365 THEN CAST(s // 86400 // 30 AS VARCHAR) || 'mo ago'
        ELSE CAST(s // 86400 // 365 AS VARCHAR) || 'y ago' END AS age
    FROM (SELECT event_id, CAST(floor(epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(ts - to_days(CAST(user_id * 5 AS INTEGER)))) AS BIGINT) AS s FROM events)""",
)
def relative_ages(spark, d):
    ts = F.col("ts") - F.make_dt_interval(days=(F.col("user_id") * 5).cast("int"))
    return table(spark, d, "events").select("event_id", s.relative_age(ts, as_of()).alias("age"))


@check(
    "score_bands_and_links",
    with_jobs(
        """SELECT id, CASE WHEN ai_score IS NULL THEN 'unscored' WHEN ai_score >= 8 THEN 'high'
          WHEN ai_score >= 5 THEN 'mid' ELSE 'low' END AS band,
          CASE WHEN location = 'London' THEN '#' ELSE trim(url) END AS link FROM jobs"""
    ),
)
def score_bands_and_links(spark, d):
    url = F.when(F.col("location") == "London", F.concat(F.lit("javascript:"), "url")).otherwise(F.col("url"))
    return jobs(spark, d).select("id", s.score_band("ai_score").alias("band"), s.safe_link(url).alias("link"))


@check(
    "tag_lists",
    """SELECT p_partkey, CASE WHEN p_type = p_brand THEN p_type ELSE p_type || '|' || p_brand END
      || '|' || array_to_string(list_filter(string_split(p_name, ' '), lambda w: w <> lower(p_type)), '|') AS tags
    FROM part""",
)
def tag_lists(spark, d):
    raw = F.concat(
        F.array(F.concat(F.lit("  "), "p_type"), F.lit(""), F.lower("p_type"), F.lit(None).cast("string"), F.col("p_brand")),
        F.split("p_name", " "), F.array(F.upper("p_name"), F.upper("p_brand")),
    )
    # The upper-case name is a tag of its own only if the name has several words.
    cleaned = F.filter(clean_tags(raw), lambda t: t != F.upper("p_name"))
    return table(spark, d, "part").select("p_partkey", F.array_join(cleaned, "|").alias("tags"))


@check(
    "title_splits",
    """SELECT p_partkey, p_brand AS company, p_name AS position, p_type || ' - ' || p_name AS job,
      p_brand AS job_company, 'Size ' || CAST(p_size AS VARCHAR) AS job_location
    FROM part""",
)
def title_splits(spark, d):
    company, position = s.company_and_position(F.concat("p_brand", F.lit(": "), "p_name"))
    job, job_company, job_location = s.title_company_location(
        F.concat_ws(" - ", "p_type", "p_name", "p_brand", F.concat(F.lit("Size "), "p_size"))
    )
    return table(spark, d, "part").select(
        "p_partkey", company.alias("company"), position.alias("position"), job.alias("job"),
        job_company.alias("job_company"), job_location.alias("job_location"),
    )


@check(
    "slug_companies",
    """SELECT p_partkey, upper(left(p_type, 1)) || lower(substr(p_type, 2)) || ' AI' AS company,
      CAST(NULL AS VARCHAR) AS sponsored FROM part""",
)
def slug_companies(spark, d):
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    tail = F.concat(F.lit("-"), name, F.lit("-amp-sons-"), F.col("p_partkey").cast("string"))
    title = F.concat("p_name", F.lit(" & Sons"))
    return table(spark, d, "part").select(
        "p_partkey",
        s.company_from_slug(F.concat(F.lower("p_type"), F.lit("-ai"), tail), title).alias("company"),
        s.company_from_slug(F.concat(F.lit("sponsored-job"), tail), title).alias("sponsored"),
    )


@check(
    "money_labels",
    """SELECT o_orderkey,
      CASE WHEN a >= 1000000 THEN '$' || regexp_replace(printf('%.1f', a / 1000000.0), '\\.0$', '') || 'M'
        WHEN a >= 1000 THEN '$' || printf('%.0f', a / 1000.0) || 'k' WHEN a > 0 THEN '$' || CAST(a AS VARCHAR) END AS compact,
      '$' || format('{:,}', a) || '+' AS dollars, 'EUR ' || CAST(a AS VARCHAR) || '/yr' AS yearly
    FROM (SELECT o_orderkey, CAST(floor(o_totalprice) * 5 AS BIGINT) AS a FROM orders)""",
)
def money_labels(spark, d):
    amount = (F.floor("o_totalprice") * 5).cast("long")
    nothing = F.lit(None)
    return table(spark, d, "orders").select(
        "o_orderkey", s.compact_range(amount, nothing.cast("long")).alias("compact"),
        s.dollar_range(amount.cast("double"), nothing.cast("double")).alias("dollars"),
        s.currency_range(F.lit(" EUR"), amount.cast("string"), F.lit("0")).alias("yearly"),
    )


@check(
    "salary_and_place_in_text",
    with_jobs(
        """SELECT id, CASE WHEN budget LIKE '$100%' THEN budget END AS salary, location AS place,
          CASE WHEN location IS NOT NULL THEN location ELSE 'Remote' END AS card_place FROM jobs"""
    ),
)
def salary_and_place_in_text(spark, d):
    text = F.concat(
        F.lit("Pay: "), F.coalesce("budget", F.lit("open")),
        F.when(F.col("location").isNotNull(), F.concat(F.lit("\nlocation :  "), "location", F.lit(" Job Summary: more")))
        .otherwise(""),
    )
    card = F.when(F.col("location").isNotNull(), F.concat(F.lit("Remote from  "), "location", F.lit("  Full time"))).otherwise(
        "Remote work"
    )
    return jobs(spark, d).select(
        "id", s.salary_in_text(text).alias("salary"), s.location_in_text(text).alias("place"),
        s.remote_from(card).alias("card_place"),
    )


@check(
    "remote_labels",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Hybrid' WHEN o_orderstatus = 'O' THEN NULL
      ELSE 'Fully Remote' END AS label,
      CASE WHEN o_orderstatus = 'F' THEN 'Oslo' WHEN o_orderstatus = 'O' THEN 'Oslo, NO' ELSE 'Remote' END AS city
    FROM orders""",
)
def remote_labels(spark, d):
    st = F.col("o_orderstatus")
    status = F.when(st == "O", "NOT_REMOTE").otherwise("FULLY_REMOTE")
    name = F.when(st == "P", "Remote").otherwise("Oslo")
    state = F.when(st == "F", "oslo").when(st == "O", "NO").otherwise("REMOTE")
    return table(spark, d, "orders").select(
        "o_orderkey", s.remote_label(status, st == "F").alias("label"), s.city_label(name, state).alias("city")
    )


@check(
    "card_chips",
    """SELECT event_id, event_type || ' ago' AS age, '$' || CAST(user_id AS VARCHAR) AS salary,
      CAST(user_id AS VARCHAR) || ' years of exp' AS experience, 'Full-time' AS job_type,
      CASE WHEN user_id % 2 = 0 THEN 'Remote' ELSE 'Hybrid $9' END AS location FROM events""",
)
def card_chips(spark, d):
    n = F.col("user_id")
    odd = F.when(n % 2 == 0, "Remote").otherwise("Hybrid $9")
    chips = F.array(
        F.concat("event_type", F.lit(" ago")), F.concat(F.lit("$"), n), odd, F.lit("Full-time"),
        F.concat(n, F.lit(" years of exp")), F.lit("Remote, too late"), F.lit("$1"),
    )
    return table(spark, d, "events").select("event_id", classify_chips(chips).alias("c")).select("event_id", "c.*")


@check(
    "model_lists",
    """SELECT p_partkey, lower(p_type) || '|' || lower(p_brand) AS from_text,
      lower(p_type) || '|' || replace(lower(p_name), ' ', '_') AS from_list FROM part""",
)
def model_lists(spark, d):
    text = F.to_json(F.struct(F.concat_ws(", ", "p_type", "p_brand", F.upper("p_type")).alias("v")))
    items = F.array("p_type", F.replace("p_name", F.lit(" "), F.lit("_")), F.lower("p_type"))
    read = lambda j: F.try_variant_get(F.parse_json(j), "$.v", "variant")
    return table(spark, d, "part").select(
        "p_partkey", F.array_join(s.model_list(read(text), 40), "|").alias("from_text"),
        F.array_join(s.model_list(read(F.to_json(F.struct(items.alias("v")))), 12), "|").alias("from_list"),
    )


# ------------------------------------------------------------------ HTML pages
@check("html_to_text")
def html_text(spark, d):
    return page_texts(table(spark, d, "pages"))


@check(
    "html_links",
    r"""SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, href, text FROM (
      SELECT page_id, generate_subscripts(hrefs, 1) AS pos, unnest(hrefs) AS href, trim(unnest(texts)) AS text
      FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
          regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS texts FROM pages))""",
)
def html_links(spark, d):
    return page_links(table(spark, d, "pages"))


@check(
    "html_text_roundtrip",
    r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)),
      lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM documents""",
)
def html_text_roundtrip(spark, d):
    """Documents wrapped in markup come back as their own stripped lines."""
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.array_join(F.transform(F.split(safe, "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "<!-- n -->")
    page = F.concat(F.lit("<html><style>p{}</style><body>"), lines, F.lit("<script>1</script></body>"))
    return table(spark, d, "documents").select("doc_id", html_to_text(page).alias("text"))
