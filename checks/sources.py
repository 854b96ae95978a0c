"""All sources. Responses are built from the listing fixture (50 items each), normalised by
the source under test, and compared with the values the fixture put in."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks.base import ORACLES, as_of, check, jobs, table, with_jobs
from listwright.sources import html_feeds, json_feeds, rss_feeds
from listwright.sources.landing import quarantine, read_landing, write_landing
from listwright.session import release_shuffles, remove_path, scratch_path
from listwright.sources.registry import NORMALIZERS, feed_health, normalize

PER_RESPONSE = 50
c, lit = F.col, F.lit


# ------------------------------------------------------------------ building responses
def landed(pages: DataFrame, source: str, body: Column, key: Column | None = None,
           status: Column | None = None, kind: str = "application/json") -> DataFrame:
    """Rows of (page, body parts) as landed responses."""
    return pages.select(
        lit(1).cast("long").alias("cycle_id"), lit(source).alias("source"),
        (c("page").cast("string") if key is None else key).alias("feed_key"),
        lit("http://feed.test/").alias("request_url"),
        (lit(200) if status is None else status).cast("int").alias("http_status"),
        lit(kind).alias("content_type"), as_of().alias("fetched_at"), body.alias("body"),
    )


class Dealt(str):
    """A folder of test tables of which ``rows`` are the listings, dealt out by page into buckets."""

    rows: DataFrame


def listings(spark, d):
    return d.rows if isinstance(d, Dealt) else jobs(spark, d)


#: What responses are made of.
LISTED = ["id", "url", "title", "company", "location", "tags", "budget", "description", "posted_at"]


def page_of(at: Column) -> Column:
    return F.floor(at / PER_RESPONSE).alias("page")


def wide_of(spark) -> int:
    """As many partitions as a landing table would have files: small ones are not merged."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def dealt(spark, d):
    """``d`` with the listings joined and dealt out by page once, for any number of feeds made of them."""
    path, wide = scratch_path(spark, "dealt-listings"), wide_of(spark)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    rows = jobs(spark, d).select(page_of(c("id")), *LISTED).repartition(wide, "page")
    rows.write.bucketBy(wide, "page").option("compression", "zstd").option("path", path).saveAsTable(name)
    release_shuffles(spark)
    folder = Dealt(d)
    folder.rows = spark.table(name)
    try:
        yield folder
    finally:
        spark.sql(f"DROP TABLE {name}")
        remove_path(spark, path)


def pages_of(rows: DataFrame, item: Column, separator: str = ",", order: str = "id") -> DataFrame:
    """(page, items): the items of 50 rows in order, as one text. Rows that have their page are dealt out by it."""
    at, is_dealt = c(order), "page" in rows.columns
    rows = rows.select(c("page") if is_dealt else page_of(at), at.alias("at"), item.alias("item"))
    return (
        (rows if is_dealt else rows.repartition(wide_of(rows.sparkSession), "page")).groupBy("page")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))),
                                      lambda x: x["item"]), separator).alias("items"))
    )


def escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, lit(raw), lit(safe))
    return text


def as_html(text: str = "description") -> Column:
    return F.concat(lit("<p>"), escaped(c(text)), lit("</p>"))


def obj(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def iso(ts: str = "posted_at") -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def epoch(ts: str = "posted_at") -> Column:
    return F.timestamp_diff("SECOND", lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c(ts))


odd = lambda: c("id") % 2 == 1
padded = lambda x: F.concat(lit("  "), c(x), lit(" \t"))

# ------------------------------------------------------------------ comparing
COLUMNS = ["source", "external_id", "url", "title", "company", "budget", "location", "posted_at", "item_ord"]


def shown(raw: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """Raw listings in a comparable form; long texts as hashes."""
    return raw.select(
        *[x for x in COLUMNS if x not in without],
        F.sha2("description", 256).alias("description"), F.array_join("tags", "|").alias("tags"),
    )


LINES = ("array_to_string(list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(x)), "
         "lambda x: x <> ''), chr(10))")
TEXT = LINES.format("description")
ORD = "(id // 50) * 2147483648 + id % 50"
SEC = "date_trunc('second', posted_at)"
NULLS = {"company": "CAST(NULL AS VARCHAR)", "budget": "CAST(NULL AS VARCHAR)",
         "location": "CAST(NULL AS VARCHAR)", "posted_at": "CAST(NULL AS TIMESTAMP)", "tags": "''",
         "item_ord": ORD}


def expect(source: str, where: str = "true", without: tuple[str, ...] = (), **columns: str) -> str:
    given = {**NULLS, **columns, "source": f"'{source}'"}
    given["description"] = f"sha256({given['description']})"
    out = ", ".join(f"{v} AS {k}" for k, v in given.items() if k not in without)
    return with_jobs(f"SELECT {out} FROM jobs WHERE {where}")


def source_check(name: str, sql: str | None, normalizer: Callable, without: tuple[str, ...] = ()):
    """Register ``normalize_<name>``; the decorated function builds the landing."""

    def add(build):
        @check(f"normalize_{name}", sql)
        def run(spark, d):
            return shown(normalizer(build(spark, d)), without)

        BUILDERS[name] = build
        return build

    return add


BUILDERS: dict[str, Callable] = {}
TAGS_SQL = "replace(tags_csv, ',', '|')"


# ------------------------------------------------------------------ JSON
@source_check(
    "remoteok",
    expect(
        "remoteok", external_id="CAST(id AS VARCHAR)", url="url", title="title", company="company",
        description=TEXT, tags=TAGS_SQL, location="location", posted_at=SEC,
        budget="'$' || format('{:,}', 50000 + id) || CASE WHEN id % 3 = 0 THEN '+' ELSE ' - $' || format('{:,}', 90000 + id) END",
        item_ord=ORD + " + 1",
    ),
    json_feeds.remoteok,
)
def remoteok(spark, d):
    item = obj(
        id=c("id"), slug=lit("x"), url=F.when(odd(), c("url")).otherwise(""), apply_url=c("url"),
        position=F.when(odd(), padded("title")), title=padded("title"), company=F.coalesce("company", lit(" ")),
        description=as_html(), tags=F.concat("tags", F.transform("tags", lambda t: F.upper(t)), F.array(lit(" "))),
        salary_min=50000 + c("id"), salary_max=F.when(c("id") % 3 != 0, 90000 + c("id")),
        location=c("location"), date=F.when(odd(), F.concat(iso(), lit("Z"))),
        epoch=F.when(~odd(), epoch()),
    )
    pages = pages_of(listings(spark, d), item)
    return landed(pages, "remoteok", F.concat(lit('[{"legal": "terms"},'), "items", lit("]")))


@source_check(
    "remotive",
    expect("remotive", external_id="CAST(id AS VARCHAR)", url="url", title="title", company="company",
           description=TEXT, tags=TAGS_SQL, budget="budget", location="location", posted_at=SEC),
    json_feeds.remotive,
)
def remotive(spark, d):
    item = obj(
        id=c("id"), url=c("url"), title=padded("title"), company_name=c("company"), description=as_html(),
        tags=c("tags"), salary=F.coalesce("budget", lit("")), candidate_required_location=c("location"),
        publication_date=iso(),
    )
    return landed(pages_of(listings(spark, d), item), "remotive", F.concat(lit('{"jobs": ['), "items", lit("]}")))


@source_check(
    "jobicy",
    expect("jobicy", external_id="CAST(id AS VARCHAR)", url="url", title="title", company="company",
           description=TEXT, location="location", posted_at=SEC,
           budget="""CASE id % 3 WHEN 0 THEN 'EUR ' || CAST(id + 1 AS VARCHAR) || '-' || CAST(id + 9 AS VARCHAR) || '/yr'
             WHEN 1 THEN CAST(id + 9 AS VARCHAR) || '/yr' END""",
           tags="""CASE WHEN id % 2 = 1 THEN 'Tech|full-time' WHEN tags_csv = '' THEN 'full-time'
             WHEN tags_csv = 'Full-time,Python' THEN 'Full-time|Python' ELSE replace(tags_csv, ',', '|') || '|full-time' END"""),
    json_feeds.jobicy,
)
def jobicy(spark, d):
    # jobIndustry is one text or a list, which to_json cannot express: written as two shapes.
    shape = lambda industry: obj(
        id=c("id"), url=c("url"), jobTitle=c("title"), companyName=c("company"), jobGeo=c("location"),
        jobIndustry=industry, jobType=lit("full-time"),
        annualSalaryMin=F.when(c("id") % 3 == 0, c("id") + 1),
        annualSalaryMax=F.when(c("id") % 3 < 2, c("id") + 9),
        salaryCurrency=F.when(c("id") % 3 == 0, " EUR").otherwise(""),
        jobDescription=F.when(odd(), as_html()), jobExcerpt=as_html(), pubDate=iso(),
    )
    item = F.when(odd(), shape(lit("Tech"))).otherwise(shape(c("tags")))
    return landed(pages_of(listings(spark, d), item), "jobicy", F.concat(lit('{"jobs": ['), "items", lit("]}")))


@source_check(
    "arbeitnow",
    expect("arbeitnow", "id % 4 <> 0",
           external_id="CASE WHEN id % 2 = 1 THEN 'slug-' || CAST(id AS VARCHAR) ELSE url END", url="url",
           title="title", company="company", description=TEXT, location="location", posted_at=SEC,
           tags="CASE WHEN tags_csv = '' THEN '' ELSE replace(tags_csv, ',', '|') || '|' END || 'Contract|remote'"),
    json_feeds.arbeitnow,
)
def arbeitnow(spark, d):
    item = obj(
        slug=F.when(odd(), F.concat(lit("slug-"), "id")), url=c("url"), title=c("title"), company_name=c("company"),
        remote=c("id") % 4 != 0, tags=c("tags"), job_types=lit("Contract"), location=c("location"),
        description=as_html(), created_at=epoch(),
    )
    return landed(pages_of(listings(spark, d), item), "arbeitnow", F.concat(lit('{"data": ['), "items", lit("]}")))


@source_check(
    "themuse",
    expect("themuse", "location IS NULL OR location = 'Remote (US)'", external_id="CAST(id AS VARCHAR)", url="url",
           title="title", company="company", description=TEXT, posted_at=SEC,
           location="CASE WHEN location IS NOT NULL THEN 'Oslo, ' || location END",
           tags="CASE WHEN tags_csv = '' THEN '' ELSE replace(tags_csv, ',', '|') || '|' END || 'Software'"),
    json_feeds.themuse,
)
def themuse(spark, d):
    named = lambda x: F.struct(x.alias("name"))
    item = obj(
        id=c("id"), name=padded("title"), contents=as_html(), refs=F.struct(c("url").alias("landing_page")),
        locations=F.when(c("location").isNotNull(), F.array(named(lit("Oslo")), named(lit("")), named(c("location")))),
        company=named(c("company")), levels=F.transform("tags", named),
        categories=F.array(named(lit("Software"))), publication_date=F.concat(iso(), lit("Z")),
    )
    return landed(pages_of(listings(spark, d), item), "themuse", F.concat(lit('{"results": ['), "items", lit("]}")))


@source_check(
    "skipthedrive",
    expect("skipthedrive", external_id="CAST(id AS VARCHAR)", url="trim(url)", title="title || ' & More'",
           company="CASE WHEN company IS NOT NULL THEN 'Acme AI' END",
           description=LINES.format("'Pay $' || CAST(50 + id % 7 AS VARCHAR) || ' – $110/hour' || chr(10) || 'Location: ' || "
                                    "coalesce(location, '') || ' Job Summary: x' || chr(10) || description"),
           budget="'$' || CAST(50 + id % 7 AS VARCHAR) || ' – $110/hour'",
           # Without a place the next heading is all there is behind the label.
           location="coalesce(location, 'Job Summary: x')", posted_at=SEC),
    json_feeds.skipthedrive,
)
def skipthedrive(spark, d):
    wrapped = lambda x: F.struct(x.alias("rendered"))
    slug_title = F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-")
    slug = F.concat(F.when(c("company").isNotNull(), "acme-ai-").otherwise(""), slug_title, lit("-amp-more-"), "id")
    content = F.concat(
        lit("<p>Pay $"), 50 + c("id") % 7, lit(" &#8211; $110/hour</p><p>Location: "),
        F.coalesce("location", lit("")), lit(" Job Summary: x</p>"), as_html(),
    )
    item = obj(id=c("id"), link=c("url"), slug=slug, date_gmt=iso(), title=wrapped(F.concat("title", lit(" &amp;  More"))),
               content=wrapped(content))
    return landed(pages_of(listings(spark, d), item), "skipthedrive", F.concat(lit("["), "items", lit("]")))


_MONEY = """'$' || CAST(20 + id % 5 AS VARCHAR) || 'k'"""


@source_check(
    "underdog",
    expect("underdog", "id % 5 <> 2 AND id % 10 <> 9", external_id="CAST(id AS VARCHAR)",
           url="'https://underdog.io/jobs/s-' || CAST(id AS VARCHAR)", title="title", description=TEXT,
           budget=f"CASE id % 3 WHEN 0 THEN {_MONEY} || ' – $1.5M' WHEN 1 THEN {_MONEY} ELSE '$900' END",
           location="CASE WHEN location IS NOT NULL THEN 'Oslo, NO, Remote' END",
           tags=TAGS_SQL, posted_at="posted_at"),
    json_feeds.underdog,
)
def underdog(spark, d):
    low = (20 + c("id") % 5) * 1000
    city = lambda name, state: F.struct(lit(name).alias("name"), lit(state).alias("state_abbreviation"))
    # Every tenth row repeats the address of the row before it.
    slug = F.concat(lit("s-"), F.when(c("id") % 10 == 9, c("id") - 1).otherwise(c("id")))
    item = obj(
        id=c("id"), title=c("title"), description=as_html(), slug=slug, webflow_slug=F.when(odd(), slug).otherwise(""),
        min_salary=F.when(c("id") % 3 < 2, low).otherwise(0),
        max_salary=F.when(c("id") % 3 == 0, lit(1_500_000)).when(c("id") % 3 == 1, low).otherwise(900),
        objCategories=F.transform("tags", lambda t: F.struct(t.alias("name"))),
        objCities=F.when(c("location").isNotNull(), F.array(city("Oslo", "NO"), city(" ", "X"), city("Remote", "REMOTE"))),
        created_at=c("posted_at").cast("string"), is_expired=c("id") % 5 == 2,
    )
    body = F.concat(lit('{"error": false, "objJobs": ['), "items", lit('], "pagination": {"pages": 9}}'))
    return landed(pages_of(listings(spark, d), item), "underdog", body)


@source_check(
    "builtin",
    expect("builtin", "(id // 50) % 4 <> 1", external_id="CAST(id AS VARCHAR)",
           url="'https://builtin.com/job/' || CAST(id AS VARCHAR)", title="title", company="company",
           description=f"concat_ws(chr(10), nullif({TEXT}, ''), CASE WHEN id % 3 = 0 THEN 'Hybrid · Senior' ELSE 'Fully Remote · Senior' END)",
           tags="CASE WHEN id % 3 = 0 THEN 'Hybrid|Senior' ELSE 'Fully Remote|Senior' END",
           location="coalesce(location, 'Oslo')"),
    json_feeds.builtin,
)
def builtin(spark, d):
    path = F.concat(lit("/job/"), "id")
    item = obj(
        id=c("id"), title=padded("title"), url=F.when(odd(), path).otherwise(F.concat(lit("https://builtin.com"), path)),
        location=F.coalesce("location", lit("")), originalLocation=lit("Oslo"), remoteStatus=lit("FULLY_REMOTE"),
        experienceLevel=lit("Senior"), isHybrid=c("id") % 3 == 0, bodySummary=as_html(),
        company=F.struct(c("company").alias("name")),
    )
    good = F.concat(lit('{"data": {"customFilteredJobs": {"customFilteredJobs": ['), "items", lit("]}}}"))
    bad = F.concat(lit('{"errors": [{"message": "name ats_details"}], "data": {"customFilteredJobs": {"customFilteredJobs": ['),
                   "items", lit("]}}}"))
    return landed(pages_of(listings(spark, d), item), "builtin", F.when(c("page") % 4 == 1, bad).otherwise(good))


@source_check(
    "reddit",
    expect("reddit", "id % 3 <> 2", ("item_ord",), external_id="CAST(id AS VARCHAR)",
           url="CASE WHEN id % 2 = 1 THEN 'https://www.reddit.com/r/x/' || CAST(id AS VARCHAR) ELSE url END",
           title="'[HIRING] ' || title", company="CASE WHEN company IS NOT NULL THEN 'u/' || company END",
           description=f"CASE WHEN id % 3 = 0 THEN {TEXT} ELSE '[HIRING] ' || title END",
           tags="CASE WHEN (id // 50) % 2 = 0 THEN 'forhire' ELSE 'remotejs' END || CASE WHEN id % 2 = 1 THEN '|Paid' ELSE '' END",
           posted_at=SEC),
    json_feeds.reddit, ("item_ord",),
)
def reddit(spark, d):
    post = F.struct(
        c("id").cast("string").alias("id"),
        F.concat(F.when(c("id") % 3 != 2, "[HIRING] ").otherwise("[For hire] "), "title").alias("title"),
        F.when(odd(), F.concat(lit("/r/x/"), "id")).alias("permalink"), c("url"), c("company").alias("author"),
        F.when(odd(), "Paid").alias("link_flair_text"), lit(" ").alias("selftext"),
        F.when(c("id") % 3 == 0, as_html()).alias("selftext_html"), epoch().alias("created_utc"),
    )
    pages = pages_of(listings(spark, d), F.to_json(F.struct(post.alias("data"))))
    key = F.when(c("page") % 2 == 0, "forhire").otherwise("remotejs")
    return landed(pages, "reddit", F.concat(lit('{"data": {"children": ['), "items", lit("]}}")), key)


_COMMENT = "(CASE WHEN conv_id % 2 = 0 THEN 'Acme | REMOTE' ELSE 'Acme | Oslo' END || chr(10) || text)"


@source_check(
    "hn",
    f"""SELECT 'hn' AS source, CAST(conv_id * 1000 + turn + 1 AS VARCHAR) AS external_id,
      'https://news.ycombinator.com/item?id=' || CAST(conv_id * 1000 + turn + 1 AS VARCHAR) AS url,
      string_split({LINES.format(_COMMENT)}, chr(10))[1] AS title,
      string_split({LINES.format(_COMMENT)}, chr(10))[1] AS company,
      CAST(NULL AS VARCHAR) AS budget, CAST(NULL AS VARCHAR) AS location,
      TIMESTAMP '2024-01-02 03:04:05' AS posted_at, sha256({LINES.format(_COMMENT)}) AS description, '' AS tags
    FROM conversations WHERE contains(lower({_COMMENT}), 'remote')""",
    json_feeds.hn, ("item_ord",),
)
def hn(spark, d):
    """All turns as top-level comments of the newest thread, plus threads that lose."""
    comments = table(spark, d, "conversations").withColumn("number", c("conv_id") * 1000 + c("turn"))
    text = F.concat(F.when(c("conv_id") % 2 == 0, "Acme | REMOTE\n").otherwise("Acme | Oslo\n"), "text")
    item = obj(id=c("number") + 1, text=F.concat(lit("<p>"), escaped(text)), created_at=lit("2024-01-02T03:04:05Z"))
    pages = pages_of(comments, item, order="number")
    children = F.concat(lit('{"children": ['), "items", lit("]}"))
    thread = landed(pages, "hn", children, lit("900"))
    other = landed(pages, "hn", children, lit("901"))
    hits = lit(
        '{"hits": [{"objectID": "901", "author": "somebody", "title": "Ask HN: Who is hiring right now?"},'
        '{"objectID": "902", "author": "whoishiring", "title": "Ask HN: Who wants to be hired?"},'
        '{"objectID": "900", "author": "whoishiring", "title": "Ask HN: Who is hiring? (January)"}]}'
    )
    search = landed(pages.filter("page = 0"), "hn", hits, lit("search"))
    return thread.unionByName(other).unionByName(search)


# ------------------------------------------------------------------ RSS
def rss(pages: DataFrame, source: str, **kw) -> DataFrame:
    head = '<?xml version="1.0"?><rss version="2.0"><channel><title>Feed</title>'
    return landed(pages, source, F.concat(lit(head), "items", lit("</channel></rss>")), kind="application/rss+xml", **kw)


def rss_item(title: Column, *more: Column) -> Column:
    date = F.coalesce(
        F.concat(lit("<pubDate>"), F.date_format("posted_at", "EEE, dd MMM yyyy HH:mm:ss"), lit(" GMT</pubDate>")), lit("")
    )
    guid = F.when(odd(), F.concat(lit('<guid isPermaLink="false">g'), "id", lit("</guid>"))).otherwise("")
    return F.concat(
        lit("<item><title>"), escaped(title), lit("</title><link>"), F.trim("url"), lit("</link>"), guid, date,
        lit("<description>"), escaped(as_html()), lit("</description>"), *more, lit("</item>"),
    )


_GUID = "CASE WHEN id % 2 = 1 THEN 'g' || CAST(id AS VARCHAR) ELSE trim(url) END"


@source_check(
    "wwr",
    expect("wwr", external_id=_GUID, url="trim(url)", title="title", company="company", description=TEXT,
           tags=TAGS_SQL, posted_at=SEC),
    rss_feeds.wwr,
)
def wwr(spark, d):
    title = F.when(c("company").isNotNull(), F.concat("company", lit(": "), "title")).otherwise(c("title"))
    tags = F.array_join(F.transform("tags", lambda t: F.concat(lit("<category>"), t, lit("</category>"))), "")
    return rss(pages_of(listings(spark, d), rss_item(title, tags), ""), "wwr")


def _indeed(spark, d, source):
    title = F.concat_ws(" - ", F.concat("title", lit(" - R&D")), F.coalesce("company", lit("Hidden")), "location")
    return rss(pages_of(listings(spark, d), rss_item(title), ""), source)


# Without a location the title has two cuts only, so its parts move one place to the left.
_INDEED = dict(
    external_id=_GUID, url="trim(url)", description=TEXT, posted_at=SEC,
    title="CASE WHEN location IS NULL THEN title ELSE title || ' - R&D' END",
    company="CASE WHEN location IS NULL THEN 'R&D' ELSE coalesce(company, 'Hidden') END",
    location="CASE WHEN location IS NULL THEN coalesce(company, 'Hidden') ELSE location END",
)


@source_check("indeed", expect("indeed", **_INDEED), rss_feeds.indeed)
def indeed(spark, d):
    return _indeed(spark, d, "indeed")


@source_check(
    "indeed_pk",
    expect("indeed_pk", **{**_INDEED, "title": "title", "company": "company", "location": "'Pakistan'"}),
    rss_feeds.indeed_pk,
)
def indeed_pk(spark, d):
    title = F.concat_ws(" - ", "title", "company")
    return rss(pages_of(listings(spark, d), rss_item(title), ""), "indeed_pk")


@source_check(
    "upwork_rss",
    expect("upwork_rss", "(id // 50) % 5 NOT IN (1, 2, 3)", external_id=_GUID, url="trim(url)", title="title",
           description=TEXT, posted_at=SEC),
    rss_feeds.upwork,
)
def upwork_rss(spark, d):
    pages = pages_of(listings(spark, d), rss_item(c("title")), "")
    pages = pages.withColumn("items", F.when(c("page") % 5 == 3, "").otherwise(c("items")))
    status = F.when(c("page") % 5 == 1, 403).when(c("page") % 5 == 2, 500).otherwise(200)
    return rss(pages, "upwork_rss", status=status)


@check(
    "upwork_feed_warnings",
    with_jobs(
        """SELECT CAST(1 AS BIGINT) AS cycle_id, CAST(page AS VARCHAR) AS feed_key, CASE page % 5
            WHEN 1 THEN 'HTTP 403 — login wall / not accessible; re-copy the RSS link from Upwork.'
            WHEN 2 THEN 'HTTP 500' ELSE 'No entries — the feed may require login, or the URL is wrong.' END AS warning
        FROM (SELECT DISTINCT id // 50 AS page FROM jobs) WHERE page % 5 IN (1, 2, 3)"""
    ),
)
def upwork_feed_warnings(spark, d):
    return rss_feeds.feed_warnings(upwork_rss(spark, d))


# ------------------------------------------------------------------ HTML
def web(pages: DataFrame, source: str) -> DataFrame:
    body = F.concat(lit("<!DOCTYPE html><html><body><main>"), "items", lit("</main></body></html>"))
    return landed(pages, source, body, kind="text/html")


def elements(items: Column, before: str, after: str) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(lit(before), x, lit(after))), "")


def span(cls: str, x: Column, tag: str = "span") -> Column:
    return F.coalesce(F.concat(lit(f'<{tag} class="{cls}">'), x, lit(f"</{tag}>")), lit(""))


_DAYS_AGO = "TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(id % 9 + 1 AS INTEGER))"
_CARD_TAGS = """CASE WHEN tags_csv IN ('Full-time,Python') THEN 'Python' ELSE replace(tags_csv, ',', '|') END"""


@source_check(
    "jobgether",
    expect("jobgether", external_id="CAST(id AS VARCHAR)", url="'https://jobgether.com/offer/' || CAST(id AS VARCHAR) || '-x'",
           title="title", company="coalesce(company, '')",
           description=f"concat_ws(' · ', title, company, coalesce(location, 'Remote'), 'Full Time', '$50k', concat_ws(', ', nullif(replace({_CARD_TAGS}, '|', ', '), ''), 'Full Time'))",
           tags=f"concat_ws('|', nullif({_CARD_TAGS}, ''), 'Full Time')", budget="'$50k'",
           location="coalesce(location, 'Remote')", posted_at=_DAYS_AGO),
    html_feeds.jobgether,
)
def jobgether(spark, d):
    href = F.concat(lit("/offer/"), "id", lit("-x"))
    chips = elements(F.transform("tags", lambda t: F.concat(t, lit('"><div class="tip line-clamp-1">'), t)),
                     '<a href="/remote-jobs/', "</div></a>")
    item = F.concat(
        lit('<div class="card"><div><a class="t" href="'), href, lit('?ref=1">'), "title", lit("</a><div>"),
        c("id") % 9 + 1, lit(" days ago</div></div><p><a href='/remote-jobs/company-x'>"), F.coalesce("company", lit("")),
        lit("</a></p><div>"), F.coalesce(F.concat(lit("Remote from <i>"), "location", lit("</i>")), lit("Remote ok")),
        lit("</div><div>Full timers welcome</div><span>$50k</span>"), chips, lit("</div>"),
    )
    return web(pages_of(listings(spark, d), item, ""), "jobgether")


@source_check(
    "wellfound",
    expect("wellfound", external_id="CAST(id AS VARCHAR)", url="'https://wellfound.com/jobs/' || CAST(id AS VARCHAR) || '-x'",
           title="title", company="coalesce(company, 'Stealth')",
           description="concat_ws(' · ', title, coalesce(company, 'Stealth'), 'Tools for very small teams', 'Remote only', 'Full-time', '$' || CAST(id AS VARCHAR) || 'k', '4 years of exp')",
           tags="'Full-time|4 years of exp'", budget="'$' || CAST(id AS VARCHAR) || 'k'", location="'Remote only'",
           posted_at=_DAYS_AGO),
    html_feeds.wellfound,
)
def wellfound(spark, d):
    name = F.when(c("company").isNotNull(), F.concat(lit('<a href="/company/x">'), "company", lit("</a>"))).otherwise(
        "<a href='/company/y'><img></a><h2>Stealth</h2>"
    )
    item = F.concat(
        lit('<section><div><div data-testid="startup-header">'), name,
        lit("<span>Tools for very small teams</span><span>11-50 Employees</span></div></div><div><div><div><a href='/jobs/"),
        c("id"), lit("-x?s=1'>"), "title", lit("</a><span>Full-time</span></div><div><span>$"), c("id"),
        lit("k</span></div><div><span>Remote only</span></div><div><span>4 years of exp</span></div><span>"),
        c("id") % 9 + 1, lit(" days ago</span></div></div></section>"),
    )
    return web(pages_of(listings(spark, d), item, ""), "wellfound")


@source_check(
    "linkedin_email",
    expect("linkedin_email", external_id="CAST(1000 + id AS VARCHAR)",
           url="'https://www.linkedin.com/jobs/view/' || CAST(1000 + id AS VARCHAR) || '/'", title="title",
           company="coalesce(company, 'View job')",
           description="title || coalesce(chr(10) || company || ' · Oslo', '') || chr(10) || 'View job'",
           item_ord="(id // 50) * 2147483648 + 2 * (id % 50)"),
    html_feeds.linkedin_email,
)
def linkedin_email(spark, d):
    link = F.concat(lit('<a href="https://x.test/comm/jobs/view/'), 1000 + c("id"), lit('?t=1">'))
    item = F.concat(
        lit("<table><tr><td>"), link, "title", lit("</a><br>"),
        F.coalesce(F.concat(lit("<p>"), "company", lit(" · Oslo</p>")), lit("")), link, lit("View job</a></td></tr></table>"),
    )
    return web(pages_of(listings(spark, d), item, ""), "linkedin_email")


@source_check(
    "linkedin_web",
    expect("linkedin_web", external_id="'dev-' || CAST(id AS VARCHAR)", url="'https://l.test/jobs/view/dev-' || CAST(id AS VARCHAR)",
           title="title", company="company", description="concat_ws(' · ', title, company, location)", location="location",
           posted_at="CAST(CAST(posted_at AS DATE) AS TIMESTAMP)"),
    html_feeds.linkedin_web,
)
def linkedin_web(spark, d):
    time = F.coalesce(F.concat(lit('<time datetime="'), F.date_format("posted_at", "yyyy-MM-dd"), lit('">x</time>')), lit(""))
    item = F.concat(
        lit('<li><div class="base-card y"><a class="base-card__full-link" href="https://l.test/jobs/view/dev-'), c("id"),
        lit('?a=1"></a><h3 class="base-search-card__title"> '), "title", lit(" </h3>"),
        span("base-search-card__subtitle", c("company"), "h4"), span("job-search-card__location", c("location")), time,
        lit("</div></li>"),
    )
    return web(pages_of(listings(spark, d), item, ""), "linkedin_web")


@source_check(
    "mustakbil",
    expect("mustakbil", external_id="CAST(id AS VARCHAR)", url="'https://www.mustakbil.com/job/' || CAST(id AS VARCHAR)",
           title="title", company="company", budget="budget", location="coalesce(location, 'Pakistan')",
           description="concat_ws(' · ', 'Short text', nullif(replace(tags_csv, ',', ' · '), ''), 'Experience: 3 Years')",
           tags="concat_ws('|', nullif(replace(tags_csv, ',', '|'), ''), '3 Years')"),
    html_feeds.mustakbil,
)
def mustakbil(spark, d):
    item = F.concat(
        lit('<article><a class="jl-title__link" href="/job/'), c("id"), lit('"><i class="icon">work</i>'), "title", lit("</a>"),
        span("jl-company__name", c("company")), span("jl-location", F.concat(lit('<i class="icon">place</i>'), "location"), "p"),
        span("jl-salary", c("budget")), elements(c("tags"), '<span class="jl-chip">', "</span>"),
        lit('<span class="jl-chip"><i class="icon">time</i>3 Years</span><p class="jl-desc">Short text</p></article>'),
    )
    return web(pages_of(listings(spark, d), item, ""), "mustakbil")


@source_check(
    "rozee",
    expect("rozee", external_id="'https://www.rozee.pk/x-jobs-' || CAST(10000 + id AS VARCHAR)",
           url="'https://www.rozee.pk/x-jobs-' || CAST(10000 + id AS VARCHAR)", title="title || ' wanted'", company="company",
           description="title || ' wanted'", location="CASE WHEN location LIKE 'Lahore%' THEN location ELSE 'Pakistan' END"),
    html_feeds.rozee,
)
def rozee(spark, d):
    item = F.concat(
        lit("<li><a href='/x-jobs-"), 10000 + c("id"), lit("?p=1'>"), "title", lit(" <b>wanted</b></a><p>"),
        F.coalesce("company", lit("Posted today")), lit("</p>"), F.coalesce(F.concat(lit("<p>"), "location", lit("</p>")), lit("")),
        lit("<p>more</p></li><a href='/x-jobs-77'>Category link</a>"),
    )
    return web(pages_of(listings(spark, d), item, ""), "rozee")


@source_check(
    "bayt",
    expect("bayt", external_id="'https://www.bayt.com/en/pakistan/jobs/x-' || CAST(10000 + id AS VARCHAR)",
           url="'https://www.bayt.com/en/pakistan/jobs/x-' || CAST(10000 + id AS VARCHAR)", title="title || ' wanted'",
           company="company", description="title || ' wanted'", location="'Pakistan'"),
    html_feeds.bayt,
)
def bayt(spark, d):
    firm = F.when(odd(), F.concat(lit('<div class="jb-Company">'), "company", lit("</div>"))).otherwise(
        F.concat(lit("<b>"), "company", lit("</b>"))
    )
    item = F.concat(
        lit("<li><h2><a href='/en/pakistan/jobs/x-"), 10000 + c("id"), lit("'><b>"), "title", lit("</b> wanted</a></h2>"),
        F.coalesce(firm, lit("")), lit("</li><a href='/en/pakistan/jobs/?page=20000'>next page</a>"),
    )
    return web(pages_of(listings(spark, d), item, ""), "bayt")


# ------------------------------------------------------------------ all together
@check(
    "source_caps",
    with_jobs("SELECT 'rozee' AS source, CAST(least(50, count(*)) AS BIGINT) AS n FROM jobs UNION ALL "
              "SELECT 'builtin', CAST(least(40, count(*)) AS BIGINT) FROM jobs WHERE (id // 50) % 4 <> 1"),
)
def source_caps(spark, d):
    """Caps are given by who wants them; nothing is capped otherwise."""
    raw = html_feeds.rozee(rozee(spark, d), 50).unionByName(json_feeds.builtin(builtin(spark, d), 40))
    return raw.groupBy("source").agg(F.count("*").alias("n"))


ALL_JSON = ["remoteok", "remotive", "jobicy", "arbeitnow", "themuse", "underdog"]


def all_landing(spark, d, names=ALL_JSON):
    from functools import reduce

    return reduce(DataFrame.unionByName, [BUILDERS[n](spark, d) for n in names])


#: Every source with a landing of its own here, against the rows that its own SQL gives.
ALL_SOURCES = [n for n in BUILDERS if f"normalize_{n}" in ORACLES]


@check(
    "normalize_all",
    " UNION ALL ".join(
        f"""SELECT source, count(*) AS n, bit_xor(CAST('0x' || substr(sha256(concat_ws('|', url, title)), 1, 15) AS BIGINT)) AS rows_hash
        FROM ({ORACLES[f'normalize_{n}']}) GROUP BY source""" for n in ALL_SOURCES
    ),
)
def normalize_all(spark, d):
    """One source after the other: what it landed goes when its rows are counted, before the next one lands."""
    counted = []
    with dealt(spark, d) as folder:
        for name in ALL_SOURCES:
            path = scratch_path(spark, "all-landing")
            write_landing(BUILDERS[name](spark, folder), path)
            counted += counts_by_source(read_landing(spark, path))
            remove_path(spark, path)
            release_shuffles(spark)
    return spark.createDataFrame(counted, "source string, n long, rows_hash long")


def counts_by_source(landing: DataFrame) -> list:
    """(source, n, rows_hash) of the rows of every source that has landed something."""
    names = [r["source"] for r in landing.select("source").distinct().collect()]
    if not names:
        return []
    rows = shown(normalize(landing, names))
    text = F.concat_ws("|", "url", "title")
    number = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.bit_xor(number).alias("rows_hash")).collect()


@check(
    "feed_health",
    with_jobs(
        """SELECT CAST(1 AS BIGINT) AS cycle_id, source, responses, failed, CAST(0 AS BIGINT) AS blocked, upstream_errors, items FROM (
          SELECT 'upwork_rss' AS source, count(DISTINCT id // 50) AS responses,
            count(DISTINCT CASE WHEN (id // 50) % 5 IN (1, 2) THEN id // 50 END) AS failed, CAST(0 AS BIGINT) AS upstream_errors,
            count(*) FILTER ((id // 50) % 5 NOT IN (1, 2, 3)) AS items FROM jobs
          UNION ALL SELECT 'builtin', count(DISTINCT id // 50), 0,
            count(DISTINCT CASE WHEN (id // 50) % 4 = 1 THEN id // 50 END), count(*) FILTER ((id // 50) % 4 <> 1) FROM jobs)"""
    ),
)
def health(spark, d):
    landing = all_landing(spark, d, ["upwork_rss", "builtin"])
    raw = rss_feeds.upwork(landing).unionByName(json_feeds.builtin(landing))
    return feed_health(landing, raw)


@check(
    "source_failures",
    with_jobs(
        """SELECT CAST(1 AS BIGINT) AS cycle_id, 's' || CAST(page % 7 AS VARCHAR) AS source,
          CASE WHEN page % 7 IN (1, 4) THEN 'blocked' ELSE 'failed' END AS error_class,
          CASE WHEN page % 7 IN (1, 4) THEN 'HTTP 403' ELSE 'HTTP 500' END AS error
        FROM (SELECT DISTINCT id AS page FROM jobs) WHERE page % 7 IN (1, 2, 4) GROUP BY ALL"""
    ),
)
def failures(spark, d):
    from listwright.plans.ingest import source_failures

    rows = jobs(spark, d).select(c("id").alias("page"))
    status = F.when((c("page") % 7).isin(1, 4), 403).when(c("page") % 7 == 2, 500).otherwise(200)
    landing = landed(rows, "x", lit("{}"), status=status)
    return source_failures(landing.withColumn("source", F.concat(lit("s"), c("feed_key").cast("long") % 7)))


@check(
    "quarantine",
    with_jobs("SELECT CAST(id AS VARCHAR) AS feed_key, 'body is not JSON' AS reason FROM jobs WHERE id % 3 = 1"),
)
def quarantined(spark, d):
    rows = jobs(spark, d).select(c("id").alias("page"), "description")
    body = F.when(c("page") % 3 == 1, F.concat(lit("<oops> "), "description")).otherwise(obj(x=c("description")))
    return quarantine(landed(rows, "remotive", body)).select("feed_key", "reason")
