"""Sources that answer with RSS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions import scalars as s
from listwright.functions.html import html_to_text
from listwright.functions.text import clean_tags, empty_to_null, strip, text_or_empty
from listwright.sources.landing import as_raw, good_responses, item_ord

_RSS = (
    "channel struct<item: array<struct<title: string, link: string, guid: string, "
    "description: string, pubDate: string, category: array<string>>>>"
)


def _feed(body: Column) -> Column:
    return F.from_xml(body, _RSS, {"mode": "PERMISSIVE"})["channel"]["item"]


def rss_items(landing: DataFrame, source: str) -> DataFrame:
    """One row per item that has a link and a title."""
    items = good_responses(landing, source).select(
        "cycle_id", "feed_key", "feed_ord", F.posexplode(_feed(F.col("body"))).alias("pos", "item")
    )
    return items.select(
        "cycle_id", "feed_key", "feed_ord", "pos",
        strip("item.link").alias("link"),
        strip("item.title").alias("title"),
        strip("item.guid").alias("guid"),
        F.col("item.description").alias("summary"),
        F.col("item.pubDate").alias("published"),
        F.col("item.category").alias("categories"),
    ).filter((text_or_empty("link") != "") & (text_or_empty("title") != ""))


def _item(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    return as_raw(
        df, source,
        external_id=F.coalesce(empty_to_null("guid"), F.col("link")),
        url=F.col("link"),
        description=html_to_text("summary"),
        posted_at=s.parse_feed_date("published"),
        item_ord=item_ord(F.col("pos")),
        **columns,
    )


def wwr(landing: DataFrame) -> DataFrame:
    company, position = s.company_and_position(F.col("title"))
    return _item(
        rss_items(landing, "wwr"), "wwr", title=position, company=company,
        tags=clean_tags(F.col("categories")),
    )


def indeed(landing: DataFrame) -> DataFrame:
    position, company, location = s.title_company_location(F.col("title"))
    return _item(
        rss_items(landing, "indeed"), "indeed", title=position, company=company, location=location
    )


def indeed_pk(landing: DataFrame) -> DataFrame:
    position, company, location = s.title_company_location(F.col("title"))
    return _item(
        rss_items(landing, "indeed_pk"), "indeed_pk", title=position, company=company,
        location=F.coalesce(location, F.lit("Pakistan")),
    )


def upwork(landing: DataFrame) -> DataFrame:
    """All saved searches; a feed that failed has no rows and a warning instead."""
    return _item(rss_items(landing, "upwork_rss"), "upwork_rss", title=F.col("title"))


def feed_warnings(landing: DataFrame) -> DataFrame:
    """(cycle_id, feed_key, warning) of saved searches that gave nothing this cycle.

    Written over last cycle's warnings, so a feed that recovers loses its warning.
    """
    status = F.col("http_status")
    login = status.isin(401, 403)
    warning = (
        F.when(status.isNull(), F.concat(F.lit("Feed error: "), text_or_empty("body")))
        .when(
            ~status.between(200, 299),
            F.concat(
                F.lit("HTTP "), status.cast("string"),
                F.when(login, " — login wall / not accessible; re-copy the RSS link from Upwork.")
                .otherwise(""),
            ),
        )
        .when(
            F.coalesce(F.size(_feed(F.col("body"))), F.lit(0)) <= 0,
            "No entries — the feed may require login, or the URL is wrong.",
        )
    )
    return (
        landing.filter(F.col("source") == "upwork_rss")
        .withColumn("warning", warning)
        .groupBy("cycle_id", "feed_key")
        .agg(F.max_by("warning", "fetched_at").alias("warning"))
        .filter("warning is not null")
    )
