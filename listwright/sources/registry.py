"""Sources by name. A new source is a function from landing to raw listings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.sources import html_feeds, json_feeds, rss_feeds

Normalizer = Callable[[DataFrame], DataFrame]

NORMALIZERS: dict[str, Normalizer] = {
    "remoteok": json_feeds.remoteok,
    "remotive": json_feeds.remotive,
    "wwr": rss_feeds.wwr,
    "jobicy": json_feeds.jobicy,
    "arbeitnow": json_feeds.arbeitnow,
    "themuse": json_feeds.themuse,
    "skipthedrive": json_feeds.skipthedrive,
    "jobgether": html_feeds.jobgether,
    "underdog": json_feeds.underdog,
    "wellfound": html_feeds.wellfound,
    "builtin": json_feeds.builtin,
    "indeed": rss_feeds.indeed,
    "hn": json_feeds.hn,
    "reddit": json_feeds.reddit,
    "upwork_rss": rss_feeds.upwork,
    "linkedin_email": html_feeds.linkedin_email,
    "linkedin_web": html_feeds.linkedin_web,
    "mustakbil": html_feeds.mustakbil,
    "rozee": html_feeds.rozee,
    "bayt": html_feeds.bayt,
    "indeed_pk": rss_feeds.indeed_pk,
}


def register(source: str, normalizer: Normalizer) -> None:
    """Add a source, or replace one."""
    NORMALIZERS[source] = normalizer


def normalize(landing: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Raw listings of the given sources (all by default), as one bag.

    Every source filters the landing table by its own name, so with a table partitioned by
    source each response is read once.
    """
    names = [s for s in NORMALIZERS if sources is None or s in sources]
    return reduce(DataFrame.unionByName, [NORMALIZERS[s](landing) for s in names])


def feed_health(landing: DataFrame, raw: DataFrame) -> DataFrame:
    """(cycle_id, source, responses, failed, upstream_errors, items) of every landed source."""
    from listwright import fixed_values as fv
    from listwright.functions.text import contains_any

    ok = F.coalesce(F.col("http_status").between(200, 299), F.lit(False))
    blocked = contains_any(F.col("body"), fv.BLOCK_MARKERS)
    bug = F.try_variant_get(F.try_parse_json("body"), "$.errors[0].message", "string")
    responses = landing.groupBy("cycle_id", "source").agg(
        F.count("*").alias("responses"),
        F.count_if(~ok).alias("failed"),
        F.count_if(ok & (F.col("source") == "wellfound") & blocked).alias("blocked"),
        F.count_if(
            ok & (F.col("source") == "builtin") & F.contains(bug, F.lit(fv.UPSTREAM_BUG_MARKER))
        ).alias("upstream_errors"),
    )
    items = raw.groupBy("cycle_id", "source").agg(F.count("*").alias("items"))
    return responses.join(items, ["cycle_id", "source"], "left").withColumn(
        "items", F.coalesce("items", F.lit(0))
    )
