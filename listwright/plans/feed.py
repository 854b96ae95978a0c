"""The listing feed: facets, search, order and pages in one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright import fixed_values as fv
from listwright.operators import predicates as p
from listwright.operators.search import search
from listwright.schemas import registry
from listwright.session import written


@dataclass(frozen=True)
class FeedRequest:
    sources: list[str] | None = None
    # True: the source boxes were shown, so no box ticked means no rows.
    sources_shown: bool = False
    status: str | None = None
    min_score: int | None = None
    posted_within: int | None = None
    freelance: bool = False
    region: str | None = None
    employment: list[str] = field(default_factory=list)
    levels: list[str] = field(default_factory=list)
    max_years: int | None = None
    q: str | None = None
    # Rows scored below this go after all others.
    low_match_below: int | None = None
    page: int = 1


def matching(listings: DataFrame, request: FeedRequest, as_of: Column) -> DataFrame:
    """Rows the request asks for, with ``relevance`` (NULL without search terms).

    Conditions on plain columns come first: they reach the file scan, and the regular
    expressions see only what is left.
    """
    if request.sources_shown and not request.sources:
        rows = listings.filter(F.lit(False))
    elif request.sources:
        rows = listings.filter(F.col("source").isin(list(request.sources)))
    else:
        rows = listings
    rows = rows.filter(
        p.status_filter(request.status)
        & p.min_score(request.min_score)
        & p.posted_within(request.posted_within, as_of)
    )
    if request.freelance:
        rows = rows.filter(p.is_freelance())
    if request.region:
        rows = rows.filter(p.in_region(request.region))
    rows = rows.filter(
        p.any_employment_type(request.employment)
        & p.any_experience_level(request.levels)
        & p.max_years(request.max_years)
    )
    return search(rows, request.q)


def feed_order(request: FeedRequest) -> list[Column]:
    keys = [
        F.desc_nulls_last("relevance"),
        F.desc(F.coalesce("ai_score", F.lit(-1))),
        F.desc(p.effective_time()),
        F.desc("fetched_at"),
        F.asc("id"),
    ]
    if request.low_match_below is not None:
        keys.insert(0, F.asc(F.coalesce(F.col("ai_score") < request.low_match_below, F.lit(False))))
    return keys


def listing_feed(listings: DataFrame, request: FeedRequest, as_of: Column) -> DataFrame:
    """All matching rows in feed order."""
    return matching(listings, request, as_of).orderBy(*feed_order(request))


# So many rows are sorted for a page at most; larger ranges are divided again.
SORTED_ROWS = 10_000


def take_page(
    rows: DataFrame, order: list[Column], page: int, size: int = fv.PAGE_SIZE, key: str = "id", reads: list[str] | None = None
) -> DataFrame:
    """Page ``page`` of the ordered rows, in order; beyond the end it is the last page.

    The first page is a top-k. Any other is found by order statistics: rows are dealt into ranges of the order (by
    splitters from a sample), the ranges are counted, and only the one that holds the page is divided further and at last
    sorted. What is moved for that are ``key``, unique and not null, and the columns that the order ``reads`` (all columns
    if not given). The rows of the page are then read by their keys.
    """
    if page <= 1:
        return rows.orderBy(*order).limit(size)
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    thin = rows if reads is None else rows.select(*dict.fromkeys([key, *reads]))
    first, total = 0, None  # of the rows in ``thin``: the place of the page's first, and how many there are
    while total is None or total > max(SORTED_ROWS, 2 * size):
        dealt = written(thin.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "page-ranges")
        counts = sorted((r["_range"], r["count"]) for r in dealt.groupBy("_range").count().collect())  # one row per range
        n = sum(c for _, c in counts)
        if total is None:
            page = min(page, max(1, -(-n // size)))
            first = (page - 1) * size
        here, before, skipped = [], 0, 0
        for k, c in counts:
            if before + c <= first:
                skipped += c
            elif before < first + size:
                here.append(k)
            before += c
        shrunk = sum(c for k, c in counts if k in set(here))
        thin = dealt.filter(F.col("_range").isin(here)).drop("_range")
        first -= skipped
        if total is not None and shrunk >= total:  # equal rows cannot be divided
            break
        total = shrunk
    keys = [r[key] for r in thin.orderBy(*order).offset(first).limit(size).select(key).collect()]
    return rows.filter(F.col(key).isin(keys)).orderBy(*order).limit(size)


def feed_page(listings: DataFrame, request: FeedRequest, as_of: Column) -> DataFrame:
    reads = ["relevance", "ai_score", "posted_at", "fetched_at", "id"]
    return take_page(matching(listings, request, as_of), feed_order(request), request.page, reads=reads)


def page_info(rows: DataFrame, page: int, size: int = fv.PAGE_SIZE) -> DataFrame:
    """One row (total, pages, page), the page number clamped to what exists."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long")
    return rows.agg(F.count("*").alias("total")).select(
        "total", pages.alias("pages"),
        F.greatest(F.lit(1), F.least(F.lit(page), pages)).cast("long").alias("page"),
    )


def source_choices(listings: DataFrame) -> DataFrame:
    """Sources to offer as filters: known ones in order, then unknown ones by name."""
    known = registry(listings.sparkSession).select("source", "source_ord", "label")
    legacy = (
        listings.select("source").distinct().join(F.broadcast(known), "source", "left_anti")
        .select("source", F.lit(1_000).alias("source_ord"), F.col("source").alias("label"))
    )
    return known.unionByName(legacy).orderBy("source_ord", "source")
