"""Activity statistics: listings per source and day, applications per week, funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright import fixed_values as fv
from listwright.schemas import source_color, source_label


def _counts_by(rows: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """(keys, counts) with ``counts`` a map bucket -> rows. At most one entry per bucket of
    the reporting period, so the map is small whatever the table size."""
    counted = rows.groupBy(*keys, bucket).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(bucket, "n"))).alias("counts")
    )


def listings_per_source_day(listings: DataFrame, as_of: Column, days: int = fv.STATS_DAYS) -> DataFrame:
    """Zero-filled (source, day, n) of the last days for every source seen in them."""
    last = F.to_date(as_of)
    first = F.date_sub(last, days - 1)
    day = F.to_date("fetched_at")
    # The lower bound is a plain comparison, so it reaches the scan.
    recent = listings.filter((F.col("fetched_at") >= first.cast("timestamp_ntz")) & (day <= last))
    per_source = _counts_by(recent.select("source", day.alias("day")), ["source"], "day")
    chart = F.array_position(F.array(*map(F.lit, fv.CHART_ORDER)), F.col("source"))
    return per_source.select(
        "source",
        source_label(F.col("source")).alias("label"),
        source_color(F.col("source")).alias("color"),
        F.when(chart > 0, chart).otherwise(len(fv.CHART_ORDER) + 1).cast("int").alias("chart_ord"),
        F.explode(F.sequence(first, last)).alias("day"),
        "counts",
    ).select(
        "source", "label", "color", "chart_ord", "day",
        F.coalesce(F.try_element_at("counts", F.col("day")), F.lit(0)).alias("n"),
    )


def applications_per_week(listings: DataFrame, as_of: Column, weeks: int = fv.STATS_WEEKS) -> DataFrame:
    """Zero-filled (week, n) of the last weeks; weeks start on Monday."""
    this_week = F.to_date(F.date_trunc("week", as_of))
    first = F.date_sub(this_week, 7 * (weeks - 1))
    week = F.to_date(F.date_trunc("week", F.col("applied_at")))
    recent = listings.filter(
        (F.col("applied_at") >= first.cast("timestamp_ntz")) & (week <= this_week)
    )
    counts = _counts_by(recent.select(week.alias("week")), [], "week")
    return counts.select(
        F.explode(F.sequence(first, this_week, F.expr("interval 7 days"))).alias("week"), "counts"
    ).select("week", F.coalesce(F.try_element_at("counts", F.col("week")), F.lit(0)).alias("n"))


def funnel(listings: DataFrame, threshold: int | None = fv.DEFAULT_ALERT_THRESHOLD) -> DataFrame:
    """All funnel numbers in one pass. A threshold of 0 means the default here."""
    threshold = threshold or fv.DEFAULT_ALERT_THRESHOLD
    status = F.col("status")
    counts = listings.agg(
        F.count("*").alias("total_jobs"),
        F.count("ai_score").alias("scored_jobs"),
        F.count_if(F.col("ai_score") >= threshold).alias("high_fit"),
        F.count_if(
            F.col("applied_at").isNotNull() | status.isin(fv.APPLIED_OR_BEYOND)
        ).alias("applied"),
        F.count_if(status.isin(fv.REPLIED_STATUSES)).alias("replied"),
        F.count_if(status.isin(fv.INTERVIEW_STATUSES)).alias("interviews"),
    )
    rate = lambda c: F.when(
        F.col("applied") > 0, F.bround(100.0 * F.col(c) / F.col("applied"), 0)
    ).otherwise(0).cast("long")
    return counts.select(
        "total_jobs", "scored_jobs", "high_fit", "applied",
        rate("replied").alias("reply_rate"), rate("interviews").alias("interview_rate"),
        F.lit(threshold).alias("threshold"),
    )


def sources_present(listings: DataFrame) -> DataFrame:
    return listings.select("source").distinct()
