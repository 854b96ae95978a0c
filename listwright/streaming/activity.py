"""Running counts per day and per week over a stream of listings or applications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _clock(ts: Column) -> Column:
    """Watermarks need an instant: the stored wall clock is UTC."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp")


def _counts(stream: DataFrame, ts: str, window: Column, late: str, name: str, *keys: str) -> DataFrame:
    start = F.to_date(F.convert_timezone(None, F.lit("UTC"), F.col("w.start").cast("timestamp_ntz")))
    return (
        stream.filter(F.col(ts).isNotNull()).withColumn("_at", _clock(F.col(ts)))
        .withWatermark("_at", late)
        .groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"))
        .select(start.alias(name), *keys, "n")
    )


def listings_per_day(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, source, n); a day is final once nothing for it can arrive any more."""
    return _counts(stream, "fetched_at", F.window("_at", "1 day"), late, "day", "source")


def applications_per_week(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """(week, n); windows of seven days that start on a Monday."""
    return _counts(stream, "applied_at", F.window("_at", "7 days", "7 days", "4 days"), late, "week")
