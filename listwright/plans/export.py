"""Tracker rows as CSV that is safe to open in a spreadsheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.functions.scalars import csv_safe, iso_seconds
from listwright.operators.predicates import on_board
from listwright.plans.lifecycle import board_order


def tracker_export(listings: DataFrame) -> DataFrame:
    """The twelve export columns, newest first; NULL becomes ''."""
    safe = lambda c: csv_safe(c).alias(c)
    when = lambda c: iso_seconds(c).alias(c)
    rows = listings.filter(on_board()).orderBy(*board_order())
    return rows.select(
        "id", safe("source"), safe("title"), safe("company"), safe("url"),
        F.coalesce(F.col("ai_score").cast("string"), F.lit("")).alias("ai_score"),
        safe("status"), when("applied_at"), when("posted_at"), when("fetched_at"),
        safe("ai_reason"), safe("notes"),
    )


def write_export(listings: DataFrame, path: str) -> None:
    """One CSV part per partition, in the order of the sort."""
    (
        tracker_export(listings).write.mode("overwrite").option("header", True)
        .option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
    )
