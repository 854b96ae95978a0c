"""Alert selection into an outbox; every listing gets there at most once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright import fixed_values as fv
from listwright.functions.scalars import alert_text
from listwright.operators.predicates import alertable


def alert_order() -> list[Column]:
    return [F.desc("ai_score"), F.desc("fetched_at"), F.asc("id")]


def select_alerts(
    listings: DataFrame,
    outbox: DataFrame | None = None,
    threshold: int = fv.DEFAULT_ALERT_THRESHOLD,
    limit: int = fv.ALERT_BATCH,
    max_chars: int | None = None,
) -> DataFrame:
    """(id, ai_score, fetched_at, message) of the best listings nobody was told about yet.

    ``max_chars`` is the longest message that the receiver takes; without it messages are whole.
    A threshold of 0 is taken literally here. The limit is the size of one batch of alerts;
    what is left over is selected next time.
    """
    rows = listings.filter(alertable(threshold))
    if outbox is not None:
        rows = rows.join(outbox.select("id"), "id", "left_anti")
    c = F.col
    message = alert_text(c("ai_score"), c("title"), c("company"), c("ai_reason"), c("url"), max_chars)
    # The message is built after the top-k, for the selected rows only.
    best = rows.select(
        "id", "ai_score", "title", "company", "ai_reason", "url", "fetched_at"
    ).orderBy(*alert_order()).limit(limit)
    return best.select("id", "ai_score", "fetched_at", message.alias("message"))


def append_to_outbox(alerts: DataFrame, path: str, batch_id: int, sent_at: Column) -> None:
    """Write one batch, sent at ``sent_at``. Writing the same batch again replaces it, so a retry sends nothing
    twice."""
    (
        alerts.withColumns({"sent_at": sent_at.cast("timestamp_ntz"), "batch_id": F.lit(batch_id)}).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
    )


def with_notified_at(listings: DataFrame, outbox: DataFrame) -> DataFrame:
    """``notified_at`` of the listings, taken from what was sent."""
    sent = outbox.groupBy("id").agg(F.min("sent_at").alias("_sent"))
    return (
        listings.join(sent, "id", "left")
        .withColumn("notified_at", F.coalesce("notified_at", "_sent")).drop("_sent")
    )
