"""Alerts as a stream sink: each batch tells about the best listings not told about yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright import fixed_values as fv
from listwright.plans.alerts import append_to_outbox, select_alerts
from listwright.session import path_exists

OUTBOX = "id bigint, ai_score int, fetched_at timestamp_ntz, message string, sent_at timestamp_ntz, batch_id bigint"


def outbox(spark: SparkSession, path: str, before_batch: int | None = None) -> DataFrame:
    if path_exists(spark, path):
        rows = spark.read.schema(OUTBOX).parquet(path)
    else:  # nothing written yet
        rows = spark.createDataFrame([], OUTBOX)
    return rows if before_batch is None else rows.filter(F.col("batch_id") < before_batch)


def alert_batch(
    listings: DataFrame, batch_id: int, path: str, sent_at: Column,
    threshold: int = fv.DEFAULT_ALERT_THRESHOLD, limit: int = fv.ALERT_BATCH,
) -> None:
    """Select against what earlier batches have sent and replace this batch's own entries,
    so running a batch again sends nothing twice and loses nothing."""
    sent = outbox(listings.sparkSession, path, batch_id)
    append_to_outbox(select_alerts(listings, sent, threshold, limit), path, batch_id, sent_at)
