"""Listings typed in by hand, checked as a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions.scalars import dedupe_key
from listwright.functions.text import blank_to_null, strip, text_or_empty
from listwright.operators.dedupe import first_per_key
from listwright.plans.ingest import stored_shape


def check_manual(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Cleaned rows with ``reason`` (NULL = accepted) and ``dedupe_hash``.

    ``rows`` has (item_ord, url, title, company, description). A row is refused for a missing
    address or title, an address that is not http(s), or an address that is stored already or
    was given earlier in the batch.
    """
    clean = rows.select(
        "item_ord", strip(text_or_empty("url")).alias("url"),
        strip(text_or_empty("title")).alias("title"), blank_to_null("company").alias("company"),
        strip(text_or_empty("description")).alias("description"),
    ).withColumn("dedupe_hash", dedupe_key("url"))
    shape = F.when((F.col("url") == "") | (F.col("title") == ""), "URL and title are required.").when(
        ~F.lower("url").rlike("^https?://"), "URL must start with http:// or https://"
    )
    judged = clean.withColumn("reason", shape)
    winners = first_per_key(
        judged.filter("reason is null").select("dedupe_hash", "item_ord"), ["dedupe_hash"], ["item_ord"]
    ).join(known.select("dedupe_hash"), "dedupe_hash", "left_anti")
    accepted = winners.select("item_ord", F.lit(True).alias("accepted"))
    return judged.join(accepted, "item_ord", "left").withColumn(
        "reason",
        F.when(F.col("reason").isNotNull(), F.col("reason")).when(
            F.col("accepted").isNull(), "That job is already in your feed."
        ),
    ).drop("accepted")


def manual_listings(checked: DataFrame, added_at: Column) -> DataFrame:
    """Accepted rows in the shape of the listing table."""
    nothing = F.lit(None).cast("string")
    rows = checked.filter("reason is null").withColumns(
        {
            "source": F.lit("manual"), "external_id": nothing, "budget": nothing,
            "location": nothing, "tags": F.array().cast("array<string>"),
            "posted_at": F.lit(None).cast("timestamp_ntz"),
        }
    )
    return rows.select(*stored_shape(added_at))
