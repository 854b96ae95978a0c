"""One ingest cycle: gate, dedupe, select new rows, account for every row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright import fixed_values as fv
from listwright.functions.scalars import dedupe_key, extract_emails
from listwright.functions.text import empty_to_null, strip, text_or_empty
from listwright.operators.dedupe import first_per_key, not_in
from listwright.operators.predicates import gate_text, passes_gate
from listwright.schemas import source_order
from listwright.session import cut_lineage, keep_computed


@dataclass(frozen=True)
class IngestConfig:
    keywords: list[str] = field(default_factory=lambda: list(fv.DEFAULT_KEYWORDS))
    blocked: list[str] = field(default_factory=lambda: list(fv.DEFAULT_BLOCKED))


def merged_flags(stored: dict[str, bool] | None) -> dict[str, bool]:
    """Stored source switches over the defaults; a source nobody knows stays off."""
    defaults = {key: on for key, _, _, on in fv.SOURCES}
    return {**defaults, **(stored if isinstance(stored, dict) else {})}


def enabled_only(df: DataFrame, stored: dict[str, bool] | None = None) -> DataFrame:
    """Rows of sources that are switched on (bounded list, pushed into the scan)."""
    return df.filter(F.col("source").isin([s for s, on in merged_flags(stored).items() if on]))


def overlay_flags(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """The same overlay for flag tables: (source, enabled) full outer (source, enabled)."""
    return defaults.alias("d").join(stored.alias("s"), "source", "full_outer").select(
        "source", F.coalesce("s.enabled", "d.enabled", F.lit(False)).alias("enabled")
    )


def judge(raw: DataFrame, config: IngestConfig) -> DataFrame:
    """Adds ``verdict`` ('no_url', 'gated', 'eligible') and ``dedupe_hash``.

    The order matters: address, then gate, then dedupe. A copy that fails the gate never
    takes the place of a later one that passes it.
    """
    # The gate sees the stripped title.
    titled = raw.withColumn("title", strip(text_or_empty("title")))
    verdict = (
        F.when(strip(text_or_empty("url")) == "", "no_url")
        .when(
            ~passes_gate(F.col("source"), gate_text(), config.keywords, config.blocked), "gated"
        )
        .otherwise("eligible")
    )
    return titled.withColumn("verdict", verdict).withColumn("dedupe_hash", dedupe_key("url"))


def stored_shape(fetched_at: Column) -> list[Column]:
    """Listing columns of an accepted raw row."""
    title = F.col("title")
    return [
        F.col("source"),
        empty_to_null(F.col("external_id")).alias("external_id"),
        strip("url").alias("url"),
        title.alias("title"),
        F.col("company"),
        text_or_empty("description").alias("description"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.col("budget"),
        F.col("location"),
        extract_emails(
            F.concat(title, F.lit("\n"), text_or_empty("description"))
        ).alias("contact_emails"),
        F.col("posted_at"),
        fetched_at.alias("fetched_at"),
        F.lit(None).cast("int").alias("ai_score"),
        F.lit(None).cast("string").alias("ai_reason"),
        F.lit(None).cast("string").alias("ai_proposal"),
        F.lit(0).alias("ai_attempts"),
        F.lit(None).cast("timestamp_ntz").alias("notified_at"),
        F.lit("new").alias("status"),
        F.lit(None).cast("timestamp_ntz").alias("applied_at"),
        F.lit("").alias("notes"),
        F.col("dedupe_hash"),
    ]


def new_listings(
    raw: DataFrame, known: DataFrame | None, config: IngestConfig, fetched_at: Column
) -> DataFrame:
    """Rows to append: eligible, first of their address, not stored yet.

    ``raw`` carries RAW_LISTING columns, ``cycle_id`` and ``item_ord``; ``known`` has
    ``dedupe_hash``. First means earliest cycle, then source order, then item order.
    """
    # The verdict is computed once: a plain filter on it would be pushed into the scan as a second copy.
    judged = judge(raw, config)
    eligible = keep_computed(judged, "verdict", F.when(F.col("verdict") == "eligible", F.col("verdict")))
    winners = first_per_key(
        eligible.withColumn("_source_ord", source_order(F.col("source"))),
        ["dedupe_hash"], ["cycle_id", "_source_ord", "item_ord"],
    )
    if known is not None:
        winners = not_in(winners, known, "dedupe_hash")
    return winners.select(*stored_shape(fetched_at), "cycle_id", "_source_ord", "item_ord")


def source_failures(landing: DataFrame) -> DataFrame:
    """(cycle_id, source, error_class, error) of sources whose fetch failed.

    A 4xx answer is 'blocked', any other failure 'failed'. Feeds of some sources fail one by one, which never fails
    the source.
    """
    bad = (F.col("http_status") >= 400) | F.col("http_status").isNull()
    blocked = F.col("http_status").between(400, 499)
    return (
        landing.filter(bad & ~F.col("source").isin(fv.SOURCES_OF_MANY_FEEDS))
        .groupBy("cycle_id", "source")
        .agg(
            F.when(F.max((~F.coalesce(blocked, F.lit(False))).cast("int")) == 1, "failed")
            .otherwise("blocked").alias("error_class"),
            F.concat(F.lit("HTTP "), F.coalesce(F.max("http_status").cast("string"), F.lit("none")))
            .alias("error"),
        )
    )


def cycle_summary(raw: DataFrame, known: DataFrame | None, config: IngestConfig) -> DataFrame:
    """Fetched / inserted / skipped per cycle and source, with the reasons for skipping.

    Only (source, verdict, hash) leaves the scan. Copies of one address are added up before
    the shuffle, so afterwards an address has at most one row per cycle and source.
    """
    thin = judge(raw, config).select(
        "cycle_id", "source", "verdict", "item_ord",
        F.when(F.col("verdict") == "eligible", F.col("dedupe_hash")).alias("dedupe_hash"),
    )
    # Both branches below read this, and it is thin: the texts are scanned and gated once.
    per_source_hash = cut_lineage(
        thin.groupBy("cycle_id", "source", "verdict", "dedupe_hash").agg(
            F.count("*").alias("n"), F.min("item_ord").alias("item_ord")
        )
    )
    rejected = per_source_hash.filter("verdict <> 'eligible'").select(
        "cycle_id", "source", "verdict", "n", F.lit(0).alias("inserted")
    )
    eligible = per_source_hash.filter("verdict = 'eligible'")
    first = Window.partitionBy("dedupe_hash").orderBy(
        "cycle_id", source_order(F.col("source")), "item_ord"
    )
    eligible = eligible.withColumn("winner", F.row_number().over(first) == 1)
    if known is not None:
        marked = known.select("dedupe_hash", F.lit(True).alias("stored"))
        eligible = eligible.join(marked, "dedupe_hash", "left")
    else:
        eligible = eligible.withColumn("stored", F.lit(None).cast("boolean"))
    accepted = eligible.select(
        "cycle_id", "source", "verdict", "n",
        (F.col("winner") & F.col("stored").isNull()).cast("int").alias("inserted"),
    )
    n, kind = F.col("n"), F.col("verdict")
    count = lambda what: F.coalesce(F.sum(F.when(what, n)), F.lit(0)).cast("long")
    return (
        rejected.unionByName(accepted)
        .groupingSets([["cycle_id", "source"], ["cycle_id"]], "cycle_id", "source")
        .agg(
            F.sum("n").cast("long").alias("fetched"),
            F.sum("inserted").cast("long").alias("inserted"),
            (F.sum("n") - F.sum("inserted")).cast("long").alias("skipped"),
            count(kind == "no_url").alias("skipped_no_url"),
            count(kind == "gated").alias("skipped_gated"),
            (count(kind == "eligible") - F.sum("inserted")).cast("long").alias("skipped_duplicate"),
        )
        .withColumn("source", F.coalesce("source", F.lit("(all)")))
    )


def backfill_emails(listings: DataFrame) -> DataFrame:
    """A snapshot in which rows without the late e-mail column have it computed."""
    text = F.concat(text_or_empty("title"), F.lit("\n"), text_or_empty("description"))
    return listings.withColumn("contact_emails", F.coalesce("contact_emails", extract_emails(text)))
