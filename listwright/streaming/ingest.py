"""Continuous ingest: landed responses in, listing table and run log out.

Each micro-batch is one ingest cycle. Everything a batch writes lies in partitions named
after the batch and replaces what an earlier attempt of the same batch has written, so a
batch that is run again (a lost executor, a restarted driver) changes nothing.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from listwright.functions.scalars import dedupe_key
from listwright.operators.address_index import AddressIndex
from listwright.operators.dedupe import number_rows
from listwright.plans.ingest import IngestConfig, cycle_summary, enabled_only, new_listings, source_failures
from listwright.schemas import LANDING, LISTING
from listwright.session import cut_lineage, path_exists
from listwright.sources.registry import normalize
from listwright.sources.rss_feeds import feed_warnings

CYCLE = "10 minutes"


@dataclass(frozen=True)
class Paths:
    landing: str
    listings: str
    runs: str
    checkpoint: str
    # Where the warnings about saved searches go; each cycle replaces those of the last.
    warnings: str | None = None
    # Buckets of the index of addresses.
    address_buckets: int = 64

    @property
    def addresses(self) -> str:
        """The index of known addresses, beside the listing table."""
        return self.listings.rstrip("/") + "-addresses"


@dataclass(frozen=True)
class StreamConfig:
    ingest: IngestConfig = field(default_factory=IngestConfig)
    # Source switches over the defaults.
    enabled: dict[str, bool] = field(default_factory=dict)
    # Sources to normalise; None means all that are registered.
    sources: list[str] | None = None


def stored(spark: SparkSession, path: str, before_batch: int | None = None) -> DataFrame:
    """The listing table, optionally only what earlier batches have written."""
    if path_exists(spark, path):
        rows = spark.read.schema(f"{LISTING.toDDL()}, batch_id bigint").parquet(path)
    else:  # nothing written yet
        rows = spark.createDataFrame([], f"{LISTING.toDDL()}, batch_id bigint")
    return rows if before_batch is None else rows.filter(F.col("batch_id") < before_batch)


def _replace(rows: DataFrame, path: str, *partitions: str) -> None:
    (
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions).parquet(path)
    )


def address_index(spark: SparkSession, paths: Paths) -> AddressIndex:
    """The index that goes with a listing table; made from the table if that is older than the index."""
    is_new = not path_exists(spark, paths.addresses)
    index = AddressIndex(spark, paths.addresses, paths.address_buckets)
    if is_new and path_exists(spark, paths.listings):
        index.rebuild(stored(spark, paths.listings))
    return index


def last_id(spark: SparkSession, runs: str, before_batch: int) -> int | None:
    """The largest id that batches before this one have given, from the run log; None if it does not say."""
    if not path_exists(spark, runs):
        return None
    rows = spark.read.schema("last_id bigint, batch_id bigint").parquet(runs)
    return rows.filter(F.col("batch_id") < before_batch).agg(F.max("last_id")).first()[0]


def store_batch(
    raw: DataFrame, batch_id: int, paths: Paths, config: IngestConfig, failures: DataFrame | None = None,
    fetched: DataFrame | None = None,
) -> None:
    """Gate, dedupe, number and store one batch of raw rows (with ``cycle_id``), and log what became of them.

    Rows are compared with the index of addresses, where only the batch's addresses are looked up; the listing table is
    not read. The order of writing is rows, addresses, log: a batch that failed in between and is run again finds its own
    addresses under its own number, which do not count, and replaces its rows.

    ``fetched`` has (cycle_id, _at); without it, rows keep their own ``fetched_at``.
    """
    spark = raw.sparkSession
    index = address_index(spark, paths)
    looked_up = cut_lineage(index.lookup(raw.select(dedupe_key("url").alias("dedupe_hash"))))
    known = looked_up.filter(F.col("batch_id") < batch_id).select("dedupe_hash").distinct()
    top = last_id(spark, paths.runs, batch_id)
    if top is None:  # the first batch, or a table that is older than this column of the log
        top = stored(spark, paths.listings, batch_id).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = new_listings(raw, known, config, F.lit(None).cast("timestamp_ntz") if fetched is not None else F.col("fetched_at"))
    if fetched is not None:
        # One row per cycle of the batch.
        fresh = fresh.join(F.broadcast(fetched), "cycle_id").withColumn("fetched_at", F.col("_at"))
    numbered = number_rows(fresh, ["cycle_id", "_source_ord", "item_ord"], "id", start=top + 1)
    _replace(
        numbered.select(*LISTING.fieldNames()).withColumn("batch_id", F.lit(batch_id)),
        paths.listings, "batch_id", "source",
    )
    index.append(numbered.select("dedupe_hash"), batch_id, looked_up)
    counts = ["fetched", "inserted", "skipped"]
    runs = cycle_summary(raw, known, config).select("cycle_id", "source", *counts)
    if failures is None:
        failures = spark.createDataFrame([], "cycle_id bigint, source string, error_class string, error string")
    last = numbered.agg(F.coalesce(F.max("id"), F.lit(top))).first()[0]
    runs = runs.join(failures, ["cycle_id", "source"], "full_outer").select(
        "cycle_id", "source", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in counts], "error_class", "error",
        F.lit(last).cast("long").alias("last_id"),
    )
    _replace(runs.withColumn("batch_id", F.lit(batch_id)), paths.runs, "batch_id")


def ingest_batch(landing: DataFrame, batch_id: int, paths: Paths, config: StreamConfig) -> None:
    """One cycle. Failed responses are logged with their source's error; good responses of the same source count, as a
    landed file is not read again. Pages are parsed once.
    """
    landing = enabled_only(landing, config.enabled).persist()
    try:
        fetched = landing.groupBy("cycle_id").agg(F.max("fetched_at").alias("_at"))
        store_batch(
            cut_lineage(normalize(landing, config.sources)), batch_id, paths, config.ingest,
            source_failures(landing), fetched,
        )
        if paths.warnings:
            feed_warnings(landing).write.mode("overwrite").parquet(paths.warnings)
    finally:
        landing.unpersist()


def start_ingest(
    spark: SparkSession, paths: Paths, config: StreamConfig | None = None,
    once: bool = False, fmt: str = "parquet",
) -> StreamingQuery:
    """Watch the landing folder; one query per checkpoint, so cycles never overlap.

    ``once`` works off what is there and stops.
    """
    config = config or StreamConfig()
    stream = spark.readStream.schema(LANDING).format(fmt).load(paths.landing)
    trigger = {"availableNow": True} if once else {"processingTime": CYCLE}
    return (
        stream.writeStream
        .foreachBatch(lambda batch, batch_id: ingest_batch(batch, batch_id, paths, config))
        .option("checkpointLocation", os.path.join(paths.checkpoint, "ingest"))
        .trigger(**trigger).start()
    )


def drop_repeats(stream: DataFrame, horizon: str) -> DataFrame:
    """Streaming dedupe with bounded state: an address is remembered for ``horizon``.

    Use it where a repeat after that time may come through; ``start_ingest`` compares with
    the table instead and never lets one through.
    """
    at = F.to_timestamp_ltz(F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return (
        stream.withColumn("_seen", at).withWatermark("_seen", horizon)
        .dropDuplicatesWithinWatermark(["dedupe_hash"]).drop("_seen")
    )
