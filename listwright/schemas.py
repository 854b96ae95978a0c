"""Table schemas and the source registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listwright import fixed_values as fv

_STRINGS = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


S, NTZ, LONG, INT = T.StringType(), T.TimestampNTZType(), T.LongType(), T.IntegerType()

# One fetched response, as landed by whatever talks to the network.
LANDING = _struct(
    cycle_id=LONG, source=S, feed_key=S, request_url=S, http_status=INT,
    content_type=S, fetched_at=NTZ, body=S,
)

# What every source turns into. ``item_ord`` is the position inside the source.
RAW_LISTING = _struct(
    source=S, external_id=S, url=S, title=S, company=S, description=S, tags=_STRINGS,
    budget=S, location=S, posted_at=NTZ,
)
RAW_COLUMNS = RAW_LISTING.fieldNames()

# The listing table, one row per distinct address.
LISTING = _struct(
    id=LONG, source=S, external_id=S, url=S, title=S, company=S, description=S, tags=_STRINGS,
    budget=S, location=S, contact_emails=_STRINGS, posted_at=NTZ, fetched_at=NTZ,
    ai_score=INT, ai_reason=S, ai_proposal=S, ai_attempts=INT, notified_at=NTZ,
    status=S, applied_at=NTZ, notes=S, dedupe_hash=S,
)

SOURCE_KEYS = [key for key, *_ in fv.SOURCES]


def registry(spark: SparkSession) -> DataFrame:
    """The source dimension (a fixed, small table); ``manual`` comes last."""
    rows = [
        (key, i, label, color, on, key in fv.PRE_FILTERED_SOURCES)
        for i, (key, label, color, on) in enumerate(fv.SOURCES)
    ]
    key, label, color = fv.MANUAL_SOURCE
    rows.append((key, len(rows), label, color, False, False))
    return spark.createDataFrame(
        rows,
        "source string, source_ord int, label string, color string, "
        "default_enabled boolean, prefiltered boolean",
    )


def source_order(source: Column) -> Column:
    """Registry position of a source; sources it does not know come last."""
    order = F.lit(len(SOURCE_KEYS) + 1)
    return F.coalesce(
        F.nullif(F.array_position(F.array(*map(F.lit, [*SOURCE_KEYS, "manual"])), source), F.lit(0)),
        order,
    ).cast("int")


def source_label(source: Column) -> Column:
    """Display label; a source without one shows its key."""
    pairs = [(k, label) for k, label, *_ in fv.SOURCES] + [fv.MANUAL_SOURCE[:2]]
    return _lookup(source, pairs, source)


def source_color(source: Column) -> Column:
    pairs = [(k, color) for k, _, color, _ in fv.SOURCES]
    return _lookup(source, [*pairs, fv.MANUAL_SOURCE[::2]], F.lit(fv.DEFAULT_COLOR))


def _lookup(key: Column, pairs: list[tuple[str, str]], default: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.coalesce(F.try_element_at(table, key), default)


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """The listing table; files written before a late column existed are widened."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    for field in LISTING:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    return df.withColumn("ai_attempts", F.coalesce("ai_attempts", F.lit(0))).select(
        *LISTING.fieldNames(), *[c for c in df.columns if c not in LISTING.fieldNames()]
    )
