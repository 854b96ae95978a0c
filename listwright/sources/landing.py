"""Landed responses: what came back from a feed, one row per response.

A source is a function from landed responses to rows of RAW_LISTING plus ``cycle_id`` and
``item_ord``, the position of the item inside the source. Items are ordered by response (``feed_ord``) and by
position in the response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.functions.text import empty_to_null, text_or_empty
from listwright.schemas import LANDING, RAW_LISTING

# Room for the items of one response inside ``item_ord``: as many as an array can have. ``feed_ord`` stays below
# FEEDS, so that the two together fit a bigint and never overlap.
ITEMS_PER_RESPONSE = 1 << 31
FEEDS = 1 << 32


def read_landing(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(LANDING).format(fmt).load(path)


def write_landing(landing: DataFrame, path: str) -> None:
    """Add responses to a table with a folder for each source, so that a source reads its own only."""
    landing.write.mode("append").partitionBy("source").parquet(path)


def good_responses(landing: DataFrame, source: str) -> DataFrame:
    """Successful responses of one source, with ``feed_ord``.

    ``feed_key`` numbers the pages or feeds of a source where order matters; keys that are
    numbers below FEEDS are ordered by their hash, which is as good as any other fixed order.
    """
    number = F.col("feed_key").try_cast("long")
    feed_ord = F.when(number.between(0, FEEDS - 1), number).otherwise(F.pmod(F.xxhash64("feed_key"), F.lit(FEEDS)))
    return landing.filter(
        (F.col("source") == source) & F.coalesce(F.col("http_status").between(200, 299), F.lit(False))
    ).withColumn("feed_ord", F.coalesce(feed_ord, F.lit(0)))


def item_ord(pos: Column) -> Column:
    return (F.col("feed_ord") * F.lit(ITEMS_PER_RESPONSE).cast("long") + pos).cast("long")


def json_items(landing: DataFrame, source: str, path: str) -> DataFrame:
    """One row per array element at ``path``, as VARIANT ``item`` with ``pos``.

    Nothing here fails on malformed input: a body that is no JSON or has no such array gives
    no rows, and every field is read with a try_ function later on.
    """
    body = good_responses(landing, source).withColumn("doc", F.try_parse_json("body"))
    items = F.try_variant_get("doc", path, "array<variant>")
    return body.select(
        "cycle_id", "feed_key", "feed_ord", "fetched_at", "doc", F.posexplode(items).alias("pos", "item")
    ).filter(F.schema_of_variant("item").startswith("OBJECT"))


def field(path: str, of: str | Column = "item") -> Column:
    """A scalar field as text, NULL when absent."""
    return F.try_variant_get(of, f"$.{path}", "string")


def field_list(path: str) -> Column:
    """A list of texts; one text is a list of one, anything else an empty list."""
    value = F.try_variant_get("item", f"$.{path}", "array<string>")
    single = F.when(~text_or_empty(field(path)).isin("", "false", "0"), F.array(field(path)))
    return F.coalesce(value, single, F.array().cast("array<string>"))


def field_names(path: str) -> Column:
    """The non-empty ``name`` of every object in a list."""
    names = F.transform(
        F.coalesce(
            F.try_variant_get("item", f"$.{path}", "array<variant>"),
            F.array().cast("array<variant>"),
        ),
        lambda v: F.try_variant_get(v, "$.name", "string"),
    )
    return F.filter(names, lambda n: n.isNotNull() & (n != ""))


def truthy(path: str) -> Column:
    return ~text_or_empty(field(path)).isin("", "false", "0", "0.0", "[]", "{}")


def first_text(*paths: str) -> Column:
    """The first of the fields that is there and not empty."""
    return F.coalesce(*[empty_to_null(field(p)) for p in paths])


def quarantine(landing: DataFrame) -> DataFrame:
    """Successful responses whose JSON cannot be read, with the reason."""
    is_json = F.col("content_type").contains("json")
    ok = F.coalesce(F.col("http_status").between(200, 299), F.lit(False))
    return landing.filter(ok & is_json & F.try_parse_json("body").isNull()).withColumn(
        "reason", F.lit("body is not JSON")
    )


def as_raw(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    """RAW_LISTING columns plus cycle and position; columns that are not given are NULL."""
    empty = {"tags": F.array().cast("array<string>"), "source": F.lit(source)}
    given = {**empty, **columns}
    out = [
        given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_LISTING
    ]
    return df.select("cycle_id", *out, given["item_ord"].alias("item_ord"))
