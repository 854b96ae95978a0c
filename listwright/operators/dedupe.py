"""First-wins deduplication, new-row selection and dense numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.session import cut_lineage


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Keep the first row of every key.

    ``row_number() = 1`` is planned with a group limit in front of the shuffle: every map
    task keeps one row per key, so a key that holds a third of the rows sends one row per
    task and never meets in one place as a whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of every key (limited in front of the shuffle as well)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def not_in(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known yet. Runs after the dedupe, on its partitioning."""
    return df.join(known.select(key), key, "left_anti")


def number_rows(df: DataFrame, order: list[Column | str], name: str, start: int = 1) -> DataFrame:
    """Dense numbers in a total order, without sending all rows through one task.

    The rows are range-partitioned, sorted and materialised; what is added up afterwards is
    one count per partition.
    """
    ordered = cut_lineage(
        df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy("_part").agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    # One row per partition of the sort: bounded by the partition count.
    return (
        ordered.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + start)
        .drop("_at", "_part", "_before")
    )
