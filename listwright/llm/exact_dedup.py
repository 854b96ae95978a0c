"""Exact dedup against a persistent digest index.

The index is a table of digests, bucketed and sorted by digest. New data is reduced to one row per digest, compared
with the index by a sort-merge anti join (the index side is read bucket by bucket, without a shuffle), and what is
new is appended.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import LOWER, UPPER, ascii_lower, join_groups, new_path, query, table, written


def digest_of(text: Column) -> Column:
    """SHA-256 (binary) of the text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


class DigestIndex:
    """Digests seen so far: (digest, keep_id), in a folder that outlives the session.

    ``buckets`` is fixed when the index is made; open it with the same number again. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark = spark
        self.buckets = buckets
        self.name = "digest_index_" + hashlib.sha256(path.encode()).hexdigest()[:16]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Add (digest, keep_id) rows whose digests the index does not hold yet."""
        (rows.select("digest", "keep_id").repartition(self.buckets, "digest").sortWithinPartitions("digest")
         .write.insertInto(self.name))
        self.spark.catalog.refreshTable(self.name)


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate ``docs`` against ``index`` and against each other, and append what is new.

    One row per input row: (id, keep_id, group_size, kept, digest). keep_id is the row that stays: the one the index
    already holds, else the largest id of the group in this batch. group_size counts the rows of this batch.

    Null texts equal empty ones. Where only rows with a null id have a text, keep_id is null; one of them is kept if the text
    is new, none if the index holds it, and a row with an id that comes in a later batch is a copy like any other. Rows
    repeated with the same id and text are one document: all say the same. An empty table appends nothing. Other columns
    of ``docs`` are not read.
    """
    # The number tells rows without an id apart.
    rows = written(
        docs.select(F.col(id_col).alias("id"), digest_of(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("number")),
        "digests",
    )
    groups = rows.groupBy("digest").agg(
        F.max("id").alias("keep_id"), F.min(F.when(F.col("id").isNull(), F.col("number"))).alias("nameless"),
        F.count(F.lit(1)).alias("group_size"),
    )
    seen = index.rows().hint("merge")
    new = written(groups.join(seen, "digest", "left_anti"), "new-digests")
    old = written(groups.drop("keep_id", "nameless").join(seen, "digest"), "old-digests")
    index.append(new)
    # A row without an id stays for its text if no row has one.
    nameless = F.when(F.col("keep_id").isNull(), F.col("nameless")).alias("nameless")
    answers = new.select("digest", "keep_id", "group_size", nameless).unionByName(
        old.select("digest", "keep_id", "group_size", F.lit(None).cast("long").alias("nameless"))
    )
    result = join_groups(rows, answers, "digest", "group_size", rows.count())
    kept = F.coalesce(F.col("id") == F.col("keep_id"), F.col("number") == F.col("nameless"), F.lit(False))
    return result.select("id", "keep_id", "group_size", kept.alias("kept"), "digest")


@query(
    "op10_exact_dedup",
    f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
""",
)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = DigestIndex(spark, new_path(spark, "digest-index"), buckets)
    return exact_dedup(table(spark, sf_dir, "documents"), index).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )
