"""What the corpus operators share: tables, the shared folder, written intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.session import release_shuffles, remove_path, ship_package  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A word: a run of ASCII letters, digits and anything that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_own_folder: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is DuckDB SQL that gives the same rows."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on this machine alone that does not set it gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own_folder:
        _own_folder[context.applicationId] = tempfile.mkdtemp(prefix="corpus-")
    return "file://" + _own_folder[context.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and no executor's loss undoes it."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    table_ = df.sparkSession.read.schema(df.schema).parquet(path)
    table_.written_to = path
    return table_


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` once everything that reads them has been written itself."""
    for df in tables:
        remove_path(df.sparkSession, df.written_to)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are.

    lower() is that, and much faster, on texts of ASCII only.
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )

#: A group with more than this share of the rows is heavy; at most 1 / share groups can be.
HEAVY_SHARE = 0.001


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` inner-joined with the row of ``groups`` for their key; ``size`` counts a group's rows, of ``total``.

    Heavy groups are few by their definition; they are broadcast, so that no task gets all rows of one. Both inputs are
    read twice: hand over written tables.
    """
    least = total * HEAVY_SHARE
    heavy = F.broadcast(groups.filter(F.col(size) > least))
    light = groups.filter(F.col(size) <= least)
    return rows.join(heavy, key).unionByName(
        rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    )
