"""A persistent index of known addresses: what an ingest cycle compares its rows with, instead of the listing table.

The index holds a 32-byte digest per address and the batch that stored it, in files bucketed and sorted by digest. A lookup
moves the batch's digests only. A batch of some hundred addresses names them to the scan, which then opens the buckets they
are in and skips the row groups that cannot hold them; a larger one, which meets all buckets anyway, is dealt into the
same buckets and joined with each where it lies. In neither case are the index's rows shuffled.

Each append leaves at most one file per bucket; ``compact`` makes them one again. Versions are folders below ``path``, and
the last complete one counts, so an index can be compacted while nobody writes and read all the time.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.session import cut_lineage, list_folder

#: Digests that are named in the scan's filter; it is planned with that many literals of 32 bytes.
NAMED = 1_000


class AddressIndex:
    """Digests of addresses with the batch that stored them. One writer at a time.

    ``buckets`` is fixed when the index is made; open it with the same number again. Choose it so that a bucket holds some
    hundred MB in the end (three million addresses take about 100 MB).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._open(max(self._versions(), default=0))

    def _versions(self) -> list[int]:
        """Complete versions: the first is made empty, later ones are those a finished job has left."""
        found = [v for v in list_folder(self.spark, self.path) if v.startswith("v")]
        return [int(v[1:]) for v in found if v == "v0" or "_SUCCESS" in list_folder(self.spark, f"{self.path}/{v}")]

    def _name(self, version: int) -> str:
        return f"address_index_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}_{version}"

    def _open(self, version: int) -> None:
        self.version, self.name = version, self._name(version)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, batch_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/v{version}'"
        )
        self.spark.catalog.refreshTable(self.name)

    def rows(self) -> DataFrame:
        """(digest, batch_id) of everything stored."""
        return self.spark.table(self.name)

    def lookup(self, hashes: DataFrame) -> DataFrame:
        """(dedupe_hash, batch_id) of those of ``hashes`` (hexadecimal, in ``dedupe_hash``) that the index holds.

        An address that several batches have stored has several rows. Nulls are in no index.
        """
        wanted = cut_lineage(
            hashes.select(F.unhex("dedupe_hash").alias("digest")).filter("digest is not null").distinct()
        )
        named = wanted.limit(NAMED + 1).collect()
        if len(named) <= NAMED:
            found = self.rows().filter(F.col("digest").isin([bytes(r["digest"]) for r in named]))
        else:
            found = self.rows().join(wanted.repartition(self.buckets, "digest").hint("shuffle_hash"), "digest", "left_semi")
        return found.select(F.lower(F.hex("digest")).alias("dedupe_hash"), "batch_id")

    def append(self, hashes: DataFrame, batch_id: int, looked_up: DataFrame | None = None) -> None:
        """Store the digests of ``hashes`` for ``batch_id``; what an earlier attempt of the batch has stored stays once.

        ``looked_up`` is what ``lookup`` gave for them, if that is known already.
        """
        stored = self.lookup(hashes) if looked_up is None else looked_up
        stored = stored.filter(F.col("batch_id") == batch_id).select("dedupe_hash")
        rows = hashes.select("dedupe_hash").distinct().join(stored, "dedupe_hash", "left_anti")
        (
            rows.select(F.unhex("dedupe_hash").alias("digest"), F.lit(batch_id).cast("long").alias("batch_id"))
            .filter("digest is not null").repartition(self.buckets, "digest").sortWithinPartitions("digest")
            .write.insertInto(self.name)
        )
        self.spark.catalog.refreshTable(self.name)

    def compact(self) -> None:
        """One sorted file per bucket. Buckets stay where they are: nothing is shuffled."""
        version = self.version + 1
        rows = self.rows()
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(version)}")
        self._open(version)
        rows.groupBy("digest").agg(F.min("batch_id").alias("batch_id")).sortWithinPartitions("digest").write.insertInto(
            self.name, overwrite=True
        )
        self.spark.catalog.refreshTable(self.name)

    def rebuild(self, listings: DataFrame) -> None:
        """Store the addresses of a listing table (``dedupe_hash``, ``batch_id``) that has no index yet."""
        rows = listings.groupBy("dedupe_hash").agg(F.min("batch_id").alias("batch_id"))
        (
            rows.select(F.unhex("dedupe_hash").alias("digest"), "batch_id").filter("digest is not null")
            .repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)
        )
        self.spark.catalog.refreshTable(self.name)
