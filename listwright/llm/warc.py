"""WARC archives: a deterministic sharded writer, and a reader.

Records are sorted by id and cut into shards of consecutive ids by payload size. A task writes its shards in order and
rolls to the next file when the compressed bytes reach a limit. Each record is a gzip member with its headers and digests
made anew. A file is written under a temporary name and renamed when it is whole; the manifest is written last, by Spark.
Everything in a file follows from the records and parameters, so a task that runs again writes the same bytes to the same
name.

Files are written and read through ``pyarrow.fs`` at the place the URI names, which has to be one that all executors reach.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import new_path, query, table, written

#: A shard has this part of all payload bytes, within bounds: enough shards for all tasks, files that are not too small.
SHARD_PART, SHARD_BYTES = 4096, (1 << 20, 1 << 30)
#: Compressed bytes after which a file is full.
ROLL_BYTES = 64 << 20
#: Shards are cut between so many ranges of ids, which are found from about so many of them.
ID_RANGES, SAMPLE_IDS = 1 << 16, 1 << 20
#: Bytes of archives that a task reads.
READ_BYTES = 64 << 20
#: Rows without an id are dealt over so many shards.
NULL_SHARDS = 64
#: Stands in all records, so that archives do not depend on when they are written.
DATE = "2024-01-01T00:00:00Z"

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = pa.schema([
    ("shard", pa.int64()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()),
    ("first_id", pa.int64()), ("last_id", pa.int64()),
])
_RECORD = pa.schema([
    ("id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string()),
])


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in schema)


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A WARC record: a response with its payload, or, with ``refers_to``, a revisit that has the HTTP headers alone."""
    digest = _digest(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page}"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", "sha1:" + digest),
        ("WARC-Block-Digest", "sha1:" + _digest(block)),
    ]
    if page is not None:
        fields.append(("X-Page-Id", str(page)))
    if refers_to is not None:
        fields += [
            ("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)),
            ("X-Refers-To-Page-Id", str(refers_to)),
        ]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


class _File:
    """A file being written, under a temporary name until it is whole."""

    def __init__(self, system, folder: str, shard: int, number: int):
        self.shard, self.name = shard, f"shard-{shard:07d}-{number:05d}.warc.gz"
        self.system, self.path = system, f"{folder}/{self.name}"
        self.temporary = f"{folder}/.{self.name}.{TaskContext.get().taskAttemptId()}"
        self.out = system.open_output_stream(self.temporary, compression=None)
        self.records = self.bytes = 0
        self.sha = hashlib.sha256()
        self.ids: list[int | None] = []

    def add(self, page: int | None, data: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        self.out.write(member)
        self.sha.update(member)
        self.records, self.bytes = self.records + 1, self.bytes + len(member)
        self.ids = [self.ids[0] if self.ids else page, page]

    def commit(self) -> pa.RecordBatch:
        self.out.close()
        if self.system.get_file_info(self.path).type != pa_fs.FileType.NotFound:
            self.system.delete_file(self.path)  # of an attempt whose task was lost; not every system moves over a file
        self.system.move(self.temporary, self.path)
        row = [self.shard, self.name, self.records, self.bytes, self.sha.hexdigest(), *self.ids]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _MANIFEST)], schema=_MANIFEST)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            yield from zip(*(c.to_pylist() for c in batch.slice(start, 64).columns))


def _id_borders(thin: DataFrame) -> list[float]:
    """Borders of ranges of ids with about as many rows each, from up to about SAMPLE_IDS rows chosen by their hash.

    Where the borders are decides about the sizes of shards alone.
    """
    ids = thin.filter("id is not null")
    every = -(-ids.count() // SAMPLE_IDS) or 1
    sample = np.sort(np.array(
        [r["id"] for r in ids.filter(F.pmod(F.xxhash64("id", "digest"), F.lit(every)) == 0).select("id").collect()], np.int64
    ))
    at = np.unique(np.arange(1, ID_RANGES) * len(sample) // ID_RANGES)
    return [-np.inf, *np.unique(sample[at].astype(float)).tolist(), np.inf] if len(sample) else [-np.inf, np.inf]


def _with_id_range(rows: DataFrame, borders: list[float]) -> DataFrame:
    """Adds ``id_range``, which grows with the id; rows without an id are in ranges of their own, below zero."""
    place = rows.withColumn("id_place", F.coalesce(F.col("id").cast("double"), F.lit(0.0)))
    if len(borders) > 2:
        place = Bucketizer(splits=borders, inputCol="id_place", outputCol="id_bucket").transform(place)
    else:
        place = place.withColumn("id_bucket", F.lit(0.0))
    nameless = -1 - F.pmod(F.xxhash64("digest"), F.lit(NULL_SHARDS))
    return place.withColumn("id_range", F.when(F.col("id").isNull(), nameless).otherwise(F.col("id_bucket").cast("long"))).drop(
        "id_place", "id_bucket"
    )


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    revisit_from: int = 0, shard_bytes: int | None = None, roll_bytes: int = ROLL_BYTES, date: str = DATE,
) -> DataFrame:
    """Write ``pages`` as archives below ``path`` (a folder that does not exist yet); returns the manifest.

    Of rows with equal payloads of at least ``revisit_from`` bytes, that with the smallest id is a response and the
    others are revisits of it; smaller payloads are all responses. A null payload is an empty one. Rows with the same id
    and payload are written as often as they occur, alike. Rows without an id come in shards of their own, and are
    responses where no row with an id has their payload. An empty table gives an empty manifest. Other columns are not read.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    thin = written(rows.select("id", "digest", F.octet_length("payload").cast("long").alias("bytes")), "warc-digests")

    borders = _id_borders(thin)
    thin = _with_id_range(thin, borders)
    # One row for each range of ids: as many as there are ranges at most.
    sizes = thin.groupBy("id_range").agg(F.sum("bytes").alias("bytes")).orderBy("id_range").collect()
    if shard_bytes is None:
        shard_bytes = min(max(sum(row["bytes"] for row in sizes) // SHARD_PART, SHARD_BYTES[0]), SHARD_BYTES[1])
    shard_of, shard, filled, full = [], -1, 0, True
    for row in sizes:
        full = full or filled >= shard_bytes or row["id_range"] < 0
        if full:
            shard, filled, full = shard + 1, 0, row["id_range"] < 0
        filled += row["bytes"]
        shard_of.append((row["id_range"], shard))
    shards = F.broadcast(spark.createDataFrame(shard_of, "id_range long, shard long"))

    # A revisit's note stands in front of its row in the sort order. So the payloads move once, to their shards.
    groups = thin.filter(F.col("bytes") >= revisit_from).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = groups.filter((F.col("n") > 1) & F.col("first").isNotNull()).drop("n")
    notes = thin.filter(F.col("bytes") >= revisit_from).join(groups, "digest").filter(~F.col("id").eqNullSafe(F.col("first"))).select(
        "id", "digest", "first"
    ).distinct()
    both = rows.withColumn("first", F.lit(None).cast("long")).withColumn("note", F.lit(False)).unionByName(
        notes.select("id", F.lit(None).cast("string").alias("url"), F.lit("").alias("payload"), "digest", "first", F.lit(True).alias("note"))
    )
    both = _with_id_range(both, borders).join(shards, "id_range")
    order = ["shard", "id", "digest", F.desc("note"), "url"]
    both = both.repartition("shard").sortWithinPartitions(*order).select("shard", "id", "digest", "note", "first", "url", "payload")

    folder = f"{path}/archives"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = _file_system(folder)
        system.create_dir(place, recursive=True)
        file, note = None, (None, None, None)
        for shard, page, digest, is_note, first, url, text in _rows(batches):
            if is_note:
                note = (page, digest, first)
                continue
            number = 0
            if file is not None and (file.shard != shard or file.bytes >= roll_bytes):
                if file.shard == shard:
                    number = count + 1
                yield file.commit()
                file = None
            if file is None:
                count = number
                file = _File(system, place, shard, number)
            refers_to = note[2] if note[:2] == (page, digest) else None
            file.add(page, record(page, url, text.encode(), refers_to, date))
        if file is not None:
            yield file.commit()

    both.mapInArrow(write, _sql(_MANIFEST)).write.parquet(f"{path}/manifest")
    return spark.read.schema(_sql(_MANIFEST)).parquet(f"{path}/manifest")


def parse(data: bytes) -> tuple:
    """A record as written by ``record``: (id, url, payload_bytes, payload_digest, type, refers_to, payload)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    if "sha1:" + _digest(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length:"))
    kind = fields["WARC-Type"]
    if kind == "response" and (_digest(payload) != digest or len(payload) != size):
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} differs")
    page, other = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
    return (
        page and int(page), fields["WARC-Target-URI"], size, digest, kind, other and int(other),
        payload.decode() if kind == "response" else None,
    )


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archives that the manifest below ``path`` lists; digests are checked.

    (id, url, payload_bytes, payload_digest, record_type, refers_to, payload); the payload is null in revisits.
    Archives are streamed, a task holds one record at a time besides its batch of results.
    """
    folder = f"{path}/archives"
    files = spark.read.schema(_sql(_MANIFEST)).parquet(f"{path}/manifest").select("file", "bytes")

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORD)], schema=_RECORD)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = _file_system(folder)
        for name, size in _rows(batches):
            out, held, total = [], 0, 0
            with system.open_input_stream(f"{place}/{name}", compression=None) as source:
                unpacker, record_, data = zlib.decompressobj(31), [], b""
                while data or (data := source.read(1 << 20)):
                    total += len(data)
                    record_.append(unpacker.decompress(data))
                    data = unpacker.unused_data
                    total -= len(data)
                    if unpacker.eof:
                        row = parse(b"".join(record_))
                        out.append(row if payloads else (*row[:-1], None))
                        held += len(row[-1] or "") if payloads else 0
                        unpacker, record_ = zlib.decompressobj(31), []
                        if len(out) >= 1000 or held > 8 << 20:
                            yield batch(out)
                            out, held = [], 0
            if total != size or record_:
                raise ValueError(f"{name} has {total} bytes, the manifest says {size}")
            if out:
                yield batch(out)

    n_files, n_bytes = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    # The manifest is tiny whatever it lists: say how many tasks its files are for.
    tasks = max(1, min(n_files, max(spark.sparkContext.defaultParallelism, -(-n_bytes // READ_BYTES))))
    return files.repartition(tasks, "file").mapInArrow(read, _sql(_RECORD))


@query(
    "op8_warc",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS h FROM p),
f AS (SELECT h, min(page_id) AS first_id FROM d GROUP BY h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
    ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS INTEGER), 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d JOIN f USING (h)
""",
)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, payloads=False).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
