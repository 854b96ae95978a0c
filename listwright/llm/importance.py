"""Importance resampling of documents towards a target corpus, on hashed word n-grams.

A document's features are its runs of one to three words; a feature's bucket is its CRC-32 modulo the number of buckets.
What a bucket is worth is the logarithm of its share in the target over its share in the documents. Documents are drawn
without replacement by their summed worth plus Gumbel noise that depends on their id alone.

The CRCs are computed in matrices: the distinct features of a block of text are grouped by their length in bytes into
two-dimensional arrays of bytes, all CRCs of a group are updated column by column, and the buckets are scattered back
to the places where the features stand.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import LOWER, UPPER, WORD, query, table, written
from listwright.operators.dedupe import number_rows

BUCKETS = 10_000
#: Percent of the eligible documents that are drawn, the words that make one eligible, and the seed of the noise.
PERCENT, LEAST_WORDS, SEED = 5, 20, 42
#: Bytes of text whose words are found at once (or one text, if that is longer), and words whose features are.
BLOCK_BYTES, BLOCK_WORDS = 4_000_000, 250_000
#: Cells of a matrix of bytes; longer groups are cut into several. Features of more bytes than ALONE, which have nothing
#: to share a matrix with, are given to zlib.
MATRIX_CELLS, ALONE = 4_000_000, 4096
#: Accuracy of the sketch that tells which rows have to be sorted: errors are at most one row in so many.
SKETCH = 10_000


def _table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = (crc >> 1) ^ np.where(crc & 1, np.uint32(0xEDB88320), np.uint32(0))
    return crc


_CRC = _table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words after lower-casing: digits, letters and all of what is not ASCII.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def crc_of_rows(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a two-dimensional array of bytes, updated column by column."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in rows.T:
        crc = _CRC[(crc ^ column) & 0xFF] ^ (crc >> 8)
    return ~crc


def _crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of ``data``: spans of equal length share matrices."""
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    at = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for first, end in zip(at, [*at[1:], len(order)]):
        length = int(lengths[order[first]])
        if length > ALONE:
            for k in order[first:end]:
                out[k] = zlib.crc32(data[starts[k]:starts[k] + length])
            continue
        step = max(1, MATRIX_CELLS // max(length, 1))
        for part in range(first, end, step):
            group = order[part:min(part + step, end)]
            # Laid out by columns, as they are read.
            columns = data[starts[group][None, :] + np.arange(length)[:, None]]
            out[group] = crc_of_rows(columns.T)
    return out


def _first_places(codes: np.ndarray, n: int) -> np.ndarray:
    places = np.empty(n, np.int64)
    places[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return places


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, int]:
    found = pa.array(keys).dictionary_encode()
    # 32-bit numbers would not hold what they are multiplied to.
    return found.indices.to_numpy().astype(np.int64), len(found.dictionary)


class Words:
    """Words of some texts: ``data`` holds them lower-cased with a space behind each, ``text_of`` says whose they are."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        parts = texts.to_pylist()
        # Joined by line ends, which are in no word.
        ends = np.cumsum(np.array([len(t) + 1 for t in parts], np.int64))
        raw = _LOWER[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
        inside = _IN_WORD[raw]
        edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.lengths = last - first
        self.ends = np.cumsum(self.lengths + 1)
        self.starts = self.ends - self.lengths - 1
        # Every byte of a word and the one behind it, which becomes a space.
        keep = inside.copy()
        keep[last] = True
        self.data = np.where(inside, raw, np.uint8(32))[keep]
        self.text_of = np.searchsorted(ends, first, side="right")

    def buckets(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """Blocks of (first word, buckets of the one, two and three words from each word on; -1 for none)."""
        for first in range(0, len(self.starts), BLOCK_WORDS):
            own = min(BLOCK_WORDS, len(self.starts) - first)
            yield first, self._block(slice(first, first + own + 2), own, buckets)

    def _block(self, part: slice, own: int, buckets: int) -> np.ndarray:
        starts, ends, text_of = self.starts[part], self.ends[part] - 1, self.text_of[part]
        n = len(starts)
        base, end = int(starts[0]), int(ends[-1]) + 1
        offsets = np.append(starts, end) - base
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.data[base:end]))]
        ).dictionary_encode()
        ids, n_words = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
        out = np.full((3, own), -1, np.int32)
        codes, n_codes = ids, n_words
        for k in range(3):
            if k:
                if n <= k:
                    break
                # A run of k + 1 words is the run of the first k and the word behind it.
                codes, n_codes = _distinct(codes[:n - k] * n_words + ids[k:])
            places = _first_places(codes, n_codes)
            of_code = (_crcs(self.data, starts[places], ends[places + k] - starts[places]) % np.uint32(buckets)).astype(np.int32)
            got = of_code[codes][:own]
            whole = text_of[:len(got)] == text_of[k:k + len(got)]
            out[k, :len(got)] = np.where(whole, got, -1)
        return out


def _blocks_of_texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about BLOCK_BYTES with the row each begins at; null texts are empty."""
    texts = batch.column(column).fill_null("")
    sizes = np.array([len(t) for t in texts.cast(pa.large_binary()).to_pylist()], np.int64)
    run = (np.cumsum(sizes) - sizes) // BLOCK_BYTES
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    for first, end in zip(starts, [*starts[1:], len(sizes)]):
        yield int(first), texts.slice(first, end - first)


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket. Each task sends one row per bucket."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _blocks_of_texts(batch, 0):
                for _, found in Words(texts).buckets(buckets):
                    total += np.bincount(found[found >= 0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(counted, "bucket int, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """What each bucket is worth, in thousandths of a natural logarithm, as an array with an entry per bucket."""
    counts = (
        bucket_counts(docs, text_col, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
        .unionByName(bucket_counts(target, text_col, buckets)
                     .select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
        .groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
        .collect()  # a row per bucket
    )
    n_source, n_target = sum(r["s"] for r in counts), sum(r["t"] for r in counts)
    gains = np.zeros(buckets, np.int64)
    for r in counts:
        share = (r["t"] + 1) * (n_source + buckets) / ((r["s"] + 1) * (n_target + buckets))
        gains[r["bucket"]] = int(np.floor(1000 * np.log(share)))
    return gains


def weights(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of every row: the summed worth of its features."""
    buckets = len(gains)
    shared = docs.sparkSession.sparkContext.broadcast(np.append(gains, 0))  # the last entry is that of no feature

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, texts in _blocks_of_texts(batch, 1):
                words = Words(texts)
                worth = np.zeros(len(words.starts) + 1, np.int64)
                for first, found in words.buckets(buckets):
                    worth[first + 1:first + 1 + found.shape[1]] = shared.value[found].sum(axis=0)
                worth = np.cumsum(worth)
                ends = np.searchsorted(words.text_of, np.arange(len(texts)), side="right")
                starts = np.append(0, ends[:-1])
                n_words[row:row + len(texts)] = ends - starts
                weight[row:row + len(texts)] = worth[ends] - worth[starts]
            n_features = n_words + np.maximum(n_words - 1, 0) + np.maximum(n_words - 2, 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_features), pa.array(weight)],
                ["id", "n_words", "n_features", "weight"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(weighed, f"id {id_type}, n_words long, n_features long, weight long")


def gumbel_noise(id_: Column, seed: int) -> Column:
    """Noise in thousandths, from a hash of the seed and the id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    even = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(even)))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """Every document's (id, n_words, n_features, weight, score, rank); rank is null where it is not drawn.

    Of the documents with ``least_words`` words or more, ``percent`` percent (rounded down) with the highest scores are
    drawn, ties to the smaller id, rows without an id last; rows that are repeated are drawn each for itself, in no order.
    A null text has no words, as an empty one: weight 0, never drawn unless ``least_words`` is 0. Empty ``docs`` give no
    rows; with an empty target only the documents' own frequencies count. Other columns are not read.

    Texts are read twice, once for the buckets and once for the weights; only rows that can be among the drawn are sorted.
    """
    gains = bucket_gains(docs, target, text_col, buckets)
    scored = weights(docs, gains, id_col, text_col).withColumn("score", F.col("weight") + gumbel_noise(F.col("id"), seed))
    # The number tells repeated rows apart, so that no run of equal rows has to meet in one task.
    rows = written(scored.withColumn("number", F.monotonically_increasing_id()), "weights")
    eligible = rows.filter(F.col("n_words") >= least_words)
    at = max(0.0, 1 - percent / 100 - 2 / SKETCH)
    total, least = eligible.agg(F.count(F.lit(1)), F.percentile_approx("score", F.lit(at), F.lit(SKETCH))).first()
    n_drawn = percent * total // 100
    can_be = F.lit(False) if not n_drawn else (F.col("n_words") >= least_words) & (F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("number")]
    ranked = number_rows(rows.filter(can_be), order, "place").withColumn(
        "rank", F.when(F.col("place") <= n_drawn, F.col("place").cast("long"))
    )
    columns = ["id", "n_words", "n_features", "weight", "score", "rank"]
    rest = rows.filter(~can_be).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*columns).unionByName(rest.select(*columns))


@query(
    "op11_importance_resampling",
    f"""
WITH t AS MATERIALIZED (
  SELECT 'd' AS side, row_number() OVER () AS k, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (), item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') FROM benchmark
), f AS MATERIALIZED (
  SELECT side, k, feature, count(*) AS n FROM (
    SELECT side, k, unnest(list_concat(
      w,
      list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
      list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS feature
    FROM t) GROUP BY ALL
), crc(value, crc) AS (
  SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) FROM range(256) r(b)
), tab AS (SELECT list(crc ORDER BY value) AS crcs FROM crc
), h AS MATERIALIZED (
  SELECT feature, xor(list_reduce(
    list_transform(range(strlen(feature)), lambda i: ('0x' || substr(hex(encode(feature)), 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(crcs[xor(c, b) % 256 + 1], c // 256), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM f), tab
), g AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain
  FROM (SELECT bucket, sum(CASE WHEN side = 'd' THEN n ELSE 0 END)::DOUBLE AS s, sum(CASE WHEN side = 'b' THEN n ELSE 0 END)::DOUBLE AS t
        FROM f JOIN h USING (feature) GROUP BY bucket)
), weight AS (
  SELECT k, sum(n * gain)::BIGINT AS weight FROM f JOIN h USING (feature) JOIN g USING (bucket) WHERE side = 'd' GROUP BY k
), scored AS (
  SELECT id AS doc_id, len(w)::BIGINT AS n_words,
         (len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0))::BIGINT AS n_features,
         coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln(
           (('0x' || substr(sha256('42:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM t LEFT JOIN weight USING (k) WHERE side = 'd'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) FILTER (n_words >= 20) OVER () AS eligible FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= 5 * eligible // 100 THEN place END AS rank, n_words
FROM ranked
""",
)
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank", "n_words")
