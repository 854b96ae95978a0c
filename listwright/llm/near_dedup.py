"""Near duplicates: a Jaccard join on word n-grams by MinHash banding.

Texts become sets of hashed n-grams. Texts with the same set are copies and one node. Nodes that agree in all rows of a
band of their MinHash signature meet in a bucket; the number of bands is chosen for a target recall. Pairs of a bucket are
verified on the full n-gram sets.

A small bucket gives its pairs. A large one is cut into blocks, and each pair of blocks is one group whose pairs are
verified inside the task: it hands on the number of links of each node and as few edges as connect what is linked, so no
rows are made for the pairs of a large group, and none is left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import WORD, discard, join_groups, query, table, written
from listwright.llm.components import components

NGRAM = 5
THRESHOLD = 0.8
#: Of the pairs at the threshold, so many meet in a bucket at least; more similar ones more often.
RECALL = 0.9995
MOST_HASHES = 128
#: Buckets up to this size give their pairs as rows; larger ones are verified in blocks of about BLOCK nodes.
SMALL_BUCKET = 16
BLOCK = 512
#: Bits of the filter that finds the texts of candidates again: fixed, so that what is broadcast is 2 MB at any size.
#: When many candidates fill it, more texts are read again than needed, and the join after it drops them.
FILTER_BITS = 1 << 24
CACHE_WORDS = 200_000
#: N-grams compared at once in a block.
COLUMNS = 4096

_WORD = re.compile(WORD)
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_hashes: dict[str, int] = {}


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which the bands that the recall takes stay within the hashes."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngrams(text: str | None, n: int = NGRAM) -> np.ndarray:
    """The hashes (64 bits) of a text's word n-grams, ascending, once each. Fewer than n words are one n-gram."""
    import xxhash

    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(_hashes) > CACHE_WORDS:
        _hashes.clear()
    known = _hashes
    for word in words:
        if word not in known:
            known[word] = xxhash.xxh3_64_intdigest(word)
    h = np.array([known[w] for w in words], np.uint64)
    out = h[:max(1, len(h) - n + 1)].copy()
    for k in range(1, min(n, len(h))):
        out = out * _MULTIPLY + h[k:k + len(out)]
    return np.unique(_mixed(out))


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash for each band, of its number and its rows' minima."""
    seeds = _mixed(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * _MULTIPLY)
    factors, offsets = seeds[::2] | np.uint64(1), seeds[1::2]
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 8192):
        part = grams[at:at + 8192]
        np.minimum(least, (np.multiply.outer(factors, part) + offsets[:, None]).min(axis=1), out=least)
    out = _mixed(np.arange(bands, dtype=np.uint64) + np.uint64(1))
    for r in range(rows):
        out = _mixed(out * _MULTIPLY + least.reshape(bands, rows)[:, r])
    return out


def _node(grams: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(grams.tobytes())


def _signatures(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, signatures = [], [], []
            for text in batch.column(3):
                grams = ngrams(text.as_py())
                sizes.append(len(grams))
                nodes.append(_node(grams) if len(grams) else None)
                signatures.append(band_hashes(grams, bands, rows).tobytes() if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()),
                 pa.array(signatures, pa.binary())],
                names=["id", "key", "number", "node", "n_grams", "signature"],
            )
        _hashes.clear()  # the worker goes on to other tasks

    return run


def _split_signature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, signature) to (bucket, band, node)."""
    for batch in batches:
        data = batch.column(1).to_pylist()
        if not data:
            continue
        buckets = np.frombuffer(b"".join(data), np.int64)
        bands = len(buckets) // len(data)
        yield pa.RecordBatch.from_arrays(
            [pa.array(buckets), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(data))),
             batch.column(0).take(pa.array(np.repeat(np.arange(len(data)), bands)))],
            names=["bucket", "band", "node"],
        )


def key_filter(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit set of fixed size with the bit of each key (a 64-bit hash) set."""
    words = keys.groupBy(F.expr(f"pmod(key, {bits}L) div 64").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(key, {bits}L) % 64 as int))")).alias("bits")
    )
    out = np.zeros(bits // 64, np.int64)
    for row in words.toLocalIterator():  # bits / 64 rows at most
        out[row["word"]] = row["bits"]
    return out.view(np.uint64)


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.mod(keys, len(bits) * 64)
    return (bits[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1


def _candidate_sets(bits):
    """(key, text) to (node, grams) of the texts whose key is in the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.flatnonzero(in_filter(bits.value, batch.column(0).to_numpy()))
            nodes, sets = [], []
            for text in batch.column(1).take(pa.array(found)):
                grams = ngrams(text.as_py())
                if len(grams):
                    nodes.append(_node(grams))
                    sets.append(grams.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], names=["node", "grams"])
        _hashes.clear()

    return run


def _grams(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _first_common_large(a: np.ndarray, b: np.ndarray, large: np.ndarray) -> np.ndarray:
    """The first band in which two signatures agree and the bucket is large, else -1; for all pairs of rows."""
    same = (a[:, None, :] == b[None, :, :]) & large[:, None, :]
    return np.where(same.any(axis=2), same.argmax(axis=2), -1)


def _apart(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Whether two nodes (signatures, and the first's large bands as bits) meet in small buckets only."""
    for one, two, large in batches:
        bands = [np.frombuffer(b"".join(s.to_pylist()), np.int64).reshape(len(s), -1) for s in (one, two)]
        masks = large.fill_null(0).to_numpy(zero_copy_only=False)
        is_large = (masks[:, None] >> np.arange(bands[0].shape[1])) & 1 == 1
        yield pa.array(~((bands[0] == bands[1]) & is_large).any(axis=1))


def _similar(threshold: float):
    """Whether the Jaccard similarity of two sets of n-grams is at or above the threshold."""
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for one, two in batches:
            out = []
            for g, h in zip(one, two):
                x, y = _grams(g.as_py()), _grams(h.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both / (len(x) + len(y) - both) >= threshold)
            yield pa.array(out, pa.bool_())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return run


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each of ``a`` shares with each of ``b``."""
    values = np.unique(np.concatenate(a))
    values = values[np.isin(values, np.concatenate(b))]
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(values), COLUMNS):
        part = values[at:at + COLUMNS]

        def matrix(sets: list[np.ndarray]) -> np.ndarray:
            m = np.zeros((len(sets), len(part)), np.float32)
            for k, grams in enumerate(sets):
                place = np.searchsorted(part, grams)
                place[place == len(part)] = 0
                m[k, place[part[place] == grams]] = 1.0
            return m

        out += matrix(a) @ matrix(b).T
    return out


def _verify_block(threshold: float):
    """The nodes of two blocks of a large bucket to (a, b, links): edges that connect the linked, and counts of links.

    A pair counts in the first large bucket that it shares, and nowhere else.
    """
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        band, i, j = (group.column(c)[0].as_py() for c in ("band", "i", "j"))
        nodes = group.column("node").to_pylist()
        block = np.array(group.column("block").to_pylist())
        signatures = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.int64).reshape(len(nodes), -1)
        masks = np.array(group.column("large").to_pylist(), np.int64)
        large = (masks[:, None] >> np.arange(signatures.shape[1])) & 1 == 1
        sets = [_grams(g) for g in group.column("grams").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        rows, cols = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links, parent, edges = np.zeros(len(nodes), np.int64), list(range(len(nodes))), []

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        if len(rows) and len(cols):
            for at in range(0, len(rows), 128):
                own = rows[at:at + 128]
                both = _overlaps([sets[k] for k in own], [sets[k] for k in cols])
                good = both / (sizes[own][:, None] + sizes[cols][None, :] - both) >= threshold
                good &= _first_common_large(signatures[own], signatures[cols], large[own]) == band
                if i == j:
                    good &= own[:, None] < cols[None, :]
                for x, y in zip(*np.nonzero(good)):
                    p, q = int(own[x]), int(cols[y])
                    links[p] += 1
                    links[q] += 1
                    p_, q_ = root(p), root(q)
                    if p_ != q_:
                        parent[max(p_, q_)] = min(p_, q_)
                        edges.append((nodes[p], nodes[q]))
        counted = np.flatnonzero(links)
        return pa.table({
            "a": pa.array([a for a, _ in edges] + [nodes[k] for k in counted], pa.binary()),
            "b": pa.array([b for _, b in edges] + [None] * len(counted), pa.binary()),
            "links": pa.array([0] * len(edges) + links[counted].tolist(), pa.int64()),
        })

    run.__annotations__ = {"group": pa.Table, "return": pa.Table}
    return run


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", number_col: str | None = None
) -> DataFrame:
    """(id, key, number, class_id, n_links, n_copies, kept), a row for each row of ``docs``.

    Texts are linked if the Jaccard similarity of their n-gram sets is at or above the threshold; a class is what links
    connect, named by its smallest id. n_links counts the different sets linked to the row's own, n_copies the rows with
    the same set. ``key`` is xxhash64(id, text). ``number`` tells rows apart: that of ``number_col``, or one made here. One
    row of each class is ``kept``, that with the smallest (id, key, number), rows without an id last.

    Texts without words, null ones among them, link to nothing and are each a class. A row without an id takes part; a
    class of such rows alone has a null class_id. Repeated rows are copies of each other. Other columns are not read.
    """
    spark = docs.sparkSession
    bands, rows_ = choose_bands(threshold)
    ids = F.col(id_col).cast("long").alias("id")
    number = F.col(number_col) if number_col else F.monotonically_increasing_id()
    source = docs.select(ids, F.xxhash64(id_col, text_col).alias("key"), number.alias("number"), F.col(text_col).alias("text"))
    signed = written(source.mapInArrow(
        _signatures(bands, rows_), "id long, key long, number long, node binary, n_grams int, signature binary"
    ), "signatures")
    rows = signed.filter(F.col("node").isNotNull()).select("id", "key", "number", "node")
    nodes = written(
        signed.filter(F.col("node").isNotNull()).groupBy("node").agg(
            F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "number")).alias("first"), F.count(F.lit(1)).alias("n_copies"),
            F.min("n_grams").alias("n_grams"), F.any_value("signature").alias("signature"),
        ).select("node", "first", F.col("first.key").alias("key"), "n_copies", "n_grams", "signature"),
        "nodes",
    )
    members = written(
        nodes.select("node", "signature").mapInArrow(_split_signature, "bucket long, band int, node binary"), "buckets"
    )
    buckets = members.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b")
    ).filter("n > 1")
    buckets = written(buckets, "shared-buckets")

    # Pairs of small buckets; two nodes are the least and the greatest, more meet in a self join within the bucket.
    more = written(members.join(buckets.filter("n > 2").select("bucket", "n"), "bucket"), "shared-members")
    few = more.filter(F.col("n") <= SMALL_BUCKET).select("bucket", "node")
    pairs = buckets.filter("n = 2").select("a", "b").unionByName(
        few.withColumnRenamed("node", "a").join(few.withColumnRenamed("node", "b"), "bucket").filter("a < b").select("a", "b")
    )
    pairs = pairs.distinct()
    large = more.filter(F.col("n") > SMALL_BUCKET).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    large = large.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    masks = large.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, band)")).alias("large"))

    # Pairs that also meet in a large bucket are left to it, and sets of too different sizes cannot be similar: both show
    # before any set is read.
    thin = nodes.select("node", "n_grams", "signature").join(masks, "node", "left")
    one = thin.select(F.col("node").alias("a"), F.col("n_grams").alias("na"), F.col("signature").alias("sa"), "large")
    two = thin.select(F.col("node").alias("b"), F.col("n_grams").alias("nb"), F.col("signature").alias("sb"))
    pairs = pairs.join(one, "a").join(two, "b").filter(F.least("na", "nb") >= F.greatest("na", "nb") * threshold)
    pairs = written(pairs.filter(F.arrow_udf(_apart, "boolean")("sa", "sb", "large")).select("a", "b"), "pairs")

    # The n-gram sets of the nodes that have partners: their texts are read again, found by a filter of fixed size.
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(large.select("node"))
    needed = written(
        needed.distinct().join(nodes.select("node", "key", "signature"), "node").join(masks, "node", "left"), "candidates"
    )
    bits = spark.sparkContext.broadcast(key_filter(needed.select("key")))
    sets = source.select("key", "text").mapInArrow(_candidate_sets(bits), "node binary, grams binary")
    sets = written(sets.dropDuplicates(["node"]).join(needed.drop("key"), "node"), "candidate-sets")

    one, two = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    verified = F.arrow_udf(_similar(threshold), "boolean")("ga", "gb")
    linked = written(pairs.join(one, "a").join(two, "b").filter(verified).select("a", "b"), "links")

    # Each node goes to the pairs of blocks that its own is in.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = large.withColumn("other", other).select(
        "bucket", "band", "node", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    blocks = spread.join(sets, "node").groupBy("bucket", "i", "j").applyInArrow(_verify_block(threshold), "a binary, b binary, links long")
    blocks = written(blocks, "block-links")

    edges = linked.unionByName(blocks.filter(F.col("b").isNotNull()).select("a", "b"))
    counts = linked.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("long").alias("links")).unionByName(
        blocks.filter(F.col("b").isNull()).select(F.col("a").alias("node"), "links")
    ).groupBy("node").agg(F.sum("links").alias("n_links"))

    found = written(components(edges).join(nodes.select("node", "first"), "node"), "components")
    classes = written(found.groupBy("component").agg(F.min("first").alias("stays"), F.count(F.lit(1)).alias("n")), "classes")
    classed = join_groups(found.select("node", "component"), classes, "component", "n", found.count()).select("node", "stays")
    stays = F.coalesce("stays", "first")
    answers = nodes.select("node", "first", "n_copies").join(classed, "node", "left").join(counts, "node", "left").select(
        "node", "n_copies", stays["id"].alias("class_id"), stays["number"].alias("stays"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    answers = written(answers, "answers")
    discard(nodes, members, buckets, more, pairs, needed, sets, linked, blocks, found, classes)
    result = join_groups(rows, answers, "node", "n_copies", rows.count()).select(
        "id", "key", "number", "class_id", "n_links", "n_copies", (F.col("number") == F.col("stays")).alias("kept")
    )
    alone = signed.filter(F.col("node").isNull()).select(
        "id", "key", "number", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
        F.lit(1).cast("long").alias("n_copies"), F.lit(True).alias("kept"),
    )
    return result.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, one with the smallest id; same columns.

    Of rows repeated with the same id one stays at most. Of a class without ids one row stays.
    """
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    numbered = written(docs.select(row, F.monotonically_increasing_id().alias("number")), "numbered")
    source = numbered.select(F.col("row")[id_col].alias("id"), F.col("row")[text_col].alias("text"), "number")
    found = near_duplicates(source, threshold, "id", "text", "number")
    gone = written(found.filter(~F.col("kept")).select("number"), "dropped")
    return numbered.join(gone.hint("shuffle_hash"), "number", "left_anti").select("row.*")


@query("op9_near_duplicates")
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "class_id", "n_links", "n_copies", "kept"
    )
