"""Line dedup with a segment-partition edit join.

Lines that are equal, or within EDITS edits of each other, form classes; the first line of a class stays, the others go.

Two lines within k edits share one of the k + 1 segments that the shorter is cut into, at nearly the same place. So each
line is indexed by its segments, by length and segment number, and looks for the segments of lines up to k shorter, at the
few places where an alignment can have them. Lines that meet are verified by an edit distance in bits along a diagonal
band of 2 k + 1 rows.

Equal lines are one node from the start. The keys of the segments are dealt out and sorted once, and tasks go through them:
few nodes that share a segment give their pairs; a segment that many share is verified in blocks inside tasks, which hand
on only the edges that connect what is near.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import discard, join_groups, query, release_shuffles, table, written
from listwright.llm.components import components
from listwright.llm.near_dedup import in_filter, key_filter

#: Lines within so many edits are near. Only lines of at least EDIT_CHARS characters are compared so; lines of at least
#: LEAST_CHARS go if they are equal to another, and shorter ones stay.
EDITS = 2
EDIT_CHARS = 40
LEAST_CHARS = 20
#: White space around a line does not count.
BLANKS = " \t\r"
SMALL_BUCKET = 16
BLOCK = 256
#: How many nodes a task remembers, so that a line that it meets again gives no keys again.
SEEN = 100_000


def segments(length: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """(start, size) of the edits + 1 segments of a line; the last ones are a character longer where it does not divide."""
    n = edits + 1
    sizes = [length // n + (k >= n - length % n) for k in range(n)]
    return [(sum(sizes[:k]), sizes[k]) for k in range(n)]


def probes(length: int, edits: int = EDITS) -> list[tuple[int, int, int, int]]:
    """(length, segment, start, size): where a line of ``length`` looks for the segments of lines up to ``edits`` shorter.

    Before a segment that is matched there are as many edits at most as segments before it, and after it as many as
    segments after it; that bounds how far it can have moved.
    """
    out = []
    for shorter in range(max(edits + 1, length - edits), length + 1):
        gap = length - shorter
        for k, (start, size) in enumerate(segments(shorter, edits)):
            low = max(0, start - k, start + gap - (edits - k))
            high = min(length - size, start + k, start + gap + (edits - k))
            out += [(shorter, k, at, size) for at in range(low, high + 1)]
    return out


def within(a: str, b: str, k: int = EDITS) -> bool:
    """Whether the edit distance of two strings is at most ``k``.

    The differences between neighbouring cells of the distance table are bits; a column keeps the 2 k + 1 rows around its
    diagonal (bit r of column j is row j - k + r). Cells outside count as large as they can be, which no path of k edits
    or fewer needs. Rows above the first stand for a table that grows upwards. The distance is followed along the diagonal
    of the last cell, where it never falls.
    """
    if a == b:
        return True
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > k:
        return False
    head = 0
    while head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head:len(a) - tail], b[head:len(b) - tail]
    places: dict[str, int] = defaultdict(int)
    for i, c in enumerate(a):
        places[c] |= 1 << i
    width = 2 * k + 1
    every, top = (1 << width) - 1, 1 << (width - 1)
    down = every >> (k + 1) << (k + 1)  # the table grows by one from row to row
    up = every >> k  # it falls by one
    distance = len(a) - len(b)
    watched = 1 << (k + distance)
    for j, c in enumerate(b):
        here = places.get(c, 0)
        equal = (here >> (j - k) if j >= k else here << (k - j)) & every
        down, up = down >> 1 | top, up >> 1
        x = equal | up
        diagonal = (((x & down) + down) ^ down | x) & every
        distance += not diagonal & watched
        if distance > k:
            return False
        right = up | ~(down | diagonal) & every  # grows from column to column
        left = down & diagonal
        right, left = (right << 1 | 1) & every, left << 1 & every
        down = left | ~(diagonal | right) & every
        up = diagonal & right
    return True


def _lines(text: str | None) -> Iterator[tuple[bytes, str]]:
    """(node, line) of the lines that are long enough for the edit join."""
    for line in (text or "").split("\n"):
        line = line.strip(BLANKS)
        if len(line) >= EDIT_CHARS:
            yield hashlib.md5(line.encode(), usedforsecurity=False).digest(), line


def _short(nodes: list[bytes]) -> np.ndarray:
    """The first half of each node. What meets by it is verified with the whole lines, so two lines may share it."""
    return np.frombuffer(b"".join(nodes), ">i8")[::2].astype(np.int64)


@lru_cache(4096)
def _places(length: int, edits: int) -> tuple[list[tuple[int, int, int]], list[bool]]:
    """(seed, start, end) of each segment key of a line, in bytes of UTF-32, and which of them are its own segments. The
    seed stands for the length and the number of the segment."""
    own = {(length, k, start, size) for k, (start, size) in enumerate(segments(length, edits))}
    places = probes(length, edits)
    return [(m * (edits + 1) + k, 4 * at, 4 * (at + size)) for m, k, at, size in places], [place in own for place in places]


def _keys(edits: int):
    """(text) to (key, short, indexed): a row for each segment key of each line, indexed or only looked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest, seen = xxhash.xxh3_64_intdigest, set()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                keys, nodes, counts, indexed = [], [], [], []
                for text in batch.column(0).slice(start, 256):
                    for node, line in _lines(text.as_py()):
                        if node in seen:
                            continue
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(node)
                        places, own = _places(len(line), edits)
                        chars = line.encode("utf-32-le")
                        keys += [digest(chars[at:end], seed) for seed, at, end in places]
                        indexed += own
                        nodes.append(node)
                        counts.append(len(places))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.repeat(_short(nodes), counts)),
                     pa.array(indexed, pa.bool_())],
                    names=["key", "short", "indexed"],
                )

    return run


def _distinct(rows: list[np.ndarray]) -> list[np.ndarray]:
    """(key, short, indexed) by key and short, each pair once, indexed if any of its rows is."""
    order = np.lexsort((~rows[2], rows[1], rows[0]))
    key, short, indexed = (c[order] for c in rows)
    first = np.append(True, (key[1:] != key[:-1]) | (short[1:] != short[:-1]))[:len(key)]
    return [key[first], short[first], indexed[first]]


def _met_rows(key: np.ndarray | None, a: np.ndarray, b: np.ndarray | None, indexed: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays(
        [none if key is None else pa.array(key), pa.array(a), none if b is None else pa.array(b), pa.array(indexed, pa.bool_())],
        names=["key", "a", "b", "indexed"],
    )


def _of_groups(rows: list[np.ndarray], small: int) -> Iterator[pa.RecordBatch]:
    """What ``_met`` gives for whole groups."""
    if not len(rows[0]):
        return
    same = rows[0][1:] == rows[0][:-1]
    shared = np.append(False, same) | np.append(same, False)
    key, short, indexed = _distinct([c[shared] for c in rows])
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    sizes = np.diff(np.append(starts, len(key)))
    large = np.repeat(sizes > small, sizes)
    if large.any():
        yield _met_rows(key[large], short[large], None, indexed[large])
    for size in np.unique(sizes[(sizes > 1) & (sizes <= small)]):
        at = starts[sizes == size, None] + np.arange(size)
        i, j = (at[:, k].ravel() for k in np.triu_indices(size, 1))
        looked_for = indexed[i] | indexed[j]
        i, j = i[looked_for], j[looked_for]
        yield _met_rows(None, short[i], short[j], np.ones(len(i), bool))


def _met(small: int):
    """(key, short, indexed) in order of the keys to (key, a, b, indexed): the pairs (a, b) of nodes that share a key and of
    which one is indexed there, without the key; of a key that more than ``small`` nodes share its rows instead, as a.

    The rows of the last key wait for the next batch; those of a crowded key go on as they come.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, crowded = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)], None
        for batch in batches:
            rows = [np.append(c, new.to_numpy(zero_copy_only=False)) for c, new in zip(rows, batch.columns)]
            if crowded is not None:
                more = rows[0] == crowded
                yield _met_rows(rows[0][more], rows[1][more], None, rows[2][more])
                rows = [c[~more] for c in rows]
            if not len(rows[0]):
                continue
            last = rows[0] == rows[0][-1]
            yield from _of_groups([c[~last] for c in rows], small)
            rows, crowded = _distinct([c[last] for c in rows]), None
            if len(rows[0]) > small:
                crowded = rows[0][0]
                yield _met_rows(rows[0], rows[1], None, rows[2])
                rows = [c[:0] for c in rows]
        yield from _of_groups(rows, small)

    return run


def _found_lines(bits):
    """(text) to (short, node, line) of the lines whose short is in the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                found = {node: line for text in batch.column(0).slice(start, 256) for node, line in _lines(text.as_py())}
                nodes = list(found)
                short = _short(nodes)
                hits = np.flatnonzero(in_filter(bits.value, short))
                nodes = [nodes[k] for k in hits]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(short[hits]), pa.array(nodes, pa.binary()), pa.array([found[n] for n in nodes], pa.string())],
                    names=["short", "node", "line"],
                )

    return run


def _near(edits: int):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([within(x.as_py(), y.as_py(), edits) for x, y in zip(a, b)], pa.bool_())

    run.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return run


def _near_in_block(edits: int):
    """The nodes of two blocks that share a segment to (a, b): edges that connect the near ones.

    Lines whose counts of characters (in 64 classes) differ by more than the edits can change are not compared.
    """
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        i, j = (group.column(c)[0].as_py() for c in ("i", "j"))
        nodes, lines = group.column("node").to_pylist(), group.column("line").to_pylist()
        block, indexed = np.array(group.column("block").to_pylist()), np.array(group.column("indexed").to_pylist(), bool)
        bags = np.zeros((len(lines), 64), np.int32)
        for k, line in enumerate(lines):
            np.add.at(bags[k], np.frombuffer(line.encode("utf-32-le"), "<u4") % 64, 1)
        rows, cols = np.flatnonzero(block == i), np.flatnonzero(block == j)
        parent, edges = list(range(len(nodes))), []

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for x in rows:
            others = cols[cols > x] if i == j else cols
            others = others[indexed[others] | indexed[x]]
            for y in others[np.abs(bags[others] - bags[x]).sum(axis=1) <= 2 * edits]:
                p, q = root(int(x)), root(int(y))
                if p != q and within(lines[x], lines[y], edits):
                    parent[max(p, q)] = min(p, q)
                    edges.append((nodes[x], nodes[y]))
        return pa.table({"a": pa.array([a for a, _ in edges], pa.binary()), "b": pa.array([b for _, b in edges], pa.binary())})

    run.__annotations__ = {"group": pa.Table, "return": pa.Table}
    return run


def near_lines(texts: DataFrame, edits: int = EDITS) -> DataFrame:
    """(a, b): edges that connect the lines (MD5 of each) of ``texts`` (column text) that are within ``edits`` edits."""
    spark = texts.sparkSession
    keys = texts.select("text").mapInArrow(_keys(edits), "key long, short long, indexed boolean")
    met = keys.repartition("key").sortWithinPartitions("key").mapInArrow(_met(SMALL_BUCKET), "key long, a long, b long, indexed boolean")
    met = written(met, "line-buckets")
    release_shuffles(spark)
    pairs = written(met.filter("key is null").select("a", "b").distinct(), "line-pairs")
    rows = met.filter("key is not null").select("key", F.col("a").alias("short"), "indexed")
    # n counts rows; a node that tasks met apart may count more than once, which at worst makes more blocks.
    crowded = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bool_or("indexed").alias("any")).filter("any")
    crowded = crowded.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    large = rows.join(crowded, "key").groupBy("key", "short", "blocks").agg(F.bool_or("indexed").alias("indexed"))
    large = written(large.withColumn("block", F.pmod(F.xxhash64("short"), F.col("blocks")).cast("int")), "line-blocks")

    # Candidates' texts are read again, found by a filter of fixed size.
    needed = pairs.select(F.col("a").alias("short")).unionByName(pairs.select(F.col("b").alias("short"))).unionByName(large.select("short"))
    needed = written(needed.distinct(), "line-candidates")
    bits = spark.sparkContext.broadcast(key_filter(needed.select(F.col("short").alias("key"))))
    lines = texts.select("text").mapInArrow(_found_lines(bits), "short long, node binary, line string")
    lines = written(lines.dropDuplicates(["short", "node"]).join(needed, "short"), "candidate-lines")

    near = F.arrow_udf(_near(edits), "boolean")("line_a", "line_b")
    verified = pairs.join(lines.select(F.col("short").alias("a"), F.col("node").alias("node_a"), F.col("line").alias("line_a")), "a").join(
        lines.select(F.col("short").alias("b"), F.col("node").alias("node_b"), F.col("line").alias("line_b")), "b"
    ).filter(near).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    spread = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "short", "indexed", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    in_blocks = spread.join(lines, "short").groupBy("key", "i", "j").applyInArrow(_near_in_block(edits), "a binary, b binary")
    near_ = written(verified.unionByName(in_blocks).distinct(), "near-lines")
    discard(met, pairs, large, needed, lines)
    return near_


def repeated_lines(docs: DataFrame, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, dropped): for each row of ``docs`` (key: xxhash64(id, text)) the numbers, from 0, of its lines that go.

    Of a class of near lines, that with the smallest (id, key, line number) stays; rows without an id come last. Rows
    without such lines are not there. Rows repeated with the same id and text are one.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    lines = source.select("id", "key", F.posexplode(F.split("text", "\n")).alias("number", "line"))
    line = F.btrim("line", F.lit(BLANKS))
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "number")
    lines = written(
        lines.filter(F.length(line) >= LEAST_CHARS).select(place.alias("place"), F.unhex(F.md5(line)).alias("node")), "lines"
    )
    nodes = written(lines.groupBy("node").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")), "line-nodes")
    edges = near_lines(source, edits)
    found = written(components(edges).join(nodes, "node"), "line-classes")
    classes = written(found.groupBy("component").agg(F.min("first").alias("stays"), F.count(F.lit(1)).alias("n_nodes")), "line-class-firsts")
    classed = join_groups(found.select("node", "component"), classes, "component", "n_nodes", found.count()).select("node", "stays")
    groups = nodes.join(classed, "node", "left").withColumn("stays", F.coalesce("stays", "first"))
    groups = written(groups.filter((F.col("n") > 1) | (F.col("stays") != F.col("first"))).select("node", "stays", "n"), "line-groups")
    discard(edges, nodes, found, classes)
    dropped = join_groups(lines, groups, "node", "n", lines.count()).filter(F.col("place") != F.col("stays"))
    # A row's own lines only.
    return dropped.groupBy(F.col("place.key").alias("key")).agg(F.sort_array(F.collect_set("place.number")).alias("dropped"))


def kept_text(text: Column, dropped: Column) -> Column:
    kept = F.filter(F.split(text, "\n"), lambda line, number: ~F.array_contains(dropped, number))
    return F.when(dropped.isNull(), text).otherwise(F.array_join(kept, "\n"))


def _joined(docs: DataFrame, edits: int, id_col: str, text_col: str) -> tuple[DataFrame, Column]:
    """``docs`` and, in a second column set, the numbers of the lines that go."""
    gone = written(repeated_lines(docs, edits, id_col, text_col), "dropped-lines")
    release_shuffles(docs.sparkSession)
    joined = docs.join(gone.hint("shuffle_hash"), F.xxhash64(docs[id_col], docs[text_col]) == gone["key"], "left")
    return joined, gone["dropped"]


def with_dropped(docs: DataFrame, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the column dropped_lines: the numbers of the lines that go, null where all stay. A column of that
    name that was there before is replaced."""
    joined, dropped = _joined(docs, edits, id_col, text_col)
    return joined.select(*[docs[c] for c in docs.columns if c != "dropped_lines"], dropped.alias("dropped_lines"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without lines that are near another that comes before; rows that lose all their text go.

    Same columns. Null and empty texts, texts without repeated lines, and lines shorter than LEAST_CHARS stay as they are.
    """
    joined, dropped = _joined(docs, edits, id_col, text_col)
    text = kept_text(docs[text_col], dropped)
    left = joined.filter(dropped.isNull() | (F.btrim(text, F.lit(BLANKS + "\n")) != ""))
    return left.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])


@query("op6_line_dedup")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_dropped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    return found.select(
        "doc_id", F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.coalesce(F.array_size("dropped_lines"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join(F.col("dropped_lines").cast("array<string>"), ","), F.lit("")).alias("dropped"),
        F.sha2(F.coalesce(kept_text(F.col("text"), F.col("dropped_lines")), F.lit("")), 256).alias("kept_sha256"),
    )
