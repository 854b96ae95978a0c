"""Sharding along a Hilbert curve.

Language, source and size are quantised to a grid; rows are ordered by the curve index of their cell and the order is
cut into runs of equal row counts. Neighbours on the curve are neighbours in every dimension, so a shard covers a
small box of the grid and a reader can skip shards by any of the dimensions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwright.llm.common import query, table, written

DIMENSIONS = 3
#: Bits for each dimension: a grid of (2 ** 4) ** 3 = 4096 cells.
BITS = 4
#: Rows of a cell are numbered in groups of about so many, so that a hot cell is spread over many tasks.
GROUP_ROWS = 256


def hilbert_cells(spark: SparkSession, dims: int = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """(cell, curve): the place on the curve of each cell; 2 ** (dims * bits) rows.

    ``cell`` packs the coordinates, the first in the highest bits. The transform to the curve index walks the bits
    from the highest down: where a coordinate has the bit, the lower bits of the first coordinate are inverted, else
    they are swapped between the two; a Gray code of what comes out, read bit by bit across the dimensions, is the index.
    """
    side = 1 << bits
    axes = F.array(*[
        F.shiftright("cell", bits * (dims - 1 - k)).bitwiseAND(side - 1).cast("long") for k in range(dims)
    ])
    steps = F.array(*[
        F.struct(F.lit(1 << b).cast("long").alias("bit"), F.lit(k).alias("axis"))
        for b in range(bits - 1, 0, -1) for k in range(dims)
    ])

    def put(xs: Column, first: Column, axis: Column, value: Column) -> Column:
        return F.transform(xs, lambda x, i: F.when(i == axis, value).when(i == 0, first).otherwise(x))

    def step(xs: Column, s: Column) -> Column:
        low = s["bit"] - 1
        x0, xk = F.element_at(xs, 1), F.element_at(xs, s["axis"] + 1)
        swap = x0.bitwiseXOR(xk).bitwiseAND(low)
        inverted = x0.bitwiseXOR(low)
        has = xk.bitwiseAND(s["bit"]) != 0
        return F.when(has, put(xs, inverted, F.lit(-1), x0)).when(s["axis"] == 0, xs).otherwise(
            put(xs, x0.bitwiseXOR(swap), s["axis"], xk.bitwiseXOR(swap))
        )

    df = spark.range(1 << (dims * bits)).select(F.col("id").alias("cell"))
    df = df.withColumn("x", F.aggregate(steps, axes, step))
    # Gray code: each coordinate takes in the one before it; then the last one's prefix parity goes into all.
    gray = F.aggregate(
        F.col("x"), F.array().cast("array<bigint>"),
        lambda done, x: F.concat(done, F.array(x.bitwiseXOR(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0).cast("long"))))),
    )
    df = df.withColumn("x", gray)
    last = F.element_at("x", dims)
    parity = F.aggregate(
        F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]),
        F.lit(0).cast("long"),
        lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t),
    )
    df = df.withColumn("t", parity)
    places = [
        F.shiftleft(
            F.shiftright(F.element_at("x", k + 1).bitwiseXOR(F.col("t")), b).bitwiseAND(1), b * dims + dims - 1 - k
        )
        for b in range(bits) for k in range(dims)
    ]
    curve = places[0]
    for p in places[1:]:
        curve = curve.bitwiseOR(p)
    return df.select("cell", curve.alias("curve"))


def quantised(value: Column, bits: int = BITS) -> Column:
    """A grid coordinate of a label: its hash; null has one of its own."""
    return F.pmod(F.xxhash64(F.coalesce(value.cast("string"), F.lit(""))), F.lit(1 << bits)).cast("long")


def hilbert_shards(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
    labels: tuple[str, str] = ("lang", "source"),
) -> DataFrame:
    """(id, size, text_crc32, curve, shard, slot): every row of ``docs`` in one of ``shards`` shards.

    Shards are runs of the curve order whose row counts differ by one at most; slot numbers a shard's rows without gaps.
    Within a cell the order is that of a hash of the id, then id, size and checksum; rows equal in all of them may swap.

    size is the UTF-8 bytes of the text plus 1; a null text counts as empty. Null labels and ids are values of their
    own. Fewer rows than shards leave shards empty; an empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    top = (1 << BITS) - 1
    scale = F.least(F.floor(F.log2(size.cast("double"))), F.lit(top)).cast("long")
    cell = F.shiftleft(quantised(F.col(labels[0])), 2 * BITS) + F.shiftleft(quantised(F.col(labels[1])), BITS) + scale
    rows = written(
        docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(text).alias("text_crc32"), cell.alias("cell"))
        .join(F.broadcast(hilbert_cells(docs.sparkSession)), "cell").drop("cell"),
        "shard-rows",
    )
    # First row of each cell on the curve: a window over one row per cell, 4096 at most.
    cells = rows.groupBy("curve").agg(F.count(F.lit(1)).alias("n"))
    along = Window.orderBy("curve")
    cells = cells.select(
        "curve",
        (F.sum("n").over(along) - F.col("n")).alias("cell_start"),
        F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
        F.ceil(F.col("n") / GROUP_ROWS).alias("groups"),
    )
    rows = rows.join(F.broadcast(cells), "curve").withColumn(
        "group", F.pmod(F.xxhash64("id", "text_crc32"), F.col("groups"))
    ).drop("groups")
    groups = rows.groupBy("curve", "group").agg(F.count(F.lit(1)).alias("n"))
    in_cell = Window.partitionBy("curve").orderBy("group")
    groups = groups.select("curve", "group", (F.sum("n").over(in_cell) - F.col("n")).alias("group_start"))
    in_group = Window.partitionBy("curve", "group").orderBy("id", "size", "text_crc32")
    rank = F.col("cell_start") + F.col("group_start") + F.row_number().over(in_group) - 1
    ranked = rows.join(groups, ["curve", "group"]).withColumn("rank", rank)
    shard = F.expr(f"(rank * {shards}) div total")
    first = F.expr(f"(((rank * {shards}) div total) * total + {shards - 1}) div {shards}")
    return ranked.select(
        "id", "size", "text_crc32", "curve", shard.cast("int").alias("shard"), (F.col("rank") - first).alias("slot")
    )


@query("op5_hilbert_shards")
def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )
