"""Whitening of embeddings with MLlib's distributed block matrices.

1. Entries become whole numbers, x = floor(64 c) + 1000000. Each distinct vector counts once in what is fitted.
2. The vectors, less the whole number next to each dimension's mean, are laid out in blocks of rows. All products of such
   entries are whole numbers too, so sums of them are exact up to 2^53; what is left of the mean, at most one half, is
   taken off the sums and off the projections.
3. Transpose times matrix gives the scatter; its eigenvectors are found on the driver (dimension x dimension numbers).
4. Matrix times whitening matrix projects the rows.

``BlockMatrix.multiply`` lays a matrix of one column of blocks out in about the square root of its number of partitions and
plans with a list of all blocks. So blocks are grouped into slabs of at most SLAB x SLAB, each a matrix of its own: a task
holds some SLAB blocks and the driver one slab's coordinates, however many rows there are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from listwright.llm.common import discard, new_path, query, release_shuffles, table, written
from listwright.session import spread

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Numbers in a block at most; blocks that a table is cut into, unless they would have fewer rows than FEW_ROWS; and the
#: side of a slab, in blocks.
BLOCK_NUMBERS, LEAST_BLOCKS, FEW_ROWS, SLAB = 1 << 20, 64, 256, 32
#: Entries beyond this are cut to it, so that they and their sums stay whole numbers.
LARGEST = 1 << 40
#: Eigenvalues under this share of the largest are rounding errors: there is nothing to whiten.
LEAST_EIGENVALUE = 1e-12

_MATRIX = "struct<type:tinyint,numRows:int,numCols:int,colPtrs:array<int>,rowIndices:array<int>,values:array<double>,isTransposed:boolean>"
_MATRIX_ARROW = pa.struct([
    ("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())),
    ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_()),
])


def whole_numbers(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x) of the rows whose vector is there and has only finite entries."""
    def as_whole(c):
        entry = F.floor(SCALE * c.cast("double")) + SHIFT
        return F.least(F.greatest(entry, F.lit(-LARGEST)), F.lit(LARGEST)).cast("long")

    vector = F.col(vector_col)
    is_number = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    # Far beyond LARGEST a double does not fit in a long: cut it before.
    bounded = F.transform(vector, lambda c: F.least(F.greatest(c.cast("double"), F.lit(-1e11)), F.lit(1e11)))
    return rows.filter(vector.isNotNull() & is_number).select(
        F.col(id_col).alias("id"), F.transform(bounded, as_whole).alias("x")
    )


class _Blocks:
    """A matrix with a row for each row of a table, as slabs of blocks in the shared folder.

    ``rows`` are (x, and whatever else goes with a row). A block holds the rows that follow each other in a task; the
    last one of a task is filled up with zeros.
    """

    def __init__(self, rows: DataFrame, centre: np.ndarray, height: int):
        self.spark, self.height, self.width = rows.sparkSession, height, len(centre)
        others = [f for f in rows.schema.fields if f.name != "x"]
        arrow = [pa.field("part", pa.int64()), pa.field("block", pa.int64()), pa.field("m", _MATRIX_ARROW)]
        width = self.width

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part, number, waiting, n = TaskContext.get().partitionId(), 0, [], 0

            def block(whole: pa.Table) -> pa.RecordBatch:
                x = whole["x"].combine_chunks()
                values = np.zeros((height, width))
                values[:len(whole)] = x.flatten().to_numpy().reshape(-1, width) - centre
                matrix = {"type": 1, "numRows": height, "numCols": width, "isTransposed": True}
                # The largest array once, without a Python object for each number.
                flat = pa.ListArray.from_arrays(pa.array([0, values.size], pa.int32()), pa.array(values.ravel()))
                fields = [flat if f.name == "values" else pa.array([matrix.get(f.name)], f.type) for f in _MATRIX_ARROW]
                columns = [pa.array([part]), pa.array([number]), pa.StructArray.from_arrays(fields, fields=list(_MATRIX_ARROW))]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole[f.name].combine_chunks()) for f in others]
                return pa.RecordBatch.from_arrays(columns + lists, [f.name for f in arrow] + [f.name for f in others])

            for batch in batches:
                while batch.num_rows:
                    part_of = batch.slice(0, height - n)
                    waiting.append(part_of)
                    n += part_of.num_rows
                    batch = batch.slice(part_of.num_rows)
                    if n == height:
                        yield block(pa.Table.from_batches(waiting))
                        number, waiting, n = number + 1, [], 0
            if n:
                yield block(pa.Table.from_batches(waiting))

        lists = "".join(f", `{f.name}` array<{f.dataType.simpleString()}>" for f in others)
        blocks = rows.mapInArrow(cut, f"part long, block long, m {_MATRIX}{lists}")
        slab = F.concat_ws("_", F.floor(F.col("part") / SLAB), F.floor(F.col("block") / SLAB))
        self.path = new_path(self.spark, "matrix-blocks")
        blocks.withColumn("slab", slab).write.partitionBy("slab").parquet(self.path)
        self.table = self.spark.read.schema(f"part long, block long, m {_MATRIX}{lists}, slab string").parquet(self.path)
        self.table.written_to = self.path

    def slabs(self) -> Iterator[tuple[str, list[tuple[int, int]], BlockMatrix]]:
        """Each slab with its blocks' (part, block), in the order of the matrix."""
        whole = self.table.schema
        as_matrices = StructType([StructField("m", MatrixUDT()) if f.name == "m" else f for f in whole])
        read = self.spark.read.schema(as_matrices).parquet(self.path)
        for (slab,) in self.table.select("slab").distinct().orderBy("slab").collect():
            here = read.filter(F.col("slab") == slab)
            places = sorted((r["part"], r["block"]) for r in here.select("part", "block").collect())  # SLAB x SLAB at most
            index = F.element_at(
                F.create_map(*itertools.chain.from_iterable((F.lit(f"{p}_{b}"), F.lit(k)) for k, (p, b) in enumerate(places))),
                F.concat_ws("_", "part", "block"),
            )
            rows = here.select(F.struct(index.cast("long").alias("_1"), F.lit(0).cast("long").alias("_2")).alias("at"), "m")
            java = callMLlibFunc("createBlockMatrix", rows, self.height, self.width, len(places) * self.height, self.width)
            yield slab, places, BlockMatrix(java, self.height, self.width)


def _scatter(matrix: BlockMatrix, n_blocks: int) -> np.ndarray:
    """Transpose times matrix. The blocks are multiplied in as many tasks as there are, and their products added up."""
    product = matrix.transpose()._java_matrix_wrapper._java_model.multiply(matrix._java_matrix_wrapper._java_model, n_blocks)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def _local(matrix: np.ndarray, spark: SparkSession) -> BlockMatrix:
    rows, columns = matrix.shape
    block = spark.sparkContext.parallelize([((0, 0), Matrices.dense(rows, columns, matrix.ravel(order="F")))], 1)
    return BlockMatrix(block, rows, columns, rows, columns)


def _deviation(n: int, centre: list[int], rest: list[int]) -> Column:
    """Sum of (n x - S)^2, where n x - S is n (x - centre) - rest: in whole numbers where it fits in a long, else null."""
    constants = F.arrays_zip(F.lit(centre).cast("array<bigint>").alias("c"), F.lit(rest).cast("array<bigint>").alias("r"))

    def total(kind: str) -> Column:
        apart = F.zip_with("x", constants, lambda x, k: (x - k["c"]).cast(kind) * F.lit(n).cast(kind) - k["r"].cast(kind))
        return F.aggregate(apart, F.lit(0).cast(kind), lambda so_far, v: so_far + v * v)

    return F.when(total("double") < 9.22e18, total("bigint"))


def whiten(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each row and component, from 1 on.

    Rows are left out whose vector is null or has entries that are null or not finite, and those of another length than
    most vectors have (of lengths equally frequent, the larger one stays). Null ids and repeated rows are rows like
    others; equal vectors get equal results and count once in n, the mean and the covariance. Where the vectors vary in
    fewer directions than ``components``, there are that many components; if there is none, as with one distinct vector
    or an empty table, there are no rows. Eigenvectors of equal eigenvalues are any orthogonal ones. Entries beyond
    +-2^40 after scaling are cut to that. deviation is null where it does not fit in a long. Other columns are not read.
    """
    spark = rows.sparkSession
    id_type = rows.schema[id_col].dataType.simpleString()
    nothing = spark.createDataFrame(
        [], f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    numbers = written(whole_numbers(rows, id_col, vector_col), "vectors")
    lengths = numbers.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None or lengths["d"] < 1:
        return nothing
    width = lengths["d"]
    numbers_of_width = numbers.filter(F.size("x") == width)
    fit = written(numbers_of_width.select("x").distinct(), "distinct-vectors")
    n = fit.count()
    sums = [
        int(r["s"]) for r in fit.select(F.posexplode("x").alias("k", "v"))
        .groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("k").collect()  # one row per dimension
    ]
    centre = [(2 * s + n) // (2 * n) for s in sums]  # the whole number next to the mean
    rest = [s - n * c for s, c in zip(sums, centre)]
    left = np.array([r / n for r in rest])
    height = max(1, min(BLOCK_NUMBERS // width, max(FEW_ROWS, -(-n // LEAST_BLOCKS))))
    fitted = _Blocks(spread(fit), np.array(centre, np.int64), height)
    everything = _Blocks(
        spread(numbers_of_width.select("id", "x", _deviation(n, centre, rest).alias("deviation"))), np.array(centre, np.int64), height
    )
    discard(numbers, fit)
    release_shuffles(spark)

    covariance = sum((_scatter(m, len(places)) for _, places, m in fitted.slabs()), np.zeros((width, width))) / n
    covariance -= np.outer(left, left)
    values, vectors = np.linalg.eigh(covariance)
    found = [k for k in range(width - 1, -1, -1)[:components] if values[k] > values[-1] * LEAST_EIGENVALUE and values[k] > 0]
    if not found:
        discard(fitted.table, everything.table)
        return nothing
    whitening = vectors[:, found] / np.sqrt(values[found])
    explained = values[found] / np.trace(covariance)
    mean = left @ whitening
    release_shuffles(spark)
    identity = np.zeros((len(found), len(found)))
    for _, places, matrix in fitted.slabs():
        identity += _scatter(matrix.multiply(_local(whitening, spark)), len(places))
    identity_error = float(np.abs(identity / n - np.outer(mean, mean) - np.eye(len(found))).max())
    discard(fitted.table)
    release_shuffles(spark)

    path = new_path(spark, "projected-blocks")
    for slab, places, matrix in everything.slabs():
        projected = callMLlibFunc("getMatrixBlocks", matrix.multiply(_local(whitening, spark))._java_matrix_wrapper._java_model)
        at = F.element_at(F.array(*[F.lit(f"{p}_{b}") for p, b in places]), (F.col("at._1") + 1).cast("int"))
        projected.toDF("at", "m").select(F.split(at, "_").alias("at"), "m").select(
            F.col("at")[0].cast("long").alias("part"), F.col("at")[1].cast("long").alias("block"), "m"
        ).write.mode("append").parquet(path)
    # A matrix column is read as the struct it is stored as.
    projected = spark.read.schema(f"part long, block long, m {_MATRIX}").parquet(path)
    release_shuffles(spark)
    k = len(found)
    row = F.transform(
        F.sequence(F.lit(0), F.size("id") - 1),
        lambda i: F.struct(
            F.get("id", i).alias("id"), F.get("deviation", i).alias("deviation"),
            F.transform(
                F.array(*[F.struct(F.lit(c).alias("c"), F.lit(float(mean[c])).alias("mean"), F.lit(float(explained[c])).alias("e")) for c in range(k)]),
                lambda c: F.struct((c["c"] + 1).alias("component"),
                                   (F.get("projected", c["c"] * height + i) - c["mean"]).alias("whitened"),
                                   c["e"].alias("explained")),
            ).alias("components"),
        ),
    )
    result = everything.table.select("part", "block", "id", "deviation").join(
        projected.select("part", "block", F.col("m.values").alias("projected")), ["part", "block"]
    ).select(F.explode(row).alias("row")).select("row.id", "row.deviation", F.explode("row.components").alias("c"))
    return result.select(
        "id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained",
        F.lit(identity_error).alias("identity_error"),
    )


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
