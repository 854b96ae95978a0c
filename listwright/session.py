"""Session settings the jobs are written for."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Pages of HTML are large: bound Arrow batches by size, not only by row count.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    # Checkpoint files go away with the DataFrame that wrote them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "listwright", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application.

    Python functions are sent by reference to their module, which executors only find if it is installed there.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)  # copied to Spark's own file server
    _shipped.add(context.applicationId)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at the path, in whatever file system it names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if it is not there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete what is at the path, in whatever file system it names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let go of shuffle files that nothing refers to any more; Spark does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share; see ``cut_lineage`` for which one that is."""
    return f"{_shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, its size known to the planner."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = os.path.join(spark.conf.get("spark.local.dir", "/tmp"), "listwright-checkpoints")
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage, so that it is computed once.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    session without that setting gets a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def keep_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column and drop the rows where it is NULL, computing it once.

    A plain filter on a computed column is pushed below the projection and computes the
    expression a second time; what comes out of a generator stays where it is.
    """
    return df.withColumn(name, F.explode_outer(F.array(value))).filter(F.col(name).isNotNull())


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core a part of a table that was read in fewer pieces than there are cores.

    Large tables come in many splits and are returned as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
