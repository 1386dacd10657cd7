"""Cutting a plan's lineage, and folders for tables on the way, in the storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        sc = spark.sparkContext
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = getattr(sc, "_recordlake_folder", None) or tempfile.mkdtemp(prefix="recordlake-")
        sc._recordlake_folder = at
    return at.rstrip("/")


def _until_exit(spark: SparkSession, at: str) -> None:
    """Deletes a folder when the driver's JVM ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)


def folder(spark: SparkSession) -> str:
    """A new folder in the shared storage that goes when the driver's JVM ends."""
    at = f"{shared(spark)}/recordlake-{uuid.uuid4().hex}"
    _until_exit(spark, at)
    return at


def stored(df: DataFrame, *partition: str) -> DataFrame:
    """`df` written to a new folder, partitioned by columns, and read back with its schema."""
    at = folder(df.sparkSession)
    writer = df.write.partitionBy(*partition) if partition else df.write
    writer.parquet(f"{at}/table")
    columns = [c for c in df.columns if c not in partition] + list(partition)
    return df.sparkSession.read.schema(df.select(*columns).schema).parquet(f"{at}/table")


def cut(df: DataFrame) -> DataFrame:
    """`df` from reliable checkpoint files: later uses see the same rows in the same partitions.

    The files go when the driver's JVM ends (sooner with Spark's own
    spark.cleaner.referenceTracking.cleanCheckpoints, once nothing refers to `df`).
    """
    spark = df.sparkSession
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared(spark))
        _until_exit(spark, context.getCheckpointDir().get())  # Spark's own new folder below the shared one
    return df.checkpoint()
