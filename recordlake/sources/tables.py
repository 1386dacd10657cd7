"""Stored tables that are read by parts: by prefix and year, and page by page.

Partition columns are filtered before files are opened (static conditions from a query's years
and prefixes, dynamic ones from the side a join is made with).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARD = 100_000  # rows of a shard of a paged table


def write_directory(df: DataFrame, path: str, salts: int = 1) -> None:
    """A table by prefix and year; `salts` tasks write a partition, so a hot one is no single task's."""
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts))
    df.repartition("prefix", "year", salt).write.partitionBy("prefix", "year").parquet(path)


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_pages(df: DataFrame, ordinal: str, path: str, shard: int = SHARD) -> None:
    """Rows numbered from 1, in shards of `shard` consecutive ones, each one sorted file."""
    rows = df.withColumn("shard", F.floor((F.col(ordinal) - 1) / shard).cast("long"))
    rows.repartition("shard").sortWithinPartitions("shard", ordinal).write.partitionBy("shard").parquet(path)


def page(spark: SparkSession, path: str, ordinal: str, after: int, size: int, shard: int = SHARD) -> DataFrame:
    """The `size` rows after an ordinal; only the shards they lie in are opened (one, or two at a border)."""
    rows = spark.read.parquet(path).where(F.col("shard").between(after // shard, (after + size - 1) // shard))
    return rows.where((F.col(ordinal) > after) & (F.col(ordinal) <= after + size)).drop("shard")


def records_of(refs: DataFrame, directory: DataFrame, keys: tuple[str, ...] = ("prefix", "year", "case_number")) -> DataFrame:
    """Directory rows of references: the join on the partition columns lets Spark read only the partitions that the references name."""
    return directory.join(F.broadcast(refs.select(*keys).distinct()) if small(refs) else refs.select(*keys).distinct(), list(keys), "left_semi")


def small(df: DataFrame, most: int = 1 << 16) -> bool:
    """Whether a table has at most `most` rows (no more than that are read to know)."""
    return df.limit(most + 1).count() <= most
