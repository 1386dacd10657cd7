"""Rankings: dense ordinals, competition ranks, capped lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def ordinals(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """1..N in `order` without one task sorting all rows.

    Rows are range partitioned and numbered inside their partition; the
    partitions' sizes (one row each) give the offsets.
    """
    spark = df.sparkSession
    p = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(p, *order).sortWithinPartitions(*order)
    local = dealt.withColumn("_id", F.monotonically_increasing_id())
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    local = local.withColumn("_part", part).withColumn("_at", at).drop("_id")
    local = cut(local)  # a range partitioning that is sampled again may fall differently
    sizes = local.groupBy("_part").agg(F.max("_at").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum(F.col("_n") + 1).over(before), F.lit(0))).drop("_n")
    return local.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def competition(df: DataFrame, partition: list[str], value: str) -> DataFrame:
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*partition).orderBy(F.col(value).desc())).cast("long"))


def nulls_last(df: DataFrame, partition: list[str], value: str, tie: str) -> DataFrame:
    """Zero is a value; missing values come last."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(F.col(value).desc_nulls_last(), tie)).cast("long"))


def capped(df: DataFrame, order: list[Column], cap: int) -> DataFrame:
    """At most `cap` rows (0: all) with `overflow`; one more row is read to prove it and never shown."""
    if not cap:
        return df.withColumn("overflow", F.lit(False))
    few = df.orderBy(*order).limit(cap + 1)
    n = F.count(F.lit(1)).over(Window.partitionBy())  # at most cap + 1 rows
    few = few.withColumn("overflow", n > cap).withColumn("_k", F.row_number().over(Window.orderBy(*order)))
    return few.where(F.col("_k") <= cap).drop("_k")


def share(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """value per key and its share in percent of the whole."""
    by = df.groupBy(*keys).agg(F.sum(value).alias("total"))
    whole = by.agg(F.sum("total").alias("whole"))
    return by.withColumn("_k", F.lit(1)).join(F.broadcast(whole.withColumn("_k", F.lit(1))), "_k").select(*keys, "total", F.round(100 * F.col("total") / F.col("whole"), 4).alias("share"))


def shards(df: DataFrame, ordinal: str, size: int) -> DataFrame:
    return df.withColumn("shard", F.floor((F.col(ordinal) - 1) / size).cast("long"))
