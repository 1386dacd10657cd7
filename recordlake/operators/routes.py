"""Look-up routes: records dealt to buckets with an index, and keys that lead to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import bucket_name, lookup_bucket
from .facets import first_arrivals
from .rankings import ordinals


def record_places(rows: DataFrame, kind: str, key: str, pos: str, buckets: int = 1024) -> DataFrame:
    """`rows` with their record bucket and the index inside it, by arrival; rows without a key have no bucket and are numbered together."""
    out = rows.withColumn("record_bucket", bucket_name(lookup_bucket(kind, F.col(key), buckets), buckets))
    numbered = ordinals(out, [F.col("record_bucket"), F.col(pos)], "record_number")  # no task holds a bucket
    first = numbered.groupBy("record_bucket").agg(F.min("record_number").alias("first_number"))
    first = first.withColumnRenamed("record_bucket", "own_bucket")
    placed = numbered.join(F.broadcast(first), F.col("record_bucket").eqNullSafe(F.col("own_bucket")))  # one row per bucket
    return placed.withColumn("record_index", F.col("record_number") - F.col("first_number")).drop("record_number", "first_number", "own_bucket")


def routes(places: DataFrame, kind: str, keys: list[str], pos: str, buckets: int = 256) -> DataFrame:
    """(route, lookup_bucket, record_bucket, record_index, duplicates): the first record of a key wins."""
    names = F.array_distinct(F.filter(F.array(*[F.lower(F.trim(F.col(k))) for k in keys]), lambda k: k.isNotNull() & (k != "")))
    rows = places.select(F.explode(names).alias("route"), "record_bucket", "record_index", pos)
    first = first_arrivals(rows, "route", pos)
    return first.withColumn("lookup_bucket", bucket_name(lookup_bucket(kind, F.col("route"), buckets), buckets)).drop(pos)
