"""A stored trigram index of compressed blocks, decoded only where all grams of a query meet.

A block holds the ordinals that one gram has in one page (a range of PAGE ordinals) as
LEB128 differences, with the first and last of them and their number beside it.  A
query reads the heads of its grams' blocks; a page is looked into only if every
gram has a block there and the blocks' ranges overlap.  Blocks are bounded by PAGE, so no
row grows with the data, and pages are equal for all grams, so the overlap is an equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a32, pack_differences, unpack_differences
from .search import _bucket, _wanted, gram_rows, search

PAGE = 1 << 16


def compressed(rows: DataFrame, gram: str, ordinal: str, buckets: int = 64, page: int = PAGE) -> DataFrame:
    """(bucket, gram, page, first, last, n, data) of (gram, ordinal) rows, each at most once; ordinals are positive."""
    placed = rows.select(F.col(gram).alias("gram"), F.col(ordinal).cast("long").alias("o")).withColumn("page", F.floor(F.col("o") / page).cast("long"))
    blocks = placed.groupBy("gram", "page").agg(F.array_sort(F.collect_list("o")).alias("o"))  # at most `page` ordinals a row
    bucket = (fnv1a32(F.col("gram")) % buckets).cast("int")
    return blocks.select(bucket.alias("bucket"), "gram", "page", F.col("o")[0].alias("first"), F.element_at("o", -1).alias("last"), F.size("o").alias("n"), pack_differences(F.col("o")).alias("data"))


def write(blocks: DataFrame, path: str) -> None:
    """One folder a bucket, sorted by gram and page, so that heads are found by Parquet's statistics."""
    blocks.repartition("bucket", "page").sortWithinPartitions("bucket", "gram", "page").write.partitionBy("bucket").parquet(path)


def build(df: DataFrame, ordinal: str, fields: list[Column], path: str, buckets: int = 64, page: int = PAGE) -> None:
    write(compressed(gram_rows(df, ordinal, *fields), "gram", ordinal, buckets, page), path)


def meeting(blocks: DataFrame, grams: list[str], buckets: int = 64) -> DataFrame:
    """The blocks, with the common range lo..hi of their page, of pages where all grams may meet."""
    of = sorted({_bucket(g) % buckets for g in grams})
    hits = blocks.where(F.col("bucket").isin(of) & F.col("gram").isin(grams))
    heads = hits.groupBy("page").agg(F.count(F.lit(1)).alias("k"), F.max("first").alias("lo"), F.min("last").alias("hi"))
    return hits.join(heads.where((F.col("k") == len(grams)) & (F.col("lo") <= F.col("hi"))).drop("k"), "page")


def ordinals_of(blocks: DataFrame, grams: list[str], buckets: int = 64) -> DataFrame:
    """(ordinal): rows that have all the grams."""
    found = meeting(blocks, grams, buckets).select("lo", "hi", F.explode(unpack_differences(F.col("data"))).alias("ordinal"))
    every = found.where(F.col("ordinal").between(F.col("lo"), F.col("hi"))).groupBy("ordinal").agg(F.count(F.lit(1)).alias("k"))
    return every.where(F.col("k") == len(grams)).select("ordinal")


def search_stored(spark: SparkSession, path: str, details: DataFrame, ordinal: str, fields: list[str], query: str, buckets: int = 64) -> DataFrame:
    """search() through the stored index; under 3 characters nothing matches."""
    q, grams = _wanted(query)
    if len(q) < 3:
        return details.where(F.lit(False))
    ids = ordinals_of(spark.read.parquet(path), grams, buckets).withColumnRenamed("ordinal", ordinal)
    return search(details.join(ids, ordinal, "left_semi"), fields, query)
