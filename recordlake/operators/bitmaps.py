"""Record sets of facets as stored bitmaps, one row for every facet and block of ordinals.

A block has 32,768 ordinals (the size of Spark's bitmap functions) and 4 KB.  OR and AND are
aggregates over blocks; a complement is taken block by block against the bitmap of all
records; rows are fetched last, by their ordinals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

BITS = 1 << 15


def build(rows: DataFrame, facet: str, ordinal: str) -> DataFrame:
    """(facet_key, block, bits) of rows (facet, ordinal); repeats change nothing, ordinals are positive, null keys go."""
    o = F.col(ordinal).cast("long")
    placed = rows.where(F.col(facet).isNotNull() & o.isNotNull()).select(F.col(facet).alias("facet_key"), F.bitmap_bucket_number(o).alias("block"), F.bitmap_bit_position(o).alias("bit"))
    return placed.groupBy("facet_key", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def everything(rows: DataFrame, ordinal: str) -> DataFrame:
    """(block, bits) of all rows."""
    return build(rows.select(F.lit("").alias("_all"), F.col(ordinal).alias("_o")), "_all", "_o").drop("facet_key")


def any_of(index: DataFrame, keys: list[str]) -> DataFrame:
    """(block, bits): records of any of the facets."""
    return index.where(F.col("facet_key").isin(keys)).groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))


def all_of(sets: list[DataFrame]) -> DataFrame:
    """(block, bits): records of every set; a block that one of them lacks is empty."""
    every = sets[0]
    for s in sets[1:]:
        every = every.unionByName(s)
    both = every.groupBy("block").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("k"))
    return both.where(F.col("k") == len(sets)).drop("k")


def union(sets: list[DataFrame]) -> DataFrame:
    """(block, bits): records of any set."""
    every = sets[0]
    for s in sets[1:]:
        every = every.unionByName(s)
    return every.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))


def _matrix(bits: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x or bytes(BITS // 8) for x in bits.to_pylist()), np.uint8).reshape(-1, BITS // 8)


def _and_not(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([x.tobytes() for x in _matrix(a) & ~_matrix(b)], pa.binary())


def minus(whole: DataFrame, out: DataFrame) -> DataFrame:
    """(block, bits): records of `whole` that are not in `out`."""
    o = out.select(F.col("block").alias("_block"), F.col("bits").alias("_out"))
    left = whole.join(o, F.col("block") == F.col("_block"), "left")
    return left.select("block", F.when(F.col("_out").isNull(), F.col("bits")).otherwise(arrow_udf(_and_not, "binary")("bits", "_out")).alias("bits"))


def without(whole: DataFrame, sets: list[DataFrame], join: str = "and") -> DataFrame:
    """NOT a AND NOT b leaves out the union, NOT a OR NOT b the intersection."""
    return minus(whole, union(sets) if join == "and" else all_of(sets))


def count() -> Column:
    """The aggregate that counts a set's records."""
    return F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))


def _places(bits: pa.Array) -> pa.Array:
    on = np.unpackbits(_matrix(bits), axis=1, bitorder="little")
    row, place = np.nonzero(on)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(on) + 1)), pa.int32()), pa.array(place.astype(np.int64)))


def ordinals(bitmap: DataFrame, name: str = "ordinal") -> DataFrame:
    """The records of a set."""
    listed = bitmap.select("block", F.explode(arrow_udf(_places, "array<bigint>")("bits")).alias("bit"))
    return listed.select(((F.col("block") - 1) * BITS + F.col("bit") + 1).alias(name))


def fetch(rows: DataFrame, ordinal: str, bitmap: DataFrame) -> DataFrame:
    """The rows of a set."""
    return rows.join(ordinals(bitmap, ordinal), ordinal, "left_semi")
