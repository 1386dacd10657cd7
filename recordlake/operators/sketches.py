"""Mergeable summaries beside the exact results: quantiles (KLL) and distinct records (HyperLogLog, theta).

A build stores one small row for each partition key; later builds and merged names
combine these rows and never read the records again.  Bounds: ranks of a KLL
sketch of size k are off by about 1.65 / k^0.9 (1.3 % at k = 200; 0.33 % at 800); HyperLogLog with 2^lg
registers has a relative standard error of 1.04 / 2^(lg / 2) (0.8 % at 14); theta with
2^lg entries is exact up to them and has 1 / 2^(lg / 2) beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, REGISTERS = 800, 14
QUANTILES = (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999))


def rank_error(k: int = K) -> float:
    """What the rank of a quantile may be off by."""
    return 2.296 / k**0.9723


def count_sketches(counts: DataFrame, keys: list[str], count: str, k: int = K) -> DataFrame:
    """(keys, quantile_sketch, n, least, most) of the counts of each key."""
    c = F.col(count).cast("long")
    return counts.groupBy(*keys).agg(F.kll_sketch_agg_bigint(c, F.lit(k)).alias("quantile_sketch"), F.count(c).alias("n"), F.min(c).alias("least"), F.max(c).alias("most"))


def merged_quantiles(sketches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, min, p50.., max) of sketches of any number of builds; null without a value."""
    by = sketches.groupBy(*(keys or [])).agg(F.kll_merge_agg_bigint("quantile_sketch").alias("s"), F.sum("n").alias("n"), F.min("least").alias("min"), F.max("most").alias("max"))
    at = lambda q: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_bigint("s", F.lit(q)))
    return by.select(*(keys or []), "n", "min", *[at(q).alias(name) for name, q in QUANTILES], "max")


def record_sketches(rows: DataFrame, keys: list[str], record: str) -> DataFrame:
    """(keys, records_hll, records_theta) of the distinct records of each key."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(record, F.lit(REGISTERS)).alias("records_hll"), F.theta_sketch_agg(record, F.lit(REGISTERS)).alias("records_theta"))


def merge_records(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of coarser keys."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("records_hll").alias("records_hll"), F.theta_union_agg("records_theta").alias("records_theta"))


def distinct(sketch: Column, kind: str = "hll") -> Column:
    return (F.hll_sketch_estimate if kind == "hll" else F.theta_sketch_estimate)(sketch)


def merged_names(sketches: DataFrame, mapping: DataFrame, norm: str = "norm") -> DataFrame:
    """(norm, records_hll, records_theta) after names merged (norm, target): records under several names count once."""
    renamed = sketches.join(mapping.select(norm, "target"), norm).drop(norm).withColumnRenamed("target", norm)
    return merge_records(renamed, [norm])


def shared_records(a: Column, b: Column) -> Column:
    """Distinct records that two theta sketches have in common."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))
