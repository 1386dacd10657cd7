"""Guards as data: differences, duplicates and assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def differences(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(side, key): missing keys and unexpected ones."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    missing = a.join(b, key, "left_anti").select(F.lit("missing").alias("side"), key)
    return missing.union(b.join(a, key, "left_anti").select(F.lit("unexpected"), key))


def same_keys(a: DataFrame, b: DataFrame, key: str) -> bool:
    return differences(a, b, key).limit(1).count() == 0


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """`df`, failing at run time where `condition` does not hold."""
    return df.where(F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def quarantine(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(condition, F.lit(False))
    return df.where(ok), df.where(~ok)


def headline(counts: DataFrame, column: str) -> int:
    """The one positive number of a metrics row; anything else is an error."""
    row = counts.select(column).first()
    n = None if row is None else row[0]
    if isinstance(n, bool) or not isinstance(n, int) or n <= 0:
        raise ValueError(f"{column} must be a positive count, not {n!r}")
    return n
