"""Entities' own sources: Parquet with lists as JSON text, and the canonical profile shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .files import manifest


def with_lists(df: DataFrame, *columns: str) -> DataFrame:
    """JSON lists in text columns as arrays without blanks; the suffix _json goes, and nothing else is read of them."""
    out = df
    for c in columns:
        items = F.filter(F.transform(text.json_list(F.col(c)), lambda v: F.trim(v)), lambda v: F.coalesce(v, F.lit("")) != "")
        out = out.withColumn(c.removesuffix("_json"), items)
    return out.drop(*[c for c in columns if c.endswith("_json")])


def attorneys(spark: SparkSession, path: str, columns: tuple[str, ...] = ("attorney_id", "name", "bar_number", "case_numbers_json")) -> DataFrame:
    """Attorneys of a Parquet table with their distinct records as an array; only `columns` are read, and counts that the table states are not."""
    df = with_lists(spark.read.parquet(path).select(*columns), *[c for c in columns if c.endswith("_json")])
    return df.withColumn("case_numbers", F.array_distinct("case_numbers"))


def references(entities: DataFrame, entity: str, cases: str = "case_numbers") -> DataFrame:
    """(entity, number, pos) of every listed record."""
    return entities.select(entity, F.posexplode(cases).alias("pos", "number")).select(entity, "number", "pos")


def canonical(spark: SparkSession, root: str, kind: str, schema: str) -> DataFrame:
    """The profiles of a kind, from the shards that its manifest below `root` lists; they are the only source, and a missing or miscounted shard is an error."""
    return manifest(spark, f"{root}/{kind}-manifest.json", root, schema)


def overlapping(year: Column, first: Column, last: Column) -> Column:
    """Whether a year and a range of dates (ISO text, open where null) have a day in common."""
    from_, to = F.coalesce(F.substring(first, 1, 4).try_cast("int"), F.lit(-9999)), F.coalesce(F.substring(last, 1, 4).try_cast("int"), F.lit(9999))
    return year.between(from_, to)


def in_last_years(filed: Column, as_of: Column, years: int = 2) -> Column:
    """Whether a date lies in the exact years up to `as_of`, both ends included."""
    day, end = F.to_date(filed), F.to_date(as_of)
    return F.coalesce(day.between(F.add_months(end, -12 * years), end), F.lit(False))
