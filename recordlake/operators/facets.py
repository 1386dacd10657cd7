"""Facets: distinct records by key, label variants and canonical labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def facet(rows: DataFrame, label: str, record: str, key: Column | None = None, least: int = 1, collation: str | None = None) -> DataFrame:
    """(facet_key, label, case_count): distinct records, and the most frequent label.

    Of equally frequent labels the first counts, by code points or as people sort (collation "UNICODE").

    Labels are counted before the ranking, so a key with millions of rows is
    ranked over its few spellings.
    """
    key = text.search_key(F.col(label)) if key is None else key
    rows = rows.select(key.alias("facet_key"), F.col(label).alias("label"), F.col(record).alias("record")).where("facet_key <> ''")
    once = rows.groupBy("facet_key", "record", "label").agg(F.count(F.lit(1)).alias("n"))  # the rows are read and shuffled once
    counts = once.groupBy("facet_key", "label").agg(F.sum("n").alias("n"))
    order = [F.collate("label", collation)] if collation else []
    best = counts.groupBy("facet_key").agg(F.min_by("label", F.struct(-F.col("n"), *order, F.col("label"))).alias("label"))
    records = once.select("facet_key", "record").distinct().where("record is not null").groupBy("facet_key").agg(F.count(F.lit(1)).alias("case_count"))
    return records.where(F.col("case_count") >= least).join(best, "facet_key").select("facet_key", "label", "case_count")


def officer_facet(rows: DataFrame, raw: str, record: str, pos: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """A record counts once per officer; its first spelling is the variant."""
    keyed = rows.withColumn("norm", text.officer_identity(F.col(raw), aliases)).where("norm <> ''")
    once = keyed.groupBy(record, "norm").agg(F.min_by(raw, pos).alias("variant"))
    return once.groupBy("norm", "variant").agg(F.count(F.lit(1)).alias("n"))


def canonical_officer_label(variants: DataFrame) -> DataFrame:
    """Per norm: exact key first, more words, more records, longer, then least."""
    k = text.officer_key(F.col("variant"))
    order = F.struct(
        F.when(k == F.col("norm"), 0).otherwise(1),
        -F.when(k == "", 0).otherwise(F.size(F.split(k, " "))),
        -F.col("n"),
        -F.length("variant"),
        F.col("variant"),
    )
    return variants.groupBy("norm").agg(F.min_by("variant", order).alias("label"), F.sum("n").alias("case_count"))


def unique_aliases(names: DataFrame, owner: str, spelling: str, routes: DataFrame, route: str) -> DataFrame:
    """(spelling, owner) of spellings with one owner that are not routes themselves."""
    s = names.withColumn("s", text.officer_key(F.col(spelling))).where("s <> ''")
    one = s.groupBy("s").agg(F.count_distinct(owner).alias("owners"), F.min(owner).alias("owner")).where("owners = 1")
    return one.join(routes.select(F.col(route).alias("s")).distinct(), "s", "left_anti").select(F.col("s").alias("spelling"), "owner")


def pack_blocks(rows: DataFrame, keys: list[str], record: str, most: int = 10000) -> DataFrame:
    """Distinct key tuples with their sorted records as texts of at most `most` records, numbered from 0."""
    from .rankings import ordinals

    numbered = ordinals(rows.select(*keys, record), [*[F.col(k) for k in keys], F.col(record)], "_n")
    first = numbered.groupBy(*keys).agg(F.min("_n").alias("_first")).select(F.struct(*keys).alias("_keys"), "_first")
    placed = numbered.join(first, F.struct(*keys).eqNullSafe(F.col("_keys")))
    placed = placed.withColumn("block", F.floor((F.col("_n") - F.col("_first")) / most).cast("long"))
    return placed.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("case_count"), F.array_join(F.sort_array(F.collect_list(record)), ",").alias("cases"))


def pack_groups(rows: DataFrame, keys: list[str], record: str) -> DataFrame:
    """Distinct key tuples with their sorted records as one text, as published; pack_blocks bounds the text."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("case_count"), F.array_join(F.sort_array(F.collect_list(record)), ",").alias("cases"))


def first_arrivals(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """Routes: first row of each key wins; `duplicates` counts the others."""
    others = [c for c in rows.columns if c != key]
    by = rows.groupBy(key).agg(F.min_by(F.struct(*others), pos).alias("x"), (F.count(F.lit(1)) - 1).alias("duplicates"))  # combined before the shuffle
    return by.select(*[F.col(key) if c == key else F.col(f"x.{c}").alias(c) for c in rows.columns], "duplicates")
