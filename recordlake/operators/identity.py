"""Merging of officers' names: order of steps matters, so no general components are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parts(norm: Column) -> Column:
    """struct(first, middle, surname); one word is a surname."""
    w = F.filter(F.split(norm, " "), lambda x: x != "")
    n = F.size(w)
    return F.struct(
        F.when(n > 1, F.get(w, F.lit(0))).otherwise("").alias("first"),
        F.when(n > 2, F.slice(w, F.lit(2), n - 2)).otherwise(F.array().cast("array<string>")).alias("middle"),
        F.when(n > 0, F.element_at(w, -1)).otherwise("").alias("surname"),
    )


def merge_names(groups: DataFrame, norm: str = "norm") -> DataFrame:
    """(norm, target) for every distinct name.

    1. Names of one (first, surname) merge, all or none: if all non-empty middle
       parts are pairwise of one length and equal or initials of each other.
    2. A lone surname joins if exactly one merged name has it.
    3. The target is the name with most words, then the longest, then the greatest.
    """
    d = groups.select(F.col(norm).alias("norm")).where("norm <> ''").distinct()
    d = d.withColumn("p", parts(F.col("norm"))).select("norm", "p.first", "p.middle", "p.surname")
    full = d.where("first <> ''")
    length = F.when(F.size("middle") > 0, F.size("middle"))
    united = full.groupBy("first", "surname").agg(F.min(length).alias("shortest"), F.max(length).alias("longest"), F.min("norm").alias("root"))
    # pairwise agreement is one rule a place: one initial, and at most one word that is more than it
    at = full.select("first", "surname", F.posexplode("middle").alias("place", "w"))
    initial, word = F.substring("w", 1, 1), F.when(F.length("w") > 1, F.col("w"))
    places = at.groupBy("first", "surname", "place").agg(
        (F.min("w") == F.max("w")).alias("same"), (F.min(initial) == F.max(initial)).alias("initial"), F.coalesce(F.min(word) == F.max(word), F.lit(True)).alias("word")
    )
    apart = places.where(~(F.col("same") | (F.col("initial") & F.col("word")))).select("first", "surname").distinct().withColumn("apart", F.lit(True))
    ok = F.coalesce(F.col("shortest") == F.col("longest"), F.lit(True)) & F.col("apart").isNull()
    full = full.join(united.join(apart, ["first", "surname"], "left").select("first", "surname", "root", ok.alias("unite")), ["first", "surname"])
    full = full.select("norm", "surname", F.when(F.col("unite"), F.col("root")).otherwise(F.col("norm")).alias("root"))
    owners = full.groupBy("surname").agg(F.count_distinct("root").alias("k"), F.min("root").alias("owner")).where("k = 1").drop("k")
    bare = d.where("first = ''").join(owners, "surname", "left").select("norm", F.coalesce("owner", "norm").alias("root"))
    every = full.select("norm", "root").union(bare)
    words = F.size(F.split("norm", " "))
    best = every.groupBy("root").agg(F.max_by("norm", F.struct(words, F.length("norm"), F.col("norm"))).alias("target"))
    return every.join(best, "root").select("norm", "target")


def remerge(variants: DataFrame, mapping: DataFrame) -> DataFrame:
    """Counts of variants under their targets (a variant's records are not united, see merged_records)."""
    return variants.join(mapping, "norm").groupBy(F.col("target").alias("norm"), "variant").agg(F.sum("n").alias("n"))


def merged_records(rows: DataFrame, mapping: DataFrame, record: str) -> DataFrame:
    """(norm, case_count) of the targets: a record under several merged names counts once."""
    return rows.join(mapping, "norm").groupBy(F.col("target").alias("norm")).agg(F.count_distinct(record).alias("case_count"))


def remap_aliases(names: DataFrame, norm: str, aliases: DataFrame) -> DataFrame:
    """`names` with `norm` replaced by its reviewed identity from aliases (alias, identity), where there is one."""
    known = aliases.select(F.col("alias").alias(norm), "identity").dropDuplicates([norm])
    return names.join(known, norm, "left").select(*[F.coalesce("identity", norm).alias(norm) if c == norm else c for c in names.columns])


def roster_judges(profiles: DataFrame) -> DataFrame:
    """Profiles of judges whose standing on the roster is known."""
    return profiles.where((F.col("profile_type") == "judge") & F.col("roster_status").isin("current", "former", "historical"))


def profile_labels(profiles: DataFrame, owner: str, labels: str, key) -> DataFrame:
    """First label of each normal form of a profile's list of labels."""
    x = profiles.select(owner, F.posexplode(labels).alias("pos", "label"))
    x = x.withColumn("norm", key(F.col("label"))).where("norm <> ''")
    return x.withColumn("k", F.row_number().over(Window.partitionBy(owner, "norm").orderBy("pos"))).where("k = 1").select(owner, "norm", "label")
