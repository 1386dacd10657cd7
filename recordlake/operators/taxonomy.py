"""Taxonomy roots, category enrichment and matter facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .lineage import cut


def roots(nodes: DataFrame) -> DataFrame:
    """(id, root_label) over (id, parent_id, label), of any depth, by pointer jumping.

    A parent that does not exist ends the walk.  A node on a cycle is its own
    root; a walk that runs into a cycle ends at the first node of it.  With a
    column pos the last of several rows of one id counts.
    """
    if "pos" in nodes.columns:
        nodes = nodes.groupBy("id").agg(F.max_by(F.struct("parent_id", "label"), "pos").alias("x")).select("id", "x.*")
    nodes = cut(nodes.select("id", "parent_id", "label"))
    known = nodes.select(F.col("id").alias("k"))
    step = cut(nodes.join(known, F.col("parent_id") == F.col("k"), "left").select("id", F.coalesce("k", "id").alias("up")))
    # the nodes that are still reached after ever longer walks are the ends: roots and members of cycles
    ends, far = None, step
    while (n := far.agg(F.count_distinct("up")).first()[0]) != ends:
        ends, far = n, cut(_jump(far).drop("was"))
    stop = far.select(F.col("up").alias("e")).distinct()
    up = step.join(stop, F.col("id") == F.col("e"), "left").select("id", F.coalesce("e", "up").alias("up"))
    moving = True
    while moving:
        up = cut(_jump(up))
        moving = up.where("was <> up").limit(1).count()
        up = up.drop("was")
    label = nodes.select(F.col("id").alias("l"), F.col("label").alias("root_label"))
    return up.join(label, F.col("up") == F.col("l")).select("id", "root_label")


def _jump(up: DataFrame) -> DataFrame:
    """Each walk continued by the walk from where it stands (`was`)."""
    nxt = up.select(F.col("id").alias("m"), F.col("up").alias("next"))
    return up.join(nxt, F.col("up") == F.col("m")).select("id", F.col("next").alias("up"), F.col("up").alias("was"))


def category_lookup(categories: DataFrame, nodes: DataFrame) -> DataFrame:
    """(category_key, matter_type, matter_category) of (parent_id, label, pos): the root of the parent, the last row of a key."""
    keyed = categories.withColumn("category_key", text.search_key(F.col("label"))).where("category_key <> ''")
    last = keyed.groupBy("category_key").agg(F.max_by(F.struct("parent_id", "label"), "pos").alias("x")).select("category_key", "x.*")
    root = roots(nodes).select(F.col("id").alias("parent_id"), "root_label")
    return last.join(root, "parent_id", "left").select("category_key", F.coalesce("root_label", F.lit("Unclassified")).alias("matter_type"), F.col("label").alias("matter_category"))


def matter_columns(matter_type: Column, category: Column, number: Column) -> list[Column]:
    """Type (inferred from the number if missing or unclassified), category and their keys."""
    inferred = text.inferred_matter_type(number)
    t = F.when(matter_type.isNull() | ((matter_type == "Unclassified") & (inferred != "Unclassified")), inferred).otherwise(matter_type)
    c = F.coalesce(category, F.lit("Unknown"))
    return [t.alias("matter_type"), text.compact_key(t).alias("matter_type_key"), c.alias("matter_category"), F.concat(text.compact_key(t), F.lit(":"), text.compact_key(c)).alias("matter_category_key")]


def enrich(records: DataFrame, number: str, categories: DataFrame) -> DataFrame:
    """Left join of records with (number, matter_type, matter_category) of their category.

    Only categories of records that are present travel (left semi).
    """
    need = categories.join(records.select(number).distinct(), number, "left_semi")
    joined = records.join(need.withColumnRenamed("matter_type", "_t").withColumnRenamed("matter_category", "_c"), number, "left")
    return joined.select(*records.columns, *matter_columns(F.col("_t"), F.col("_c"), F.col(number)))


def conflicts(categories: DataFrame, number: str, category: str) -> DataFrame:
    """Records with more than one category."""
    return categories.groupBy(number).agg(F.count_distinct(category).alias("n")).where("n > 1")


def exploded_cases(packed: DataFrame, key: str, cases: str, sep: str = ",") -> DataFrame:
    return packed.select(key, F.explode(F.split(cases, sep)).alias("case_number")).where("case_number <> ''")


def facet_counts(enriched: DataFrame) -> DataFrame:
    """Counts by type and by (type, category); category is null in the type rows."""
    return (
        enriched.groupingSets([["matter_type"], ["matter_type", "matter_category"]], "matter_type", "matter_category")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping("matter_category").cast("int").alias("is_type"))
    )
