"""Builds from records to published sets of tables, each with its manifest: facets, matters, profiles, routes, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.hashing import bucket_name, lookup_bucket
from ..sources.sinks import facet_order, facet_tables, publish_set
from . import builds, rankings
from .lineage import cut
from .routes import record_places


def named_records(rows: DataFrame, names: Column, records: Column) -> DataFrame:
    """(label, record): every distinct clean name of a row's list with every record of its list."""
    label = F.explode(F.array_distinct(F.filter(F.transform(names, text.clean), lambda n: n != "")))
    listed = rows.select(label.alias("label"), records.alias("_records"))
    return listed.select("label", F.explode("_records").alias("record")).where("trim(record) <> ''").select("label", F.trim("record").alias("record"))


def decreed_names(directory: DataFrame, record: str = "case_number") -> dict[str, DataFrame]:
    """The facet of names that judgments give: `decreed_names`, else the one `decreed_name`; every name is picked."""
    c = directory.columns
    one = F.array(F.col("decreed_name")) if "decreed_name" in c else F.array().cast("array<string>")
    names = F.coalesce(F.col("decreed_names"), one) if "decreed_names" in c else one
    return builds.build_facet(named_records(directory, F.filter(names, lambda n: n.isNotNull()), F.array(record)), "label", "record", least=1, collation="UNICODE")


def listed_names(entities: DataFrame, name: str = "display_name", cases: str = "case_numbers", least: int = 2) -> dict[str, DataFrame]:
    """The facet of parties or firms from entities with their list of records."""
    own = F.filter(F.coalesce(F.col(cases), F.array().cast("array<string>")), lambda n: n.isNotNull())
    return builds.build_facet(named_records(entities, F.array(F.coalesce(F.col(name), F.lit(""))), own), "label", "record", least=least, collation="UNICODE")


def counsel(attorneys: DataFrame, least: int = 2) -> dict[str, DataFrame]:
    """The facet of attorneys by name (picked from `least` records) with routes by bar number.

    attorneys: display_name, bar_number, case_numbers.
    """
    named = listed_names(attorneys, least=least)
    digits = F.regexp_replace(F.coalesce(F.col("bar_number").cast("string"), F.lit("")), "[^0-9]", "")
    barred = attorneys.withColumn("_key", F.concat(F.lit("bar:"), digits)).where(digits != "")
    rows = barred.select(text.clean(F.col("display_name")).alias("label"), "_key", F.explode("case_numbers").alias("record")).where("label <> '' and trim(record) <> ''")
    routes = builds.build_facet(rows, "label", "record", F.col("_key"), least=1)
    return {"list": named["list"], "search": named["search"].unionByName(routes["search"]), "cases": named["cases"].unionByName(routes["cases"])}


def publish_facet(tables: dict[str, DataFrame], path: str, collation: str | None = "UNICODE") -> dict[str, int]:
    """Publishes a facet's three tables as one set; returns their rows."""
    return facet_tables(tables["list"], tables["search"], tables["cases"], path, collation)


def publish_matters(built: dict[str, DataFrame], path: str, expected: int, shard: int = 250, order: list[Column] | None = None) -> dict[str, int]:
    """Publishes what builds.enrich_matters gives: ranked rows in shards, matter types and categories by frequency, groups in blocks, totals.

    The rows must be as many as the manifest counted (`expected`).
    """
    rows = rankings.ordinals(built["rows"], order or [F.col("case_number")], "place")
    rows = rankings.shards(rows, "place", shard)
    n = rows.count()
    if n != expected:
        raise ValueError(f"enriched {n} of {expected} rows")
    named = lambda key, label: built["rows"].groupBy(F.col(key).alias("key"), F.col(label).alias("label"))
    count = F.count(F.lit(1)).alias("case_count")
    types = named("matter_type_key", "matter_type").agg(count)
    categories = named("matter_category_key", "matter_category").agg(count, F.min("matter_type_key").alias("matter_type"))
    totals = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("matter_type_key").alias("types"), F.count_distinct("matter_category_key").alias("categories"), F.count_if(F.col("matter_category") == "Unknown").alias("without_category"))
    plain = lambda df, at: df.write.parquet(at)
    return publish_set(rows.sparkSession, path, {
        "rows": (rows, lambda df, at: df.repartition("shard").sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(at)),
        "types": (types.orderBy(*facet_order(collation="UNICODE")), plain), "categories": (categories.orderBy(*facet_order(collation="UNICODE")), plain),
        "groups": (built["groups"], plain), "totals": (totals, plain),
    })


def publish_profiles(summaries: DataFrame, bar: str, path: str, source_commit: str = "", buckets: int = 256) -> dict[str, int]:
    """Publishes attorneys' summaries by bucket (an invalid or repeated one is an error) and what they count."""
    rows = builds.attorney_profiles(summaries, bar, buckets)
    about = summaries.agg(F.count(F.lit(1)).alias("record_count"), F.sum("judgment_count").alias("judgment_count"), F.sum("total_amount").alias("total_amount"))
    about = about.select(F.lit(1).alias("schema_version"), F.lit(source_commit).alias("source_commit"), F.lit(buckets).alias("bucket_count"), "*")
    return publish_set(summaries.sparkSession, path, {
        "profiles": (rows, lambda df, at: df.repartition("bucket").sortWithinPartitions("bucket", bar).write.partitionBy("bucket").parquet(at)),
        "about": (about, lambda df, at: df.write.json(at)),
    })


def route_shards(records: DataFrame, old_routes: DataFrame, kind: str, key: str, record_buckets: int = 1024, lookup_buckets: int = 256) -> dict[str, DataFrame]:
    """{"records", "routes"}: records dealt to buckets by their key, and the old routes led to their new places.

    records: path and idx (their old place), display_name and whatever they hold; a record
    without a key is not published and routes to it go.  old_routes: route, path, idx; of a
    route that stands twice the first place counts.
    """
    rows = records.withColumn("_key", F.trim(F.coalesce(F.col(key).cast("string"), F.lit("")))).where("_key <> ''")
    placed = cut(record_places(rows.withColumn("_old", F.struct("path", "idx")), kind, "_key", "_old", record_buckets))
    new = placed.select("path", "idx", "record_bucket", "record_index", "display_name")
    once = old_routes.groupBy("route").agg(F.min(F.struct("path", "idx")).alias("x")).select("route", "x.*")
    led = once.join(new, ["path", "idx"]).select("route", "record_bucket", "record_index", "display_name")
    routes = led.withColumn("lookup_bucket", bucket_name(lookup_bucket(kind, F.col("route"), lookup_buckets), lookup_buckets))
    return {"records": placed.drop("_key", "_old"), "routes": routes}


def publish_routes(built: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Publishes route_shards(): records by bucket in their order, routes by lookup bucket."""
    return publish_set(built["records"].sparkSession, path, {
        "records": (built["records"], lambda df, at: df.repartition("record_bucket").sortWithinPartitions("record_bucket", "record_index").write.partitionBy("record_bucket").parquet(at)),
        "routes": (built["routes"], lambda df, at: df.repartition("lookup_bucket").write.partitionBy("lookup_bucket").parquet(at)),
    })


def drill_down(rows: DataFrame, levels: list[str], measures: dict[str, Column]) -> DataFrame:
    """(depth, levels.., measures.., share): the measures of every node of a taxonomy path, from all (depth 0) to the leaves.

    `share` is the first measure's percentage of the node above, if it can be added up.  A
    missing name is a node of its own.
    """
    first = next(iter(measures))
    deep = reduce(lambda a, b: a + b, [1 - F.grouping(c) for c in levels])
    out = rows.rollup(*levels).agg(deep.cast("int").alias("depth"), *[m.alias(n) for n, m in measures.items()])
    # the node above: one level less of the path; rows are nodes here, not records
    above = F.struct(F.col("depth"), *[F.when(F.col("depth") > i + 1, F.struct(F.col(c).alias("v"))).alias(c) for i, c in enumerate(levels)])
    whole = F.sum(first).over(Window.partitionBy(above))
    return out.select("depth", *levels, *measures, F.when(whole != 0, F.round(100 * F.col(first) / whole, 4)).alias("share"))


def dashboard(rows: DataFrame, axes: list[str], measures: dict[str, Column]) -> DataFrame:
    """(axis, value, measures..): the measures by each axis for itself, in one pass over the rows."""
    out = rows.groupingSets([[F.col(a)] for a in axes], *axes).agg(*[F.grouping(a).alias(f"_g{i}") for i, a in enumerate(axes)], *[m.alias(n) for n, m in measures.items()])
    axis = F.coalesce(*[F.when(F.col(f"_g{i}") == 0, F.lit(a)) for i, a in enumerate(axes)])
    value = F.coalesce(*[F.when(F.col(f"_g{i}") == 0, F.col(a).cast("string")) for i, a in enumerate(axes)])
    return out.select(axis.alias("axis"), value.alias("value"), *measures)
