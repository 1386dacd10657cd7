"""Composed builds: entity kinds, facets by source, ranked search index, matter enrichment, attorney summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.fixed import CATEGORY_ORDER, DETAIL_COLUMNS, YEAR_COLUMNS
from ..functions.hashing import bucket_name, fnv1a32
from . import bands, facets, identity, rankings, search, taxonomy
from .records import valid_summaries


def sort_keys(kind: str) -> list[Column]:
    """Published order of a kind: firms by attorneys first, all by count, name and id."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).desc()
    names = [text.clean(F.col("display_name")), text.clean(F.col("entity_id").cast("string"))]
    return [n("attorney_count"), n("case_count"), *names] if kind == "firms" else [n("case_count"), *names]


def effective_count(explicit: Column, listed: Column, keep_zero: bool = False) -> Column:
    """The explicit count, else the number of listed records; null (to be dropped) where it is not positive."""
    n = F.when(F.coalesce(explicit, F.lit(0)) > 0, explicit).otherwise(F.coalesce(F.size(listed), F.lit(0)))
    return n if keep_zero else F.when(n > 0, n)


def category_counts(entities: DataFrame, entity: str, explicit: str, refs: DataFrame) -> DataFrame:
    """(entity, category, n): the explicit map (JSON text) where it has an entry, else distinct records by category."""
    told = entities.select(entity, text.json_map(F.col(explicit)).alias("m")).where(F.size("m") > 0)
    own = told.select(entity, F.explode("m").alias("category", "v")).select(entity, "category", F.col("v").try_cast("long").alias("n"))
    own = own.where(F.col("category").isin(*CATEGORY_ORDER) & (F.col("n") > 0))
    rest = refs.join(told.select(entity), entity, "left_anti").groupBy(entity, "category").agg(F.count_distinct("record_key").alias("n"))
    return own.unionByName(rest)


def firm_partition(firms: DataFrame) -> DataFrame:
    """Entities, attorneys and records by the eight kinds of firm; every firm is in one at most."""
    gov = F.when(F.col("government_firm_category").isin("City and County of San Francisco", "Municipalities", "State", "Federal", "Joint Powers Authorities"), F.col("government_firm_category"))
    label = F.when(F.col("firm_category") == "Government", F.concat(F.lit("Government - "), F.coalesce(gov, F.lit("Other Government")))).when(F.col("firm_category").isin("Private", "Solo"), F.col("firm_category"))
    n = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c)
    return firms.withColumn("label", label).where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("entity_count"), n("attorney_count"), n("case_count"))


def year_rows(entities: DataFrame, histogram: DataFrame, kind: str, entity: str = "entity_id") -> DataFrame:
    """One row an entity and year with records: the kind's columns, the year's count and its counts by category.

    histogram: entity, year, category, n.
    """
    columns = [c for c in YEAR_COLUMNS[kind] if c in entities.columns]
    by = histogram.where("n > 0").groupBy(entity, "year").agg(F.sum("n").alias("year_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("category_counts"))
    return entities.select(*dict.fromkeys([entity, *columns])).join(by, entity)


def build_kind(kind: str, entities: DataFrame, histogram: DataFrame) -> dict[str, DataFrame]:
    """The published tables of a kind: rows in order, quantiles, bands, categories, years, and firm types.

    One pass over the entities a table; only the numbering is global.
    """
    out = {
        "rows": rankings.ordinals(entities, sort_keys(kind)),
        "quantiles": bands.quantiles(entities, "case_count"),
        "bands": bands.bands(entities, "case_count", kind == "judges"),
        "categories": histogram.groupBy("category").agg(F.count_distinct("entity_id").alias("entity_count"), F.sum("n").alias("case_count")),
        "years": histogram.groupBy("year").agg(F.count_distinct("entity_id").alias("entity_count"), F.sum("n").alias("case_count")),
    }
    if kind == "firms":
        out["firm_types"] = firm_partition(entities)
    return out


def build_facet(rows: DataFrame, label: str, record: str, key: Column | None = None, least: int = 2, collation: str | None = None) -> dict[str, DataFrame]:
    """The three tables of a facet: picker (records from `least`), search (every spelling) and cases (record sets)."""
    k = text.search_key(F.col(label)) if key is None else key
    keyed = rows.withColumn("facet_key", k).where(F.coalesce(F.col("facet_key"), F.lit("")) != "")
    every = facets.facet(rows, label, record, key=k, least=1, collation=collation)
    spelled = keyed.select("facet_key", F.col(label).alias("label")).distinct()
    return {"list": every.where(F.col("case_count") >= least), "search": spelled, "cases": keyed.select("facet_key", record).distinct()}


def counsel_facet(attorneys: DataFrame, name: str, bar: str, record: str) -> dict[str, DataFrame]:
    """build_facet of attorneys by name, and again by their bar number (key bar:<digits>)."""
    digits = F.regexp_replace(F.coalesce(F.col(bar).cast("string"), F.lit("")), "[^0-9]", "")
    by_bar = attorneys.withColumn("facet_key", F.concat(F.lit("bar:"), digits)).where(digits != "")
    a, b = build_facet(attorneys, name, record, least=1), build_facet(by_bar, name, record, F.col("facet_key"), least=1)
    return {n: a[n].unionByName(b[n]) for n in a}


def officer_facet(rows: DataFrame, raw: str, record: str, pos: str, aliases: dict[str, str] | None = None, rulings: DataFrame | None = None, roster: DataFrame | None = None, least: int = 1) -> DataFrame:
    """(norm, label, case_count, rulings) of officers.

    A record counts once per officer, also under several merged names; names
    merge as identity.merge_names says; rulings (spelling, n) count where a
    spelling of the roster (owner, spelling) or a label belongs to one officer.
    """
    keyed = rows.withColumn("norm", text.officer_identity(F.col(raw), aliases)).where("norm <> ''")
    once = keyed.groupBy(record, "norm").agg(F.min_by(raw, pos).alias("variant"))
    mapping = identity.merge_names(once)
    variants = identity.remerge(once.groupBy("norm", "variant").agg(F.count(F.lit(1)).alias("n")), mapping)
    labels = facets.canonical_officer_label(variants).select("norm", "label")
    out = identity.merged_records(once, mapping, record).where(F.col("case_count") >= least).join(labels, "norm")
    if rulings is None:
        return out.withColumn("rulings", F.lit(0).cast("long"))
    spelled = variants.select(F.col("norm").alias("owner"), text.officer_key(F.col("variant")).alias("spelling"))
    if roster is not None:
        spelled = spelled.union(roster.select("owner", text.officer_key(F.col("spelling"))))
    only = spelled.distinct().groupBy("spelling").agg(F.count_distinct("owner").alias("k"), F.min("owner").alias("norm")).where("k = 1")
    n = rulings.where("n >= 0").select(text.officer_key(F.col("spelling")).alias("spelling"), "n").join(only, "spelling").groupBy("norm").agg(F.sum("n").alias("rulings"))
    return out.join(n, "norm", "left").withColumn("rulings", F.coalesce("rulings", F.lit(0)))


def enrich_matters(ranked: DataFrame, packed: DataFrame, categories: DataFrame, nodes: DataFrame) -> dict[str, DataFrame]:
    """Ranked records with their matter type and category, the facet counts and the packed groups.

    packed: (label, cases as comma text); a record of two categories is an error.
    """
    lookup = taxonomy.category_lookup(categories, nodes)
    rows = taxonomy.exploded_cases(packed.withColumn("category_key", text.search_key(F.col("label"))), "category_key", "cases")
    rows = rows.withColumn("case_number", text.strict_record_key(F.col("case_number"))).join(lookup, "category_key")
    ranked = ranked.withColumn("case_number", text.strict_record_key(F.col("case_number")))
    needed = rows.join(ranked.select("case_number").distinct(), "case_number", "left_semi").select("case_number", "matter_type", "matter_category").distinct()
    clash = taxonomy.conflicts(needed, "case_number", "matter_category").limit(3).collect()
    if clash:
        raise ValueError(f"records of several categories: {[r[0] for r in clash]}")
    enriched = taxonomy.enrich(ranked, "case_number", needed)
    keys = ["matter_type", "matter_type_key", "matter_category", "matter_category_key"]
    return {"rows": enriched, "facets": taxonomy.facet_counts(enriched), "groups": facets.pack_blocks(enriched, keys, "case_number")}


def compact_rows(ranked: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The detail columns in their order, missing ones null, with the attorneys' trimmed names."""
    names = F.array().cast("array<string>")
    if "attorneys" in ranked.columns:
        names = F.filter(F.transform("attorneys", lambda a: F.trim(F.coalesce(a["attorney_name"], F.lit("")))), lambda n: n != "")
    own = {"ordinal": F.col(ordinal), "attorney_names": names}
    return ranked.select(*[own[c].alias(c) if c in own else F.col(c) if c in ranked.columns else F.lit(None).cast("string").alias(c) for c in DETAIL_COLUMNS])


def ranking_faults(ranked: DataFrame) -> DataFrame:
    """(fault, n) of rows that may not be published: a blank or repeated number, an amount or rank that is none."""
    number = text.strict_record_key(F.col("case_number"))
    amount, rank = F.col("judgment_amount").cast("double"), F.col("rank")
    bad_amount = ~F.coalesce((amount > 0) & ~F.isnan(amount) & (amount != float("inf")), F.lit(False))
    one = ranked.agg(F.count_if(number == "").alias("blank number"), F.count_if(bad_amount).alias("amount"), F.count_if(~F.coalesce(rank >= 1, F.lit(False))).alias("rank"))
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("fault"), F.col(f"`{c}`").alias("n")) for c in one.columns])).alias("x")).select("x.*")
    again = ranked.groupBy(number.alias("k")).agg(F.count(F.lit(1)).alias("c")).where("c > 1 and k <> ''").agg(F.count(F.lit(1)).alias("n"))
    return rows.union(again.select(F.lit("repeated number"), "n")).where("n > 0")


def judgment_index(ranked: DataFrame, expected: int, shard: int = 250, buckets: int = 64) -> dict[str, DataFrame]:
    """Validated search index of ranked rows: details in shards of `shard`, and posting blocks."""
    faults = {r["fault"]: r["n"] for r in ranking_faults(ranked).collect()}  # four rows at most
    if faults:
        raise ValueError(f"rows that may not be published: {faults}")
    rows = rankings.ordinals(ranked, [F.col("rank"), F.col("case_number")])
    if rows.count() != expected:
        raise ValueError("the manifest counts other rows")
    details = rankings.shards(compact_rows(rows), "ordinal", shard)
    names = F.array_join("attorney_names", " ; ")
    return {"details": details, "postings": search.posting_blocks(details.withColumn("names", names), "ordinal", F.col("case_number"), F.col("case_title"), F.col("names"), buckets=buckets)}


def attorney_profiles(summaries: DataFrame, bar: str, buckets: int = 256) -> DataFrame:
    """Summaries with their bucket, if all are valid and no bar number repeats; else an error that counts the faults."""
    ok = valid_summaries(summaries, "judgment_count", "case_count", "total_amount", "largest_amount")
    again = summaries.groupBy(bar).agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.count(F.lit(1)).alias("n"))
    bad, twice = summaries.where(~F.coalesce(ok, F.lit(False))).count(), again.first()["n"]
    if bad or twice:
        raise ValueError(f"{bad} invalid summaries, {twice} repeated bar numbers")
    return summaries.withColumn("bucket", bucket_name(fnv1a32(F.concat(F.lit("attorney:"), F.col(bar).cast("string"))) % buckets, buckets))


def captured_total(explicit: Column, fallback: Column) -> Column:
    """The explicit number, even if it is 0, else the one from the state counts; never negative."""
    return F.when(explicit.isNotNull(), text.not_negative(explicit)).otherwise(text.not_negative(fallback))


#: States that count as discovered only.
DISCOVERED_STATES = ("discovered", "indexed")
CAPTURED_STATES = ("complete", "essential", "partial-docs", "summary-only", "no-docs")
ALL_STATES = (*CAPTURED_STATES, "indexed", "discovered", "not-found", "restricted")


def rows_summary(states: DataFrame, state: str) -> DataFrame:
    """One row of captured, discovered, restricted and missing records, and their text."""
    from .casefacts import discovery_text

    s = F.col(state)
    n = states.agg(F.count(F.lit(1)).alias("all"), F.count_if(s.isin(*DISCOVERED_STATES)).alias("discovered"), F.count_if(s == "restricted").alias("restricted"), F.count_if(s == "not-found").alias("missing"))
    n = n.select((F.col("all") - F.col("discovered") - F.col("restricted") - F.col("missing")).alias("captured"), "discovered", "restricted", "missing")
    return n.withColumn("label", discovery_text(F.col("captured"), F.col("discovered"), F.col("restricted"), F.col("missing")))


def coverage(rows: DataFrame, prefix: str, year: str, state: str) -> DataFrame:
    """Records by prefix and by prefix and year, one column a state, with the captured ones (level 0: year, 1: prefix)."""
    of = lambda s: F.count_if(F.col(state) == s).alias(s.replace("-", "_"))
    sets = rows.groupingSets([[prefix, year], [prefix]], prefix, year)
    out = sets.agg(F.grouping(year).cast("int").alias("level"), F.count(F.lit(1)).alias("records"), *[of(s) for s in ALL_STATES])
    return out.withColumn("captured", sum(F.col(s.replace("-", "_")) for s in CAPTURED_STATES))


def category_contributions(histogram: DataFrame, entity: str, selected: list[str] | None = None) -> DataFrame:
    """Entities ranked by their records of the selected categories, with these as a share of all (none without a choice)."""
    chosen = F.col("category").isin(selected) if selected else F.lit(True)
    by = histogram.groupBy(entity).agg(F.coalesce(F.sum(F.when(chosen, F.col("n"))), F.lit(0)).alias("matters"), F.sum("n").alias("all_matters"))
    share = F.round(100 * F.col("matters") / F.col("all_matters"), 4) if selected else F.lit(None).cast("double")
    return rankings.ordinals(by.where("matters > 0").withColumn("share", share), [F.col("matters").desc(), F.col(entity)], "rank")


def statistics(datasets: dict[str, DataFrame]) -> DataFrame:
    """(dataset, category, measure, value): the datasets' numeric columns beside their category, one after the other."""
    parts = []
    for name, df in datasets.items():
        numbers = [c for c, t in df.dtypes if c != "category" and t in ("int", "bigint", "double")]
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in numbers])).alias("x")
        parts.append(df.select(F.lit(name).alias("dataset"), F.col("category").cast("string").alias("category"), pairs).select("dataset", "category", "x.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def page(rows: DataFrame, ordinal: str, after: int, size: int) -> DataFrame:
    """The next `size` rows after an ordinal: a range condition, which prunes ordered shards."""
    return rows.where((F.col(ordinal) > after) & (F.col(ordinal) <= after + size))


def checked_headline(metrics: DataFrame, headline: str, index_rows: str) -> DataFrame:
    """The headline count, which must be positive, and the index rows where the two can be compared, else null."""
    n, rows = F.col(headline), F.col(index_rows)
    good = F.when(n > 0, n).otherwise(F.raise_error(F.lit("the headline count is not positive")))
    return metrics.select(good.cast("long").alias("cases"), F.when((rows > 0) & (rows >= n), rows).alias("comparable_rows"), F.format_number(n, 0).alias("shown"))


def events_by_hash(events: DataFrame, key: str, hashes: list[str], wanted: DataFrame) -> DataFrame:
    """(key, wanted hash, event_id): the first event any of whose hashes is the wanted one.

    Three columns of hashes become rows, so the OR of conditions is an equi-join.
    """
    rows = events.select(key, "event_id", "pos", F.explode(F.array(*hashes)).alias("hash")).where("hash is not null")
    return wanted.join(rows, [key, "hash"]).groupBy(key, "hash").agg(F.min_by("event_id", "pos").alias("event_id"))


def entity_records(refs: DataFrame, directory: DataFrame, first: int, last: int) -> DataFrame:
    """Directory rows of an entity's references, the directory pruned to the years (and prefixes) they fall in."""
    r = refs.where(F.col("year").between(first, last))
    return directory.where(F.col("year").between(first, last)).join(r, ["prefix", "year", "case_number"])
