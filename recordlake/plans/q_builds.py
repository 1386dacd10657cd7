"""Queries of composed builds, the search language and small directory helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import builds, identity, rankings, search, taxonomy
from .bindings import CASES, CATEGORY, SEARCH_KEY, cases, query, table


def _suppliers(spark, d):
    """Firms of every kind: suppliers, with counts from their keys."""
    k = F.col("s_suppkey")
    gov = F.when(k % 5 == 0, "State").when(k % 5 == 1, "Federal").when(k % 5 == 2, "Water Board")
    return table(spark, d, "supplier").select(
        k.alias("entity_id"), F.col("s_name").alias("display_name"), (k % 4).alias("attorney_count"), (k % 7).alias("case_count"),
        F.when(k % 3 == 0, "Government").when(k % 3 == 1, "Private").otherwise("Solo").alias("firm_category"), gov.alias("government_firm_category"),
    )


FIRMS = """firms AS (SELECT s_suppkey AS entity_id, s_name AS display_name, s_suppkey % 4 AS attorney_count, s_suppkey % 7 AS case_count, CASE s_suppkey % 3 WHEN 0 THEN 'Government' WHEN 1 THEN 'Private' ELSE 'Solo' END AS firm_category,
 CASE s_suppkey % 5 WHEN 0 THEN 'State' WHEN 1 THEN 'Federal' WHEN 2 THEN 'Water Board' END AS gov FROM supplier)"""


@query("firm_order", f"WITH {FIRMS} SELECT entity_id, row_number() OVER (ORDER BY attorney_count DESC, case_count DESC, display_name, CAST(entity_id AS VARCHAR)) AS ordinal FROM firms")
def firm_order(spark, d):
    return rankings.ordinals(_suppliers(spark, d), builds.sort_keys("firms")).select("entity_id", "ordinal")


@query("judge_order", f"WITH {FIRMS} SELECT entity_id, row_number() OVER (ORDER BY case_count DESC, display_name, CAST(entity_id AS VARCHAR)) AS ordinal FROM firms")
def judge_order(spark, d):
    return rankings.ordinals(_suppliers(spark, d), builds.sort_keys("judges")).select("entity_id", "ordinal")


@query("firm_partition", f"WITH {FIRMS} SELECT CASE WHEN firm_category = 'Government' THEN 'Government - ' || CASE WHEN gov IN ('State', 'Federal') THEN gov ELSE 'Other Government' END ELSE firm_category END AS label, count(*) AS entity_count, CAST(sum(attorney_count) AS BIGINT) AS attorney_count, CAST(sum(case_count) AS BIGINT) AS case_count FROM firms GROUP BY 1")
def firm_partition(spark, d):
    return builds.firm_partition(_suppliers(spark, d))


@query("category_counts_explicit", f"""WITH {CASES} SELECT o_custkey, {CATEGORY} AS category, count(DISTINCT case_number) AS n FROM cases WHERE o_custkey % 4 > 0 GROUP BY 1, 2
 UNION ALL SELECT c_custkey, 'Probate', 7 FROM customer WHERE c_custkey % 4 = 0""")
def category_counts_explicit(spark, d):
    told = F.when(F.col("c_custkey") % 4 == 0, '{"Probate":7,"Civil":0,"Unheard":3}').when(F.col("c_custkey") % 4 == 1, "not json")
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), told.alias("told"))
    refs = cases(spark, d).select("o_custkey", text.record_category(F.col("case_number")).alias("category"), text.record_key(F.col("case_number")).alias("record_key"))
    return builds.category_counts(e, "o_custkey", "told", refs)


@query("effective_counts", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 AND c_custkey > 0 THEN c_custkey WHEN c_custkey % 4 = 2 THEN NULL ELSE 2 END AS n, CASE WHEN c_custkey % 4 = 0 AND c_custkey > 0 THEN c_custkey WHEN c_custkey % 4 = 2 THEN 0 ELSE 2 END AS judge_n FROM customer")
def effective_counts(spark, d):
    k = F.col("c_custkey")
    explicit = F.when(k % 4 == 0, k).when(k % 4 == 3, 0)
    listed = F.when(k % 4 != 2, F.array(F.lit("a"), F.lit("b")))
    return table(spark, d, "customer").select("c_custkey", builds.effective_count(explicit, listed).cast("long").alias("n"), builds.effective_count(explicit, listed, True).cast("long").alias("judge_n"))


def _histogram(spark, d):
    c = cases(spark, d).select(F.col("o_custkey").alias("entity_id"), "year", text.record_category(F.col("case_number")).alias("category"))
    return c.groupBy("entity_id", "year", "category").agg(F.count(F.lit(1)).alias("n"))


@query("year_compact_rows", f"""WITH {CASES}, h AS (SELECT o_custkey, year, {CATEGORY} AS category, count(*) AS n FROM cases GROUP BY ALL) SELECT o_custkey AS entity_id, c_name AS display_name, year, CAST(sum(n) AS BIGINT) AS year_count, string_agg(category || ':' || n, ',' ORDER BY category) AS by_category
 FROM h JOIN customer ON c_custkey = o_custkey GROUP BY ALL""")
def year_compact_rows(spark, d):
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("display_name"), F.col("c_acctbal").alias("not_kept"))
    rows = builds.year_rows(e, _histogram(spark, d), "firms")
    pairs = F.transform(F.map_entries("category_counts"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string")))
    return rows.select("entity_id", "display_name", "year", "year_count", F.array_join(pairs, ",").alias("by_category"))


@query("kind_tables", f"""WITH {CASES}, h AS (SELECT o_custkey, year, {CATEGORY} AS category FROM cases) SELECT 'categories' AS part, category AS label, count(DISTINCT o_custkey) AS entity_count, count(*) AS case_count FROM h GROUP BY category
 UNION ALL SELECT 'years', CAST(year AS VARCHAR), count(DISTINCT o_custkey), count(*) FROM h GROUP BY year UNION ALL SELECT 'rows', 'all', count(*), max(r) FROM (SELECT row_number() OVER () AS r FROM customer)""")
def kind_tables(spark, d):
    h = _histogram(spark, d)
    n = h.groupBy("entity_id").agg(F.sum("n").alias("case_count"))
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("display_name")).join(n, "entity_id", "left").withColumn("case_count", F.coalesce("case_count", F.lit(0)))
    t = builds.build_kind("judges", e, h)
    part = lambda name, label: t[name].select(F.lit(name).alias("part"), F.col(label).cast("string").alias("label"), "entity_count", "case_count")
    rows = t["rows"].agg(F.count(F.lit(1)).alias("entity_count"), F.max("ordinal").alias("case_count")).select(F.lit("rows").alias("part"), F.lit("all").alias("label"), "entity_count", "case_count")
    return part("categories", "category").union(part("years", "year")).union(rows)


@query("facet_build", f"""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE upper(p_brand) || '!' END AS label FROM part), k AS (SELECT *, {SEARCH_KEY.format("label")} AS facet_key FROM r)
 SELECT 'list' AS part, facet_key, count(DISTINCT p_partkey) AS n FROM k GROUP BY 2 HAVING count(DISTINCT p_partkey) >= 30 UNION ALL SELECT 'search', facet_key, count(DISTINCT label) FROM k GROUP BY 2 UNION ALL SELECT 'cases', facet_key, count(DISTINCT p_partkey) FROM k GROUP BY 2""")
def facet_build(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k, F.when(k % 2 == 0, F.col("p_brand")).otherwise(F.concat(F.upper("p_brand"), F.lit("!"))).alias("label"))
    t = builds.build_facet(rows, "label", "p_partkey", least=30)
    count = lambda name: t[name].groupBy("facet_key").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "facet_key", "n")
    return t["list"].select(F.lit("list").alias("part"), "facet_key", F.col("case_count").alias("n")).union(count("search")).union(count("cases"))


@query("counsel_facet", f"""SELECT {SEARCH_KEY.format("s_name")} AS facet_key, count(DISTINCT s_nationkey) AS n FROM supplier GROUP BY 1 UNION ALL SELECT 'bar:' || s_suppkey % 9, count(DISTINCT s_nationkey) FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1""")
def counsel_facet(spark, d):
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").withColumn("bar", F.when(k % 2 == 0, F.concat(F.lit("No. "), (k % 9).cast("string"))))
    return builds.counsel_facet(rows, "s_name", "bar", "s_nationkey")["cases"].groupBy("facet_key").agg(F.count(F.lit(1)).alias("n"))


@query("officer_merge_counts", """WITH o AS (SELECT p_partkey // 3 AS r, CASE p_partkey % 3 WHEN 0 THEN 'ann lake ' || 'n' || p_size WHEN 1 THEN 'ann b lake n' || p_size ELSE 'ann bea lake n' || p_size END AS v, 'ann bea lake n' || p_size AS w, p_size, p_partkey % 3 AS m FROM part),
 t AS (SELECT p_size, max(m) AS m FROM o GROUP BY p_size) SELECT CASE t.m WHEN 0 THEN 'ann lake n' WHEN 1 THEN 'ann b lake n' ELSE 'ann bea lake n' END || p_size AS norm, count(DISTINCT r) AS case_count FROM o JOIN t USING (p_size) GROUP BY 1""")
def officer_merge_counts(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    name = F.concat(F.when(k % 3 == 0, "ann ").when(k % 3 == 1, "ann b ").otherwise("ann bea "), F.lit("lake n"), size)
    rows = table(spark, d, "part").select(F.floor(k / 3).alias("r"), name.alias("norm"))
    # 'lake n5' would be two words: the surname is the last one, lake a middle name
    mapping = identity.merge_names(rows.withColumn("norm", F.regexp_replace("norm", "lake n", "lake-n")))
    mapping = mapping.select(F.regexp_replace("norm", "lake-n", "lake n").alias("norm"), F.regexp_replace("target", "lake-n", "lake n").alias("target"))
    return identity.merged_records(rows, mapping, "r")


@query("officer_facet_build", """WITH o AS (SELECT p_partkey // 2 AS r, 'zed' || p_size AS norm, p_partkey FROM part), c AS (SELECT norm, count(DISTINCT r) AS case_count FROM o GROUP BY norm)
 SELECT norm, case_count, CASE WHEN CAST(substr(norm, 4) AS INTEGER) % 2 = 0 THEN 5 ELSE 0 END AS rulings FROM c""")
def officer_facet_build(spark, d):
    k, name = F.col("p_partkey"), F.concat(F.lit("zed"), F.col("p_size").cast("string"))
    raw = F.when(k % 2 == 0, F.concat(F.lit("Hon. "), F.initcap(name))).otherwise(F.concat(F.lit("Judge "), F.upper(name)))
    rows = table(spark, d, "part").select(F.floor(k / 2).alias("r"), raw.alias("raw"), k.alias("pos"))
    counted = table(spark, d, "part").select("p_size").distinct().select(F.concat(F.lit("Judge Zed"), F.col("p_size").cast("string")).alias("spelling"), F.when(F.col("p_size") % 2 == 0, 5).otherwise(-1).alias("n"))
    return builds.officer_facet(rows, "raw", "r", "pos", rulings=counted).select("norm", "case_count", "rulings")


@query("taxonomy_cycles", """SELECT p_partkey AS id, 'L' || CASE WHEN p_partkey % 28 < 25 THEN p_partkey // 28 * 28 ELSE p_partkey END AS root_label FROM part""")
def taxonomy_cycles(spark, d):
    """Chains of 25 levels beside cycles of three."""
    k = F.col("p_partkey")
    place, block = k % 28, F.floor(k / 28) * 28
    parent = F.when(place == 0, None).when(place < 25, k - 1).when(place == 25, k + 2).otherwise(k - 1)
    return taxonomy.roots(_closed(table(spark, d, "part"), k, place, parent, block))


def _closed(part, k, place, parent, block):
    """The last block may miss the end of its cycle: such nodes point nowhere."""
    last = part.agg(F.max("p_partkey").alias("last"))
    rows = part.withColumn("one", F.lit(1)).join(F.broadcast(last.withColumn("one", F.lit(1))), "one").select(k.alias("id"), F.when(parent <= F.col("last"), parent).alias("parent_id"), F.concat(F.lit("L"), k.cast("string")).alias("label"), place.alias("place"), block.alias("block"), "last")
    broken = (F.col("place") > 24) & (F.col("block") + 27 > F.col("last"))
    return rows.select("id", F.when(~broken, F.col("parent_id")).alias("parent_id"), "label")


@query("matter_build", """WITH t AS (SELECT o_orderkey, 'CGC' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS c FROM orders) SELECT CASE o_orderkey % 3 WHEN 0 THEN 'Civil Root' ELSE 'Civil' END AS matter_type, CASE o_orderkey % 3 WHEN 0 THEN 'Contract' WHEN 1 THEN 'Orphan' ELSE 'Unknown' END AS matter_category, count(*) AS case_count FROM t GROUP BY 1, 2""")
def matter_build(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("cgc-"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("case_number"))
    label = F.when(F.col("o_orderkey") % 3 == 0, "CONTRACT!").when(F.col("o_orderkey") % 3 == 1, "Orphan")
    packed = o.withColumn("label", label).groupBy("label", (F.col("o_orderkey") % 40).alias("g")).agg(F.array_join(F.collect_list("case_number"), ",").alias("cases"))
    categories = spark.createDataFrame([("c2", "contract", 0), ("c2", "Contract", 1), ("gone", "Orphan", 2)], "parent_id string, label string, pos int")
    nodes = spark.createDataFrame([("r", None, "Civil Root"), ("c1", "r", "Mid"), ("c2", "c1", "Low")], "id string, parent_id string, label string")
    t = builds.enrich_matters(o.withColumn("case_number", F.regexp_replace("case_number", "-", "")), packed, categories, nodes)
    return t["rows"].groupBy("matter_type", "matter_category").agg(F.count(F.lit(1)).alias("case_count"))


def _ranked(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 0")
    name = lambda n: F.struct(F.lit(n).alias("attorney_name"))
    return o.select(
        F.concat(F.lit("C"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("case_number"), F.col("o_orderpriority").alias("case_title"), F.col("o_totalprice").alias("judgment_amount"),
        (F.col("o_orderkey") % 50 + 1).alias("rank"), F.array(name(" Ann Lake "), name(" ")).alias("attorneys"),
    )


def _announced(spark, d):
    """The rows that a manifest would count, read from another column than the index is made of."""
    return table(spark, d, "orders").where("o_totalprice > 0").select("o_orderstatus").count()


@query("judgment_details", """WITH r AS (SELECT 'C' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS case_number, o_orderkey % 50 + 1 AS rank, o_orderpriority AS case_title FROM orders WHERE o_totalprice > 0), o AS (SELECT *, row_number() OVER (ORDER BY rank, case_number) AS ordinal FROM r)
 SELECT case_number, ordinal, CAST((ordinal - 1) // 250 AS BIGINT) AS shard, case_title, 'Ann Lake' AS names, CAST(NULL AS VARCHAR) AS matter_type FROM o""")
def judgment_details(spark, d):
    t = builds.judgment_index(_ranked(spark, d), _announced(spark, d))["details"]
    return t.select("case_number", "ordinal", "shard", "case_title", F.array_join("attorney_names", ";").alias("names"), "matter_type")


@query("judgment_search", "SELECT 'C' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS case_number FROM orders WHERE o_totalprice > 0 AND (contains(lower(o_orderpriority), '00000001') OR contains(lpad(CAST(o_orderkey AS VARCHAR), 9, '0'), '00000001'))")
def judgment_search(spark, d):
    t = builds.judgment_index(_ranked(spark, d), _announced(spark, d))
    return search.search_postings(t["postings"], t["details"], "ordinal", ["case_number", "case_title"], "00000001").select("case_number")


@query("attorney_profiles", """WITH h AS (SELECT s_suppkey, CAST(list_reduce([CAST(ord(c) AS HUGEINT) for c in string_split('attorney:' || s_suppkey, '')], lambda a, b: (xor(a, b) * 16777619) % 4294967296, CAST(2166136261 AS HUGEINT)) AS BIGINT) % 256 AS b FROM supplier) SELECT s_suppkey AS bar, lower(lpad(to_hex(b), 2, '0')) AS bucket FROM h""")
def attorney_profiles(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("bar"), F.lit(3).alias("judgment_count"), F.lit(2).alias("case_count"), F.lit(10.0).alias("total_amount"), F.lit(4.0).alias("largest_amount"))
    return builds.attorney_profiles(s, "bar").select("bar", "bucket")


STATES = ["complete", "essential", "partial-docs", "summary-only", "no-docs", "indexed", "discovered", "not-found", "restricted"]


def _states(spark, d):
    state = F.element_at(F.array(*map(F.lit, STATES)), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return cases(spark, d).withColumn("state", state)


STATE_COUNTS = ", ".join(f"count(*) FILTER (WHERE o_orderkey % 9 = {i}) AS {s.replace('-', '_')}" for i, s in enumerate(STATES))


@query("coverage_states", f"WITH {CASES} SELECT prefix, year, CAST(grouping(year) AS INTEGER) AS level, count(*) AS records, {STATE_COUNTS}, count(*) FILTER (WHERE o_orderkey % 9 < 5) AS captured FROM cases GROUP BY GROUPING SETS ((prefix, year), (prefix))")
def coverage_states(spark, d):
    return builds.coverage(_states(spark, d), "prefix", "year", "state")


@query("rows_summary", "WITH n AS (SELECT count(*) FILTER (WHERE o_orderkey % 9 < 5) AS captured, count(*) FILTER (WHERE o_orderkey % 9 IN (5, 6)) AS discovered, count(*) FILTER (WHERE o_orderkey % 9 = 8) AS restricted, count(*) FILTER (WHERE o_orderkey % 9 = 7) AS missing FROM orders) SELECT * FROM n")
def rows_summary(spark, d):
    return builds.rows_summary(_states(spark, d), "state").drop("label")


@query("directory_totals", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 WHEN 2 THEN 9.0 ELSE 5.0 END AS total FROM customer")
def directory_totals(spark, d):
    k = F.col("c_custkey") % 4
    return table(spark, d, "customer").select("c_custkey", builds.captured_total(F.when(k == 0, 0).when(k == 1, -3), F.when(k == 2, F.lit("9")).when(k == 3, "5").otherwise("7")).alias("total"))


@query("category_contributions", f"""WITH {CASES}, h AS (SELECT o_custkey, {CATEGORY} AS c FROM cases), b AS (SELECT o_custkey, count(*) FILTER (WHERE c IN ('Civil', 'Probate')) AS matters, count(*) AS all_matters FROM h GROUP BY 1)
 SELECT o_custkey AS entity_id, matters, all_matters, round(100 * matters / all_matters, 4) AS share, row_number() OVER (ORDER BY matters DESC, o_custkey) AS rank FROM b WHERE matters > 0""")
def category_contributions(spark, d):
    return builds.category_contributions(_histogram(spark, d), "entity_id", ["Civil", "Probate"])


@query("statistics_table", f"""WITH {CASES}, c AS (SELECT {CATEGORY} AS category, amount FROM cases), a AS (SELECT category, count(*) AS n FROM c GROUP BY 1), b AS (SELECT o_orderstatus AS category, count(*) AS n, max(o_custkey) AS top FROM orders GROUP BY 1)
 SELECT 'cases' AS dataset, category, 'n' AS measure, CAST(n AS DOUBLE) AS value FROM a UNION ALL SELECT 'orders', category, 'n', n FROM b UNION ALL SELECT 'orders', category, 'top', top FROM b""")
def statistics_table(spark, d):
    a = cases(spark, d).groupBy(text.record_category(F.col("case_number")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.max("o_custkey").alias("top"))
    return builds.statistics({"cases": a, "orders": b})


@query("ranked_page", "SELECT o_orderkey, ordinal FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS ordinal FROM orders) WHERE ordinal BETWEEN 51 AND 100")
def ranked_page(spark, d):
    rows = rankings.ordinals(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    return builds.page(rows, "ordinal", 50, 50).select("o_orderkey", "ordinal")


@query("events_by_hash", """WITH e AS (SELECT user_id AS k, event_id, unnest(['a' || event_id % 7, 'b' || event_id % 5, 'c' || event_id % 3]) AS hash FROM events), w AS (SELECT DISTINCT user_id AS k, unnest(['a1', 'b2', 'c0', 'zz']) AS hash FROM events)
 SELECT k, hash, min(event_id) AS event_id FROM w JOIN e USING (k, hash) GROUP BY ALL""")
def events_by_hash(spark, d):
    i = F.col("event_id")
    t = lambda head, n: F.concat(F.lit(head), (i % n).cast("string"))
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), i, i.alias("pos"), t("a", 7).alias("entry_hash"), t("b", 5).alias("row_hash"), t("c", 3).alias("evidence_hash"))
    wanted = e.select("k").distinct().select("k", F.explode(F.array(*map(F.lit, ["a1", "b2", "c0", "zz"]))).alias("hash"))
    return builds.events_by_hash(e, "k", ["entry_hash", "row_hash", "evidence_hash"], wanted)


@query("entity_directory_rows", f"WITH {CASES} SELECT o_custkey, case_number, amount FROM cases WHERE year BETWEEN 1995 AND 1996")
def entity_directory_rows(spark, d):
    c = cases(spark, d)
    refs, directory = c.select("o_custkey", "prefix", "year", "case_number"), c.select("prefix", "year", "case_number", "amount")
    return builds.entity_records(refs, directory, 1995, 1996).select("o_custkey", "case_number", "amount")


@query("prefix_order", f"""WITH {CASES}, p AS (SELECT DISTINCT prefix FROM cases UNION ALL SELECT 'ZZZ' UNION ALL SELECT '(none)'), l AS (SELECT prefix AS code, CASE prefix WHEN 'CRI' THEN 4 WHEN 'PES' THEN 2 WHEN 'FDI' THEN 1 WHEN 'ZZZ' THEN 6 WHEN '(none)' THEN 5 ELSE 0 END AS g,
 CASE prefix WHEN 'CRI' THEN 'Criminal' WHEN 'PES' THEN 'Probate - Estate' WHEN 'FDI' THEN 'Family - Dissolution' WHEN 'CGC' THEN 'Civil - General Civil' WHEN 'CUD' THEN 'Civil - Unlawful Detainer' WHEN 'ZZZ' THEN 'ZZZ' ELSE 'No Prefix / Legacy' END AS label FROM p)
 SELECT code, CASE WHEN code = '(none)' THEN label ELSE label || ' (' || code || ')' END AS label, row_number() OVER (ORDER BY g, label, code) AS ordinal FROM l""")
def prefix_order(spark, d):
    p = cases(spark, d).select("prefix").distinct().union(spark.createDataFrame([("zzz",), (None,)], "prefix string"))
    p = p.select(text.prefix_code(F.col("prefix")).alias("code"), text.prefix_order(F.col("prefix")).alias("o"), text.prefix_label(F.col("prefix")).alias("label"))
    return rankings.ordinals(p, [F.col("o.grp_sort"), F.col("o.label"), F.col("o.code")]).select("code", "label", "ordinal")


@query("directory_numbers", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 0.0 ELSE -2.0 END AS finite, CASE c_custkey % 3 WHEN 0 THEN 1.5 ELSE 0.0 END AS positive, CASE WHEN c_custkey = 1 THEN '1 row' ELSE CASE WHEN c_custkey < 1000 THEN CAST(c_custkey AS VARCHAR) ELSE (c_custkey // 1000) || ',' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') END || ' rows' END AS label FROM customer")
def directory_numbers(spark, d):
    raw = F.when(F.col("c_custkey") % 3 == 0, "1.5").when(F.col("c_custkey") % 3 == 1, "x").otherwise("-2")
    return table(spark, d, "customer").select("c_custkey", text.finite_or_zero(raw).alias("finite"), text.not_negative(raw).alias("positive"), text.plural(F.col("c_custkey"), "row", "rows").alias("label"))


@query("pretty_labels", "SELECT p_partkey, upper(p_name[1]) || lower(p_name[2:]) || ' of the UCL' AS label, 'Mixed ' || p_partkey || ' (CASE)' AS mixed FROM (SELECT p_partkey, 'X' || p_partkey AS p_name FROM part)")
def pretty_labels(spark, d):
    n = F.col("p_partkey").cast("string")
    return table(spark, d, "part").select("p_partkey", text.pretty_label(F.concat(F.lit("AND X"), n, F.lit("  OF THE UCL;"))).alias("label"), text.pretty_label(F.concat(F.lit("Mixed "), n, F.lit(" (CASE)"))).alias("mixed"))


@query("json_lists", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'a|b' ELSE '' END AS items, CASE c_custkey % 3 WHEN 1 THEN 1 ELSE 0 END AS entries FROM customer")
def json_lists(spark, d):
    raw = F.when(F.col("c_custkey") % 3 == 0, '["a","b"]').when(F.col("c_custkey") % 3 == 1, '{"x":"1"}').otherwise("nonsense")
    return table(spark, d, "customer").select("c_custkey", F.array_join(text.json_list(raw), "|").alias("items"), F.size(text.json_map(raw)).alias("entries"))


def _directory(spark, d):
    c = cases(spark, d).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return c.select("case_number", F.concat(F.lit("In re "), "c_name").alias("case_title"), F.col("c_mktsegment").alias("decreed_name"), "prefix", "year", F.array("c_mktsegment", "c_name").alias("names"))


DIRECTORY = f"WITH {CASES}, d AS (SELECT case_number, 'In re ' || c_name AS case_title, c_mktsegment AS decreed_name, prefix, year, c_name FROM cases JOIN customer ON c_custkey = o_custkey)"


@query("dsl_free_text", f"{DIRECTORY} SELECT case_number FROM d WHERE (contains(lower(case_title), '0007') OR contains(lower(case_number), '0007') OR contains(lower(decreed_name), '0007') OR contains(lower(prefix), '0007')) AND contains(lower(decreed_name), 'mach') AND year >= 1996")
def dsl_free_text(spark, d):
    q = search.parse_query('0007 decreed-name:"MACH" from:1996')
    return search.directory(_directory(spark, d), q).select("case_number")


@query("dsl_hyphen_names", f"{DIRECTORY} SELECT case_number FROM d WHERE NOT contains(lower(decreed_name), 'build') AND contains(lower(case_title), '9')")
def dsl_hyphen_names(spark, d):
    return search.directory(_directory(spark, d), search.parse_query("-dn:build case-title:9")).select("case_number")


@query("dsl_multi_value", f"{DIRECTORY} SELECT case_number FROM d WHERE (contains(lower(decreed_name), '77') OR contains(lower(c_name), '77')) AND NOT contains(lower(decreed_name), 'auto') AND NOT contains(lower(c_name), 'auto')")
def dsl_multi_value(spark, d):
    return search.directory(_directory(spark, d), search.parse_query("names:77 -names:auto")).select("case_number")


@query("dsl_case_number_exact", f"{DIRECTORY} SELECT case_number FROM d WHERE case_number = (SELECT min(case_number) FROM cases)")
def dsl_case_number_exact(spark, d):
    least = cases(spark, d).agg(F.min("case_number")).first()[0]
    q = search.Query(clauses=[search.Clause("case_number", "exact", least.lower().replace("-", ""))])
    return search.directory(_directory(spark, d), q).select("case_number")


@query("directory_full", f"""{DIRECTORY}, x AS (SELECT * FROM d WHERE prefix IN ('CGC', 'CRI') AND year BETWEEN 1995 AND 1997 AND contains(lower(case_title), '1') AND contains(lower(decreed_name), 'b') AND case_number NOT IN (SELECT case_number FROM d WHERE decreed_name = 'AUTOMOBILE'))
 SELECT case_number, (SELECT count(*) FROM x) > 40 AS overflow FROM (SELECT * FROM x ORDER BY case_number LIMIT 40)""")
def directory_full(spark, d):
    df = _directory(spark, d)
    q = search.parse_query("1 decreed-name:b from:1995 to:1997")
    out = df.where("decreed_name = 'AUTOMOBILE'").select("case_number")
    return search.filter_directory(df, q, "case_number", [F.col("case_number")], 40, out, fields=["case_title"], prefixes=["CGC", "CRI"]).select("case_number", "overflow")


@query("dsl_or_negative", f"""{DIRECTORY} SELECT case_number FROM d WHERE year >= 1997 AND (contains(lower(case_title), '33') OR decreed_name = 'FURNITURE' OR NOT (decreed_name IN ('BUILDING', 'MACHINERY') AND decreed_name IN ('BUILDING', 'HOUSEHOLD')))""")
def dsl_or_negative(spark, d):
    df = _directory(spark, d)
    named = lambda *v: df.where(F.col("decreed_name").isin(*v)).select("case_number")
    q = search.parse_query("case_title:33 from:1997")
    return search.any_branch(df, q, "case_number", [named("FURNITURE")], [named("BUILDING", "MACHINERY"), named("BUILDING", "HOUSEHOLD")]).select("case_number")


@query("picked_facets", f"{DIRECTORY} SELECT case_number, decreed_name = 'BUILDING' AS chosen FROM d WHERE decreed_name IN ('BUILDING', 'HOUSEHOLD')")
def picked_facets(spark, d):
    df = _directory(spark, d)
    rows = df.select(text.search_key(F.col("decreed_name")).alias("facet_key"), "case_number")
    yes = search.picked_member(search.Clause("decreed_name", "exact", "", ("building",)), "case_number", rows, df)
    other = search.picked_member(search.Clause("decreed_name", "not_contains", "", ("building", "furniture", "machinery", "automobile")), "case_number", rows, df)
    return yes.select("case_number", F.lit(True).alias("chosen")).union(other.select("case_number", F.lit(False)))


@query("facet_search", "SELECT DISTINCT c_name AS label FROM customer WHERE contains(lower(c_name), '00012')")
def facet_search(spark, d):
    return search.facet_search(table(spark, d, "customer").select(F.col("c_name").alias("label")).distinct(), "label", " 00012!")


@query("alias_identities", "SELECT p_partkey, CASE WHEN p_size = 7 THEN 'seven' ELSE 's' || p_size END AS norm FROM part")
def alias_identities(spark, d):
    names = table(spark, d, "part").select("p_partkey", F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("norm"))
    return identity.remap_aliases(names, "norm", spark.createDataFrame([("s7", "seven"), ("s99", "none")], "alias string, identity string"))


@query("roster_judges", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 5 < 3")
def roster_judges(spark, d):
    k = F.col("s_suppkey")
    status = F.when(k % 5 == 0, "current").when(k % 5 == 1, "former").when(k % 5 == 2, "historical").otherwise("unknown")
    p = table(spark, d, "supplier").select(k, F.when(k % 2 == 0, "judge").otherwise("attorney").alias("profile_type"), status.alias("roster_status"))
    return identity.roster_judges(p).select("s_suppkey")


@query("checked_headline", "SELECT count(*) AS cases, count(*) + 1 AS comparable_rows FROM orders")
def checked_headline(spark, d):
    m = table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n")).withColumn("rows", F.col("n") + 1)
    return builds.checked_headline(m, "n", "rows").select("cases", "comparable_rows")


@query("prefix_counts", f"WITH {CASES} SELECT prefix, count(*) AS n FROM cases WHERE year = 1996 GROUP BY prefix")
def prefix_counts(spark, d):
    return search.in_years(cases(spark, d), search.parse_query("from:1996 to:1996")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
