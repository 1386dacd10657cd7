"""Queries of counts, bands, facets, identity and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import bands, facets, identity, rankings, taxonomy
from .bindings import CASES, CATEGORIES, CATEGORY, OFFICER_KEY, OFFICERS, REFS, SEARCH_KEY, cases, categories, officers, query, refs, table

COUNTS = f"""{CASES}, {REFS}, counts AS (SELECT entity_id, count(DISTINCT upper(replace(replace(case_number, '-', ''), '_', ''))) AS case_count FROM refs GROUP BY entity_id)"""
BANDS = "bandt(band_order, band, lo, hi) AS (VALUES (0, '10000-plus', 10000, NULL), (1, '5000-9999', 5000, 9999), (2, '1000-4999', 1000, 4999), (3, '500-999', 500, 999), (4, '250-499', 250, 499), (5, '100-249', 100, 249), (6, '50-99', 50, 99), (7, '25-49', 25, 49), (8, '10-24', 10, 24), (9, '5-9', 5, 9), (10, '2-4', 2, 4), (11, '1', 1, 1){zero})"


def distinct_refs(spark, d):
    return bands.distinct_records(refs(spark, d), "entity_id", "case_number", "filed", "pos")


def entity_counts(spark, d):
    return distinct_refs(spark, d).groupBy("entity_id").agg(F.count(F.lit(1)).alias("case_count"))


@query("entity_bands", f"WITH {COUNTS}, {BANDS.format(zero='')} SELECT CAST(band_order AS BIGINT) AS band_order, band, count(entity_id) AS entity_count, CAST(coalesce(sum(case_count), 0) AS BIGINT) AS case_count FROM bandt LEFT JOIN counts ON case_count >= lo AND (hi IS NULL OR case_count <= hi) GROUP BY ALL")
def entity_bands(spark, d):
    return bands.bands(entity_counts(spark, d), "case_count").withColumn("band_order", F.col("band_order").cast("long"))


@query("entity_bands_with_zero", f"WITH {COUNTS}, {BANDS.format(zero=', (12, %s, 0, 0)' % repr('0'))}, every AS (SELECT c_custkey, coalesce(case_count, 0) AS case_count FROM customer LEFT JOIN counts ON c_custkey = entity_id) SELECT band, count(c_custkey) AS entity_count FROM bandt LEFT JOIN every ON case_count >= lo AND (hi IS NULL OR case_count <= hi) GROUP BY band")
def entity_bands_with_zero(spark, d):
    c = table(spark, d, "customer").join(entity_counts(spark, d), F.col("c_custkey") == F.col("entity_id"), "left")
    return bands.bands(c.select("c_custkey", F.coalesce("case_count", F.lit(0)).alias("case_count")), "case_count", True).select("band", "entity_count")


@query("entity_quantiles", f"WITH {COUNTS} SELECT CAST(min(case_count) AS DOUBLE) AS min, round(quantile_cont(case_count, 0.5), 6) AS p50, round(quantile_cont(case_count, 0.9), 6) AS p90, round(quantile_cont(case_count, 0.95), 6) AS p95, round(quantile_cont(case_count, 0.99), 6) AS p99, round(quantile_cont(case_count, 0.999), 6) AS p999, CAST(max(case_count) AS DOUBLE) AS max FROM counts")
def entity_quantiles(spark, d):
    return bands.quantiles(entity_counts(spark, d), "case_count")


@query("category_counts", f"WITH {CASES} SELECT o_custkey AS entity_id, {CATEGORY} AS category, count(*) AS n FROM cases GROUP BY ALL")
def category_counts(spark, d):
    return distinct_refs(spark, d).groupBy("entity_id", text.record_category(F.col("record_key")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("year_histogram", f"WITH {CASES} SELECT o_custkey AS entity_id, year AS y, count(*) AS n FROM cases GROUP BY ALL")
def year_histogram(spark, d):
    y = dates.record_year(F.col("number"), F.col("filed"), 2026).cast("long")
    return distinct_refs(spark, d).groupBy("entity_id", y.alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("category_year_histogram", f"WITH {CASES} SELECT {CATEGORY} AS category, year AS y, count(*) AS n, count(DISTINCT o_custkey) AS entities FROM cases GROUP BY ALL")
def category_year_histogram(spark, d):
    y = dates.record_year(F.col("number"), F.col("filed"), 2026).cast("long")
    return distinct_refs(spark, d).groupBy(text.record_category(F.col("record_key")).alias("category"), y.alias("y")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_id").alias("entities"))


@query("band_filter_metadata", f"""WITH {COUNTS}, per AS (SELECT entity_id, any_value(case_count) AS case_count, count(*) FILTER (WHERE {CATEGORY} = 'Criminal') AS cr, count(*) FILTER (WHERE {CATEGORY} = 'Civil') AS cv FROM counts JOIN cases ON o_custkey = entity_id GROUP BY entity_id),
 {BANDS.format(zero='')} SELECT band, count(*) AS entities, count(*) FILTER (WHERE cr > 0) AS with_criminal, count(*) FILTER (WHERE cv > 0) AS with_civil FROM per JOIN bandt ON case_count >= lo AND (hi IS NULL OR case_count <= hi) GROUP BY band""")
def band_filter_metadata(spark, d):
    cat = text.record_category(F.col("record_key"))
    per = distinct_refs(spark, d).groupBy("entity_id").agg(F.count(F.lit(1)).alias("c"), F.count_if(cat == "Criminal").alias("cr"), F.count_if(cat == "Civil").alias("cv"))
    return per.groupBy(bands.band_of(F.col("c")).alias("band")).agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("cr") > 0).alias("with_criminal"), F.count_if(F.col("cv") > 0).alias("with_civil"))


@query("category_partition", f"WITH {CASES}, e AS (SELECT o_custkey, {CATEGORY} AS category, count(*) AS n FROM cases GROUP BY ALL) SELECT category, count(*) AS entity_count, CAST(sum(n) AS BIGINT) AS case_count FROM e GROUP BY category")
def category_partition(spark, d):
    return category_counts(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("entity_count"), F.sum("n").alias("case_count"))


@query("year_partition_topn", f"WITH {CASES}, e AS (SELECT o_custkey AS entity_id, year AS y, count(*) AS n FROM cases GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY n DESC, entity_id) AS rank FROM e) SELECT * FROM r WHERE rank <= 10")
def year_partition_topn(spark, d):
    return bands.ranked(year_histogram(spark, d), ["y"], [F.col("n").desc(), F.col("entity_id")]).where("rank <= 10")


@query("parts_by_count", f"WITH {COUNTS}, r AS (SELECT entity_id, entity_id % 5 AS grp, row_number() OVER (PARTITION BY entity_id % 5 ORDER BY case_count DESC, entity_id) AS k FROM counts) SELECT grp, (k - 1) // 50 AS part, count(*) AS n, min(entity_id) AS least FROM r GROUP BY ALL")
def parts_by_count(spark, d):
    c = entity_counts(spark, d).withColumn("grp", F.col("entity_id") % 5)
    p = bands.parts_by_count(c, "grp", [F.col("case_count").desc(), F.col("entity_id")], 50)
    return p.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("least"))


@query("part_packing", """WITH RECURSIVE r AS (SELECT p_partkey, p_size % 3 AS grp, CAST(p_size * 100 AS BIGINT) AS s, row_number() OVER (PARTITION BY p_size % 3 ORDER BY p_partkey) AS k FROM part),
 w(grp, k, p_partkey, part, n, total) AS (SELECT grp, k, p_partkey, CAST(0 AS BIGINT), CAST(1 AS BIGINT), s FROM r WHERE k = 1
 UNION ALL SELECT r.grp, r.k, r.p_partkey, CASE WHEN w.n >= 20 OR w.total + r.s > 30000 THEN w.part + 1 ELSE w.part END, CASE WHEN w.n >= 20 OR w.total + r.s > 30000 THEN 1 ELSE w.n + 1 END,
 CASE WHEN w.n >= 20 OR w.total + r.s > 30000 THEN r.s ELSE w.total + r.s END FROM w JOIN r ON r.grp = w.grp AND r.k = w.k + 1) SELECT p_partkey, part FROM w""")
def part_packing(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 3).alias("grp"), (F.col("p_size") * 100).alias("size"))
    return bands.pack_parts(p, "grp", "p_partkey", "size", 20, 30000).select("p_partkey", "part")


@query("display_key_filter", "SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 4 <> 1) AS kept FROM customer")
def display_key_filter(spark, d):
    k = F.col("c_custkey") % 4
    norm = F.when(k == 0, F.lower("c_name")).when(k == 1, "somebody else").when(k == 2, F.concat("c_name", F.lit(" trust"))).otherwise("")
    ok = bands.display_is_consistent(F.col("c_name"), norm, F.lit(False))
    return table(spark, d, "customer").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("kept"))


CLERK_KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(label), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), '\b(?:the|a|an|of|for|to)\b', ' ', 'g'), '\s+', ' ', 'g'))"


@query("facet_counts", f"""WITH {CATEGORIES}, k AS (SELECT {SEARCH_KEY.format('label')} AS facet_key, label, p_partkey // 2 AS rec FROM cats), n AS (SELECT facet_key, label, count(*) AS n FROM k GROUP BY ALL),
 b AS (SELECT facet_key, label FROM (SELECT *, row_number() OVER (PARTITION BY facet_key ORDER BY n DESC, label) AS r FROM n) WHERE r = 1) SELECT facet_key, label, case_count FROM (SELECT facet_key, count(DISTINCT rec) AS case_count FROM k GROUP BY 1 HAVING count(DISTINCT rec) >= 2) JOIN b USING (facet_key)""")
def facet_counts(spark, d):
    return facets.facet(categories(spark, d).withColumn("rec", F.floor(F.col("p_partkey") / 2)), "label", "rec", least=2)


@query("clerk_facet", f"""WITH {CATEGORIES}, k AS (SELECT {CLERK_KEY} AS facet_key, label, p_partkey FROM cats), n AS (SELECT facet_key, label, count(*) AS n FROM k GROUP BY ALL),
 b AS (SELECT facet_key, label FROM (SELECT *, row_number() OVER (PARTITION BY facet_key ORDER BY n DESC, label) AS r FROM n) WHERE r = 1) SELECT facet_key, label, case_count FROM (SELECT facet_key, count(DISTINCT p_partkey) AS case_count FROM k GROUP BY 1) JOIN b USING (facet_key)""")
def clerk_facet(spark, d):
    return facets.facet(categories(spark, d), "label", "p_partkey", key=text.category_key(F.col("label")))


ONCE = f"""{OFFICERS}, k AS (SELECT case_id, raw, p_partkey, {OFFICER_KEY.format('raw')} AS norm FROM officers), once AS (SELECT case_id, norm, arg_min(raw, p_partkey) AS variant FROM k WHERE norm <> '' GROUP BY ALL), v AS (SELECT norm, variant, count(*) AS n FROM once GROUP BY ALL)"""


@query("officer_facet_distinct", f"WITH {ONCE} SELECT * FROM v")
def officer_facet_distinct(spark, d):
    return facets.officer_facet(officers(spark, d), "raw", "case_id", "p_partkey")


@query("officer_canonical_label", f"""WITH {ONCE}, k2 AS (SELECT *, {OFFICER_KEY.format('variant')} AS vk FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY CASE WHEN vk = norm THEN 0 ELSE 1 END, CASE WHEN vk = '' THEN 0 ELSE len(string_split(vk, ' ')) END DESC, n DESC, length(variant) DESC, variant) AS k FROM k2)
 SELECT norm, max(variant) FILTER (WHERE k = 1) AS label, CAST(sum(n) AS BIGINT) AS case_count FROM r GROUP BY norm""")
def officer_canonical_label(spark, d):
    return facets.canonical_officer_label(officer_facet_distinct(spark, d))


@query("alias_unique_join", """WITH n AS (SELECT p_brand AS owner, lower(p_name || ' ' || p_type || ' ' || p_size) AS s FROM part), one AS (SELECT s AS spelling, min(owner) AS owner FROM n GROUP BY s HAVING count(DISTINCT owner) = 1)
 SELECT * FROM one WHERE spelling NOT IN (SELECT lower(p_name || ' ' || p_type || ' ' || CAST(p_size * 2 AS VARCHAR)) FROM part)""")
def alias_unique_join(spark, d):
    """Owners and routes of every part; routes are spelled with twice the size."""
    p = table(spark, d, "part")
    names = p.select("p_brand", F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string")).alias("alias"))
    routes = p.select(F.lower(F.concat_ws(" ", "p_name", "p_type", (F.col("p_size") * 2).cast("string"))).alias("route"))
    return facets.unique_aliases(names, "p_brand", "alias", routes, "route")


@query("identity_merge_keys", """WITH n AS (SELECT DISTINCT string_split(lower(p_name), ' ') AS w FROM part), names AS (SELECT w[1] || ' ' || w[2] AS norm, w[1] AS first, w[2] AS last, CAST(NULL AS VARCHAR) AS mid FROM n UNION SELECT w[1] || ' ' || w[1][1] || ' ' || w[2], w[1], w[2], w[1][1] FROM n
 UNION SELECT w[1] || ' zed ' || w[2], w[1], w[2], 'zed' FROM n WHERE w[2] = 'bolt' UNION SELECT w[2], '', w[2], NULL FROM n),
 f AS (SELECT first, last, count(DISTINCT mid) = 1 AS unite, min(norm) AS root FROM names WHERE first <> '' GROUP BY ALL), r AS (SELECT norm, last, CASE WHEN unite THEN root ELSE norm END AS root FROM names JOIN f USING (first, last)),
 o AS (SELECT last, min(root) AS owner FROM r GROUP BY last HAVING count(DISTINCT root) = 1), e AS (SELECT norm, root FROM r UNION ALL SELECT norm, coalesce(owner, norm) FROM names LEFT JOIN o USING (last) WHERE first = ''),
 t AS (SELECT root, first_value(norm) OVER (PARTITION BY root ORDER BY len(string_split(norm, ' ')) DESC, length(norm) DESC, norm DESC) AS target, norm FROM e) SELECT norm, target FROM t""")
def identity_merge_keys(spark, d):
    w = table(spark, d, "part").select(F.split(F.lower("p_name"), " ").alias("w")).distinct()
    a, b = F.col("w")[0], F.col("w")[1]
    forms = F.array(F.concat_ws(" ", a, b), F.concat_ws(" ", a, F.substring(a, 1, 1), b), F.when(b == "bolt", F.concat_ws(" ", a, F.lit("zed"), b)), b)
    return identity.merge_names(w.select(F.explode(forms).alias("norm")).where("norm is not null"))


@query("facet_groups_pack", f"WITH {CASES} SELECT prefix, year AS y, count(*) AS case_count, string_agg(case_number, ',' ORDER BY case_number) AS cases FROM cases GROUP BY ALL")
def facet_groups_pack(spark, d):
    return facets.pack_groups(cases(spark, d).withColumnRenamed("year", "y"), ["prefix", "y"], "case_number")


@query("route_duplicates", "WITH r AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY p_name) - 1 AS duplicates FROM part) SELECT p_partkey, p_name, duplicates FROM r WHERE k = 1")
def route_duplicates(spark, d):
    return facets.first_arrivals(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")


NODES = "nodes AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id, r_name AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier)"


@query("taxonomy_roots", f"WITH RECURSIVE {NODES}, up(id, anc) AS (SELECT id, id FROM nodes UNION ALL SELECT up.id, n.parent_id FROM up JOIN nodes n ON n.id = up.anc WHERE n.parent_id IS NOT NULL) SELECT up.id, n.label AS root_label FROM up JOIN nodes n ON n.id = up.anc WHERE n.parent_id IS NULL")
def taxonomy_roots(spark, d):
    cat = lambda a, b: F.concat(F.lit(a), F.col(b).cast("string"))
    nodes = table(spark, d, "region").select(cat("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("label"))
    nodes = nodes.union(table(spark, d, "nation").select(cat("n", "n_nationkey"), cat("r", "n_regionkey"), "n_name")).union(table(spark, d, "supplier").select(cat("s", "s_suppkey"), cat("n", "s_nationkey"), "s_name"))
    return taxonomy.roots(nodes)


MATTER = f"""{CASES}, c AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN case_number ELSE 'none' || case_number END AS case_number, CASE WHEN o_orderkey % 6 = 0 THEN 'Unclassified' ELSE 'Region ' || (o_orderkey % 5) END AS t, 'Kind ' || (o_orderkey % 3) AS c FROM cases),
 e AS (SELECT case_number, CASE WHEN t IS NULL OR t = 'Unclassified' THEN CASE WHEN prefix IN ('CGC', 'CUD') THEN 'Civil' WHEN prefix = 'PES' THEN 'Probate' WHEN prefix = 'FDI' THEN 'Family' ELSE 'Criminal' END ELSE t END AS matter_type, coalesce(c.c, 'Unknown') AS matter_category FROM cases LEFT JOIN c USING (case_number))"""


def _enriched(spark, d):
    c = cases(spark, d)
    k = F.col("o_orderkey")
    number = F.when(k % 2 == 0, F.col("case_number")).otherwise(F.concat(F.lit("none"), "case_number"))
    cats = c.select(number.alias("case_number"), F.when(k % 6 == 0, "Unclassified").otherwise(F.concat(F.lit("Region "), (k % 5).cast("string"))).alias("matter_type"), F.concat(F.lit("Kind "), (k % 3).cast("string")).alias("matter_category"))
    return taxonomy.enrich(c.select("case_number"), "case_number", cats)


@query("matter_enrichment", f"WITH {MATTER} SELECT *, replace(lower(matter_type), ' ', '_') AS matter_type_key, replace(lower(matter_type), ' ', '_') || ':' || replace(lower(matter_category), ' ', '_') AS matter_category_key FROM e")
def matter_enrichment(spark, d):
    return _enriched(spark, d)


@query("matter_facet_counts", f"WITH {MATTER} SELECT matter_type, matter_category, count(*) AS n, CAST(grouping(matter_category) AS BIGINT) AS is_type FROM e GROUP BY GROUPING SETS ((matter_type), (matter_type, matter_category))")
def matter_facet_counts(spark, d):
    return taxonomy.facet_counts(_enriched(spark, d)).withColumn("is_type", F.col("is_type").cast("long"))


@query("category_conflicts", "SELECT p_name AS name, count(DISTINCT p_type) AS n FROM part GROUP BY p_name HAVING count(DISTINCT p_type) > 1")
def category_conflicts(spark, d):
    return taxonomy.conflicts(table(spark, d, "part"), "p_name", "p_type").withColumnRenamed("p_name", "name")


@query("ranking_ordinals", f"WITH {CASES}, r AS (SELECT case_number, row_number() OVER (ORDER BY amount DESC, o_orderkey) AS ordinal FROM cases) SELECT *, (ordinal - 1) // 250 AS shard FROM r")
def ranking_ordinals(spark, d):
    r = rankings.ordinals(cases(spark, d).select("case_number", "amount", "o_orderkey"), [F.col("amount").desc(), F.col("o_orderkey")])
    return rankings.shards(r.select("case_number", "ordinal"), "ordinal", 250)


@query("competition_rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS rank FROM part")
def competition_rank(spark, d):
    return rankings.competition(table(spark, d, "part"), ["p_brand"], "p_size").select("p_partkey", "rank")


@query("ranked_nulls_last", "WITH v AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 0 ELSE c_acctbal END AS v FROM customer) SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY v DESC NULLS LAST, c_custkey) AS rank FROM v")
def ranked_nulls_last(spark, d):
    v = F.when(F.col("c_custkey") % 5 == 0, None).when(F.col("c_custkey") % 5 == 1, 0.0).otherwise(F.col("c_acctbal"))
    return rankings.nulls_last(table(spark, d, "customer").withColumn("v", v), ["c_nationkey"], "v", "c_custkey").select("c_custkey", "rank")


@query("practice_share", f"WITH {CASES}, t AS (SELECT prefix, count(*) AS total FROM cases GROUP BY prefix) SELECT prefix, total, round(100.0 * total / sum(total) OVER (), 4) AS share FROM t")
def practice_share(spark, d):
    return rankings.share(cases(spark, d).withColumn("one", F.lit(1)), ["prefix"], "one")
