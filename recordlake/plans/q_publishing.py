"""Queries of builds that end in published sets: what readers find there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import builds, lineage, publishing
from ..sources import sinks
from .bindings import CASES, cases, query, table
from .q_builds import DIRECTORY, _directory


def _read(spark, at, name):
    return spark.read.parquet(sinks.current(spark, f"{at}/{name}"))


@query("decreed_names_published", f"""{DIRECTORY}, n AS (SELECT case_number, decreed_name AS label FROM d WHERE year % 2 = 0 UNION SELECT case_number, 'In re  ' || c_name FROM d WHERE year % 2 = 1 UNION SELECT case_number, decreed_name FROM d WHERE year % 2 = 1),
 k AS (SELECT case_number, trim(regexp_replace(label, ' +', ' ', 'g')) AS label, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS facet_key FROM n)
 SELECT 'cases' AS part, facet_key, CAST(count(DISTINCT case_number) AS BIGINT) AS n FROM k GROUP BY facet_key UNION ALL SELECT 'list', trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')), CAST(count(DISTINCT case_number) AS BIGINT) FROM k GROUP BY label""")
def decreed_names_published(spark, d):
    rows = _directory(spark, d)
    names = F.when(F.col("year") % 2 == 1, F.array(F.concat(F.lit("In re  "), F.element_at("names", 2)), F.col("decreed_name"), F.col("decreed_name")))
    at = f"{lineage.folder(spark)}/decreed"
    publishing.publish_facet(publishing.decreed_names(rows.withColumn("decreed_names", names)), at)
    from ..functions import text

    picked = spark.read.json(sinks.current(spark, f"{at}/list")).select(F.lit("list").alias("part"), text.search_key(F.col("label")).alias("facet_key"), F.col("case_count").alias("n"))
    return _read(spark, at, "cases").groupBy(F.lit("cases").alias("part"), "facet_key").agg(F.count(F.lit(1)).alias("n")).union(picked)


@query("counsel_published", """WITH a AS (SELECT s_suppkey AS k, 'Ann ' || CASE WHEN s_nationkey % 3 = 0 THEN 'LAKE' ELSE 'Lake' END || ' ' || s_nationkey AS label, s_suppkey % 40 AS bar FROM supplier), c AS (SELECT k, label, bar, 'C' || l_orderkey AS record FROM a JOIN lineitem ON l_suppkey = k)
 SELECT facet_key, CAST(count(DISTINCT record) AS BIGINT) AS n FROM (SELECT lower(label) AS facet_key, record FROM c UNION ALL SELECT 'bar:' || bar, record FROM c WHERE bar > 0) GROUP BY facet_key""")
def counsel_published(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    held = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.collect_set(F.concat(F.lit("C"), F.col("l_orderkey").cast("string"))).alias("case_numbers"))
    last = F.when(F.col("s_nationkey") % 3 == 0, "LAKE").otherwise("Lake")
    rows = s.join(held, "s_suppkey").select(F.concat_ws(" ", F.lit("Ann"), last, F.col("s_nationkey").cast("string")).alias("display_name"), F.when(k % 40 > 0, F.concat(F.lit("No. "), (k % 40).cast("string"))).alias("bar_number"), "case_numbers")
    at = f"{lineage.folder(spark)}/counsel"
    publishing.publish_facet(publishing.counsel(rows), at)
    return _read(spark, at, "cases").groupBy("facet_key").agg(F.count(F.lit(1)).alias("n"))


@query("parties_published", "WITH p AS (SELECT c_mktsegment || ' ' || c_nationkey AS label, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey) SELECT label, CAST(count(*) AS BIGINT) AS case_count FROM p GROUP BY label HAVING count(*) >= 5")
def parties_published(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    rows = c.groupBy("c_custkey", F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("display_name")).agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("case_numbers"))
    at = f"{lineage.folder(spark)}/parties"
    publishing.publish_facet(publishing.listed_names(rows, least=5), at)
    return spark.read.json(sinks.current(spark, f"{at}/list")).select("label", "case_count")


@query("matters_published", """WITH t AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'Civil Root' ELSE 'Civil' END AS t, CASE o_orderkey % 3 WHEN 0 THEN 'Contract' WHEN 1 THEN 'Orphan' ELSE 'Unknown' END AS c FROM orders)
 SELECT 'types' AS part, t AS label, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY t UNION ALL SELECT 'categories', c, CAST(count(*) AS BIGINT) FROM t GROUP BY c UNION ALL SELECT 'groups', c, CAST(count(*) AS BIGINT) FROM t GROUP BY c
 UNION ALL SELECT 'rows', 'shards', CAST((count(*) + 249) // 250 AS BIGINT) FROM t UNION ALL SELECT 'totals', 'without_category', CAST(count(*) FILTER (WHERE c = 'Unknown') AS BIGINT) FROM t UNION ALL SELECT 'manifest', 'faults', 0""")
def matters_published(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("cgc-"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("case_number"))
    label = F.when(F.col("o_orderkey") % 3 == 0, "CONTRACT!").when(F.col("o_orderkey") % 3 == 1, "Orphan")
    packed = o.withColumn("label", label).groupBy("label", (F.col("o_orderkey") % 40).alias("g")).agg(F.array_join(F.collect_list("case_number"), ",").alias("cases"))
    categories = spark.createDataFrame([("c2", "contract", 0), ("c2", "Contract", 1), ("gone", "Orphan", 2)], "parent_id string, label string, pos int")
    nodes = spark.createDataFrame([("r", None, "Civil Root"), ("c1", "r", "Mid"), ("c2", "c1", "Low")], "id string, parent_id string, label string")
    at = f"{lineage.folder(spark)}/matters"
    publishing.publish_matters(builds.enrich_matters(o, packed, categories, nodes), at, table(spark, d, "orders").count())
    part = lambda name, label, n: _read(spark, at, name).select(F.lit(name).alias("part"), label.alias("label"), n.alias("n"))
    groups = _read(spark, at, "groups").groupBy("matter_category").agg(F.sum("case_count").alias("n")).select(F.lit("groups").alias("part"), F.col("matter_category").alias("label"), "n")
    shards = _read(spark, at, "rows").agg(F.lit("rows").alias("part"), F.lit("shards").alias("label"), F.count_distinct("shard").alias("n"))
    faults = sinks.set_faults(spark, at).agg(F.lit("manifest").alias("part"), F.lit("faults").alias("label"), F.count(F.lit(1)).alias("n"))
    out = part("types", F.col("label"), F.col("case_count")).union(part("categories", F.col("label"), F.col("case_count")))
    return out.union(groups).union(shards).union(part("totals", F.lit("without_category"), F.col("without_category"))).union(faults)


@query("profiles_published", """WITH h AS (SELECT s_suppkey, CAST(list_reduce([CAST(ord(c) AS HUGEINT) for c in string_split('attorney:' || s_suppkey, '')], lambda a, b: (xor(a, b) * 16777619) % 4294967296, CAST(2166136261 AS HUGEINT)) AS BIGINT) % 256 AS b FROM supplier JOIN (SELECT DISTINCT l_suppkey FROM lineitem) ON l_suppkey = s_suppkey),
 l AS (SELECT l_suppkey, count(*) AS n, count(DISTINCT l_orderkey) AS cases, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1) SELECT lower(lpad(to_hex(b), 2, '0')) AS bucket, CAST(count(*) AS BIGINT) AS profiles, CAST(sum(n) AS BIGINT) AS judgments, CAST(sum(cases) AS BIGINT) AS cases FROM h JOIN l ON l_suppkey = s_suppkey GROUP BY 1""")
def profiles_published(spark, d):
    by = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("bar")).agg(F.count(F.lit(1)).alias("judgment_count"), F.count_distinct("l_orderkey").alias("case_count"), F.sum("l_extendedprice").cast("double").alias("total_amount"), F.max("l_extendedprice").cast("double").alias("largest_amount"))
    at = f"{lineage.folder(spark)}/profiles"
    publishing.publish_profiles(by, "bar", at)
    rows = spark.read.schema(by.schema.add("bucket", "string")).parquet(sinks.current(spark, f"{at}/profiles"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("profiles"), F.sum("judgment_count").alias("judgments"), F.sum("case_count").alias("cases"))


@query("routes_published", """WITH r AS (SELECT p_partkey AS idx, 'shard-' || (p_size % 5) || '.json' AS path, CASE WHEN p_size % 7 > 0 THEN 'id' || p_partkey END AS id, p_name FROM part),
 o AS (SELECT 'name/' || p_partkey AS route, 'shard-' || (p_size % 5) || '.json' AS path, p_partkey AS idx FROM part UNION ALL SELECT 'old/' || p_partkey, 'shard-9.json', p_partkey FROM part) SELECT route, p_name AS display_name FROM o JOIN r USING (path, idx) WHERE id IS NOT NULL""")
def routes_published(spark, d):
    """Every published route leads to the record that it named before."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    path = F.concat(F.lit("shard-"), (F.col("p_size") % 5).cast("string"), F.lit(".json"))
    records = p.select(path.alias("path"), k.alias("idx"), F.when(F.col("p_size") % 7 > 0, F.concat(F.lit("id"), k.cast("string"))).alias("id"), F.col("p_name").alias("display_name"))
    old = p.select(F.concat(F.lit("name/"), k.cast("string")).alias("route"), path.alias("path"), k.alias("idx")).union(p.select(F.concat(F.lit("old/"), k.cast("string")), F.lit("shard-9.json"), k))
    at = f"{lineage.folder(spark)}/routes"
    publishing.publish_routes(publishing.route_shards(records, old, "parts", "id", 64, 16), at)
    places = _read(spark, at, "records").select(F.col("record_bucket").cast("string").alias("b"), "record_index", "display_name")
    routes = _read(spark, at, "routes").select("route", F.col("record_bucket").cast("string").alias("rb"), "record_index")
    width = lambda c: F.lpad(F.regexp_replace(c, r"[.]0$", ""), 4, "0")
    return routes.withColumn("k", width(F.col("rb"))).join(places.withColumn("k", width(F.col("b"))), ["k", "record_index"]).select("route", "display_name")


@query("statistics_drilldown", f"""WITH {CASES}, r AS (SELECT prefix[1] AS track, prefix, CASE WHEN status = 'P' THEN NULL ELSE status END AS status, amount FROM cases),
 g AS (SELECT 3 - grouping(track) - grouping(prefix) - grouping(status) AS depth, track, prefix, status, count(*) AS n, round(sum(amount), 2) AS total FROM r GROUP BY ROLLUP (track, prefix, status)),
 p AS (SELECT *, sum(n) OVER (PARTITION BY depth, CASE WHEN depth > 1 THEN track END, CASE WHEN depth > 2 THEN prefix END) AS whole FROM g)
 SELECT CAST(depth AS INTEGER) AS depth, track, prefix, status, CAST(n AS BIGINT) AS cases, round(100.0 * n / whole, 4) AS share FROM p""")
def statistics_drilldown(spark, d):
    rows = cases(spark, d).select(F.substring("prefix", 1, 1).alias("track"), "prefix", F.when(F.col("status") != "P", F.col("status")).alias("status"), "amount")
    return publishing.drill_down(rows, ["track", "prefix", "status"], {"cases": F.count(F.lit(1)), "total": F.sum("amount")}).drop("total")


@query("statistics_dashboard", f"""WITH {CASES} SELECT 'year' AS axis, CAST(year AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS cases, CAST(count(*) FILTER (WHERE status = 'O') AS BIGINT) AS open FROM cases GROUP BY year
 UNION ALL SELECT 'track', prefix[1], CAST(count(*) AS BIGINT), CAST(count(*) FILTER (WHERE status = 'O') AS BIGINT) FROM cases GROUP BY prefix[1] UNION ALL SELECT 'status', CASE WHEN status <> 'P' THEN status END, CAST(count(*) AS BIGINT), CAST(count(*) FILTER (WHERE status = 'O') AS BIGINT) FROM cases GROUP BY 2""")
def statistics_dashboard(spark, d):
    rows = cases(spark, d).select("year", F.substring("prefix", 1, 1).alias("track"), F.when(F.col("status") != "P", F.col("status")).alias("status"))
    return publishing.dashboard(rows, ["year", "track", "status"], {"cases": F.count(F.lit(1)), "open": F.count_if(F.col("status") == "O")})
