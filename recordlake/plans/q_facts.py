"""Queries of case facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import casefacts, facets
from .bindings import OFFICER_KEY, OFFICERS, officers, pleaded, query, table


def _records(spark, d):
    """One JSON record per order, with its lines as docket rows under two names."""
    li = table(spark, d, "lineitem")
    name = F.when(F.col("l_linenumber") % 2 == 0, "RTEXT").otherwise("description")
    row = F.to_json(F.create_map(name, F.concat(F.lit("Line "), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") == 3, " complaint").otherwise("")), F.lit("FILEDATE"), F.date_format("l_shipdate", "yyyy-MM-dd")))
    by = li.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", row.alias("j")))), lambda x: x["j"]).alias("rows"))
    return by.select("l_orderkey", F.concat(F.lit('{"docket_entries":['), F.array_join("rows", ","), F.lit("]}")).alias("record"))


@query("record_parts", "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, strftime(l_shipdate, '%Y-%m-%d')) - 1 AS idx, strftime(l_shipdate, '%Y-%m-%d') AS date_filed, 'Line ' || l_linenumber || CASE WHEN l_linenumber = 3 THEN ' complaint' ELSE '' END AS description FROM lineitem")
def record_parts(spark, d):
    p = casefacts.part(_records(spark, d), "l_orderkey", "record", "docket_entries")
    return p.select("l_orderkey", F.col("idx").cast("long").alias("idx"), "date_filed", "description")


@query("first_filing_date", """WITH l AS (SELECT l_orderkey, strftime(l_shipdate, '%Y-%m-%d') AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber = 3 THEN 0 ELSE 1 END, l_linenumber, strftime(l_shipdate, '%Y-%m-%d')) AS k FROM lineitem)
 SELECT l_orderkey, CASE WHEN l_orderkey % 4 = 0 THEN '2020-02-03' ELSE f END AS filed FROM l WHERE k = 1""")
def first_filing_date(spark, d):
    r = _records(spark, d)
    docket = casefacts.part(r, "l_orderkey", "record", "docket_entries")
    none = docket.select("l_orderkey", "idx", F.lit("").alias("filed"))
    direct = r.select("l_orderkey", F.when(F.col("l_orderkey") % 4 == 0, "2/3/2020").alias("own"))
    return casefacts.first_filing_date(direct, "l_orderkey", "own", docket, none)


@query("archived_bytes", "SELECT doc_id % 4 AS k, count(*) AS n, count(*) FILTER (WHERE doc_id % 3 = 0 OR doc_id % 5 = 0) AS archived FROM documents GROUP BY 1")
def archived_bytes(spark, d):
    i = F.col("doc_id")
    url, tag, asset = F.when(i % 3 == 0, "http://x").otherwise(" "), F.when(i % 5 < 2, "t"), F.when(i % 5 == 0, "a")
    return table(spark, d, "documents").groupBy((i % 4).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(casefacts.has_archived_bytes([url], tag, asset)).alias("archived"))


@query("pleading_filings", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_id % 4 IN (0, 3)) AS filings FROM events GROUP BY event_type")
def pleading_filings(spark, d):
    k = F.col("event_id") % 4
    t = F.when(k == 0, "Complaint for damages").when(k == 1, "Answer to complaint").when(k == 2, "Petition summons").otherwise("Complaint; FILED BY X, order to follow")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(casefacts.is_pleading(t, r"\b(?:complaint|petition)\b")).alias("filings"))


@query("facet_officers", f"WITH {OFFICERS} SELECT p_partkey, {OFFICER_KEY.format('raw')} AS norm FROM officers WHERE p_partkey % 5 < 4")
def facet_officers(spark, d):
    raw = F.when(F.col("p_partkey") % 5 == 4, "Judge Pro Tem").when(F.col("p_partkey") % 5 == 3, F.concat("raw", F.lit(", Pro Tem"))).otherwise(F.col("raw"))
    o = officers(spark, d).select("p_partkey", casefacts.facet_officer(raw).alias("label")).where("label is not null")
    from ..functions import text

    return o.select("p_partkey", text.officer_key(F.col("label")).alias("norm"))


@query("tentative_counts", """WITH p AS (SELECT *, p_name || ' ' || p_type || ' ' || p_size AS spelling FROM part), s AS (SELECT spelling, count(DISTINCT p_brand) AS k, min(p_brand) AS owner FROM p GROUP BY spelling), c AS (SELECT spelling, CAST(sum(p_size) AS BIGINT) AS n FROM p GROUP BY spelling)
 SELECT b.p_brand AS brand, CAST(coalesce(t.total, 0) AS BIGINT) AS total FROM (SELECT DISTINCT p_brand FROM part) b LEFT JOIN (SELECT owner, sum(n) AS total FROM s JOIN c USING (spelling) WHERE k = 1 GROUP BY owner) t ON owner = b.p_brand""")
def tentative_counts(spark, d):
    """Spellings of every part."""
    p = table(spark, d, "part").withColumn("spelling", F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string")))
    counts = p.groupBy("spelling").agg(F.sum("p_size").alias("n"))
    return casefacts.counts_by_alias(p.select(F.col("p_brand").alias("brand")).distinct(), "brand", p.select(F.col("p_brand").alias("owner"), "spelling"), counts)


@query("closure_validation", "SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 2 = 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0) AND o_orderkey % 7 > 0) AS valid FROM orders GROUP BY 1")
def closure_validation(spark, d):
    k = F.col("o_orderkey")
    ok = casefacts.valid_closure(
        F.when(k % 2 == 0, "Operative").otherwise("denied"), F.lit("operative"), F.when(k % 3 == 0, "case").otherwise("party"), F.lit("Terminal"), k % 7 > 0, F.lit("closes case"),
        F.when(k % 5 == 0, "name change decree").otherwise("judgment"), F.lit("observed_single_petition:name_change_decree"),
    )
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("valid"))


@query("satisfaction_labels", """SELECT label, count(*) AS n FROM (SELECT CASE WHEN k = 0 THEN 'Satisfaction of judgment on file' WHEN k = 1 THEN 'No current full satisfaction recorded' WHEN k = 2 THEN 'stayed' WHEN k = 3 THEN '50% satisfied ($10.00/$20.00)' WHEN k = 4 THEN 'partially satisfied ($10.00 recorded)' ELSE 'No current full satisfaction recorded' END AS label FROM (SELECT o_orderkey % 6 AS k FROM orders)) GROUP BY label""")
def satisfaction_labels(spark, d):
    k = F.col("o_orderkey") % 6
    x = casefacts.satisfaction(k == 0, F.when(k == 1, "Unsatisfied"), F.when(k == 2, "stayed"), F.when(k.isin(3, 4), 10.0), F.when(k == 3, 20.0), F.when(k == 3, 0.5))
    return table(spark, d, "orders").groupBy(x.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("notice_rules", "SELECT CASE o_orderkey % 5 WHEN 0 THEN 'CCP 1161.2.5' WHEN 1 THEN 'CCP 1161.2' WHEN 2 THEN 'CRC 2.503' WHEN 3 THEN 'none' ELSE 'other' END AS rule, count(*) AS n FROM orders GROUP BY 1")
def notice_rules(spark, d):
    k = F.col("o_orderkey") % 5
    t = F.when(k == 0, "per ccp 1161.2.5").when(k == 1, "per CCP 1161.2").when(k == 2, "rule 2.503(a)").when(k == 3, "Not available for viewing").otherwise("confidential")
    return table(spark, d, "orders").groupBy(casefacts.notice_rule(t).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


@query("open_statuses", "SELECT o_orderstatus AS s, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 3 < 2) AS open FROM orders GROUP BY 1")
def open_statuses(spark, d):
    k = F.col("o_orderkey") % 3
    x = casefacts.open_status(F.when(k == 0, " Case-Active ").otherwise("closed"), F.when(k == 1, "PENDING"))
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.count_if(x != "").alias("open"))


@query("route_relocation", "SELECT 'r' || p_partkey AS route, 'new' || (p_partkey % 8) AS path, CAST(p_partkey // 8 AS BIGINT) AS idx FROM part WHERE p_partkey % 10 < 9")
def route_relocation(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    t = lambda a, c: F.concat(F.lit(a), c.cast("string"))
    old = p.select(F.when(k % 10 < 9, k).otherwise(-1 - k).alias("record_id"), t("old", k % 3).alias("path"), F.floor(k / 3).alias("idx"))
    new = p.select(k.alias("record_id"), t("new", k % 8).alias("path"), F.floor(k / 8).alias("idx"))
    return casefacts.relocate(old, new, p.select(t("r", k).alias("route"), t("old", k % 3).alias("path"), F.floor(k / 3).alias("idx")))


@query("pleading_text", "SELECT d.doc_id, length(o.text) AS chars FROM documents d LEFT JOIN (SELECT CASE WHEN doc_id % 2 = 0 THEN sha256(text) ELSE 'none' || doc_id END AS h, any_value(text) AS text FROM documents GROUP BY 1) o ON o.h = sha256(d.text)")
def pleading_text(spark, d):
    docs = table(spark, d, "documents")
    held = docs.groupBy(F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256)).otherwise(F.concat(F.lit("none"), F.col("doc_id").cast("string"))).alias("h")).agg(F.max(F.length("text")).cast("long").alias("chars"))
    return docs.select("doc_id", F.sha2("text", 256).alias("h")).join(held, "h", "left").select("doc_id", "chars")


@query("profile_priority", "SELECT c.c_custkey, coalesce(a.s_name, b.s_name) AS s_name FROM customer c LEFT JOIN (SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE -1 - s_suppkey END AS s_suppkey, s_name FROM supplier) a ON a.s_suppkey = c.c_custkey LEFT JOIN (SELECT s_nationkey, max(s_name) AS s_name FROM supplier GROUP BY 1) b ON b.s_nationkey = c.c_nationkey")
def profile_priority(spark, d):
    s = table(spark, d, "supplier")
    a = s.select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).otherwise(-1 - F.col("s_suppkey")).alias("c_custkey"), "s_name")
    b = s.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max("s_name").alias("s_name"))
    return casefacts.by_priority(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey", (a, "c_custkey"), (b, "c_nationkey"), "s_name")


@query("count_mismatches", "SELECT c_custkey, n AS cnt, n AS t FROM (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) WHERE false UNION ALL SELECT o_custkey, count(*) + 1, count(*) FROM orders WHERE o_custkey % 9 = 0 GROUP BY o_custkey")
def count_mismatches(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    e = o.groupBy("c_custkey").agg((F.count(F.lit(1)) + F.when(F.col("c_custkey") % 9 == 0, 1).otherwise(0)).alias("cnt"))
    return casefacts.count_mismatches(e, "c_custkey", "cnt", o.groupBy("c_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n")))


@query("shard_references", "SELECT CASE doc_id % 3 WHEN 0 THEN 'a/0f' WHEN 1 THEN 'b/ff' ELSE '' END AS shard, count(*) AS n FROM documents GROUP BY 1")
def shard_references(spark, d):
    k = F.col("doc_id") % 3
    key = casefacts.shard_key(F.when(k == 0, "a/0f"), F.when(k == 0, "release-shard:a/0f").when(k == 1, " release-shard:b/ff").otherwise("http://x"))
    return table(spark, d, "documents").groupBy(key.alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("statistics_rollup", "SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS total, CAST(grouping(r_name, n_name) AS BIGINT) AS level FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)")
def statistics_rollup(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    by = c.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.grouping_id().alias("level"))
    return by.withColumn("level", F.col("level").cast("long"))


@query("discovery_text", "SELECT CASE WHEN n = 1 THEN '1 docket' ELSE n || ' dockets' END || ' + 3 discovered' AS label FROM (SELECT count(*) AS n FROM region)")
def discovery_text(spark, d):
    c = table(spark, d, "region").agg(F.count(F.lit(1)).alias("n"))
    return c.select(casefacts.discovery_text(F.col("n"), F.lit(3), F.lit(0), F.lit(0)).alias("label"))


@query("keyed_facet", "SELECT 'bar:' || s_suppkey % 40 AS facet_key, min(s_name) AS label, count(DISTINCT s_suppkey) AS case_count FROM supplier GROUP BY 1")
def keyed_facet(spark, d):
    key = F.concat(F.lit("bar:"), (F.col("s_suppkey") % 40).cast("string"))
    return facets.facet(table(spark, d, "supplier"), "s_name", "s_suppkey", key=key)


@query("lookup_build", """WITH h AS (SELECT c_custkey, c_name, CAST(list_reduce([CAST(ord(c) AS HUGEINT) for c in string_split('people:' || c_name, '')], lambda a, b: (xor(a, b) * 16777619) % 4294967296, CAST(2166136261 AS HUGEINT)) AS BIGINT) % 64 AS b FROM customer),
 p AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY c_custkey) - 1 AS record_index FROM h), r AS (SELECT lower(c_name) AS route, b, record_index, c_custkey FROM p UNION ALL SELECT 'k' || (c_custkey % 700), b, record_index, c_custkey FROM p),
 f AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY c_custkey) AS k, count(*) OVER (PARTITION BY route) - 1 AS duplicates FROM r) SELECT route, lower(lpad(to_hex(b), 2, '0')) AS record_bucket, record_index, duplicates FROM f WHERE k = 1""")
def lookup_build(spark, d):
    from ..operators import routes

    c = table(spark, d, "customer").select("c_custkey", "c_name", F.concat(F.lit("K"), (F.col("c_custkey") % 700).cast("string")).alias("other"))
    places = routes.record_places(c, "people", "c_name", "c_custkey", 64)
    return routes.routes(places, "people", ["c_name", "other"], "c_custkey").select("route", "record_bucket", "record_index", "duplicates")


@query("entity_bands_not_captured", "SELECT band, count(*) AS entity_count FROM (SELECT CASE WHEN n IS NULL THEN 'not captured' WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n < 5 THEN '2-4' WHEN n < 10 THEN '5-9' WHEN n < 25 THEN '10-24' ELSE '25-49' END AS band FROM (SELECT CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size % 50 END AS n FROM part)) GROUP BY band")
def entity_bands_not_captured(spark, d):
    from ..operators import bands

    p = table(spark, d, "part").select(F.when(F.col("p_partkey") % 7 > 0, F.col("p_size") % 50).cast("long").alias("n"))
    return bands.bands_with_unknown(p, "n").where("entity_count > 0").select("band", "entity_count")


@query("year_window_rank", "WITH m AS (SELECT o_custkey, count(*) AS matters FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY 1) SELECT o_custkey, matters, row_number() OVER (ORDER BY matters DESC, o_custkey) AS rank FROM m")
def year_window_rank(spark, d):
    from ..operators import bands

    h = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return bands.rank_in_window(h, "o_custkey", "y", 1996, 1998)


@query("histogram_merge", "SELECT user_id % 20 AS id, CAST(date_part('day', ts) AS BIGINT) AS day, CAST(sum(CASE WHEN event_type = 'view' THEN NULL ELSE 1 END) AS BIGINT) AS n FROM events GROUP BY ALL")
def histogram_merge(spark, d):
    from ..operators import bands

    e = table(spark, d, "events").groupBy("user_id", "event_type", F.dayofmonth("ts").cast("long").alias("day")).agg(F.count(F.lit(1)).alias("c"))
    e = e.select((F.col("user_id") % 20).alias("id"), "day", F.when(F.col("event_type") != "view", F.col("c")).alias("n"))
    return bands.merge_histograms(e, ["id", "day"])


@query("disposition_labels", "SELECT CASE o_orderkey % 5 WHEN 0 THEN 'Dismissed' WHEN 1 THEN 'Default judgment' WHEN 2 THEN 'Reviewed' WHEN 3 THEN 'Name change disposition' ELSE 'Disposition recorded' END AS label, count(*) AS n FROM orders GROUP BY 1")
def disposition_labels(spark, d):
    k = F.col("o_orderkey") % 5
    kind = F.when(k == 1, "Default Judgment").when(k == 2, "possession").otherwise("")
    x = casefacts.disposition_label(kind, F.when(k == 3, "name-change"), F.when(k == 0, F.array(F.lit("dismissed"))), {"possession": "Reviewed"})
    return table(spark, d, "orders").groupBy(x.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("representation_filter", "SELECT c_mktsegment AS segment, count(*) FILTER (WHERE c_custkey % 4 > 0) AS visible, count(*) FILTER (WHERE c_custkey % 3 > 0) AS represented, count(*) FILTER (WHERE c_custkey % 5 = 0) AS fictitious FROM customer GROUP BY 1")
def representation_filter(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, "DOES 1 through 20").otherwise(F.col("c_name"))
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count_if(casefacts.visible_entities(F.lit("firm"), k % 4)).alias("visible"), F.count_if(casefacts.representation("represented", k % 3, F.lit(1))).alias("represented"), F.count_if(casefacts.is_fictitious(name)).alias("fictitious")
    )


@query("review_reasons", "SELECT p_partkey, CASE WHEN p_brand = p_type THEN p_brand WHEN p_brand < p_type THEN p_brand || '|' || p_type ELSE p_type || '|' || p_brand END AS reasons FROM part")
def review_reasons(spark, d):
    r = casefacts.review_reasons(F.array("p_brand", F.lit(" ")), F.array("p_type", "p_brand"), F.lit(None).cast("array<string>"))
    return table(spark, d, "part").select("p_partkey", F.array_join(r, "|").alias("reasons"))


@query("pleading_causes", """WITH t AS (SELECT DISTINCT sha256(text) AS s FROM documents WHERE doc_id % 3 > 0), c AS (SELECT doc_id % 200 AS k, doc_id, sha256(text) IN (SELECT s FROM t) AS ok FROM documents)
 SELECT k, CASE WHEN bool_or(ok) THEN min(doc_id) FILTER (WHERE ok) ELSE min(doc_id) END AS doc_id, CASE WHEN bool_or(ok) THEN 'pleading' ELSE 'text_unavailable' END AS source, CASE WHEN bool_or(ok) THEN 2 ELSE 0 END AS n FROM c GROUP BY k""")
def pleading_causes(spark, d):
    docs = table(spark, d, "documents").select((F.col("doc_id") % 200).alias("k"), "doc_id", F.sha2("text", 256).alias("sha256"), F.floor(F.col("doc_id") / 200).alias("rank"))
    sha = F.when(F.col("doc_id") % 3 > 0, F.sha2("text", 256)).otherwise(F.concat(F.lit("none"), F.col("doc_id").cast("string")))
    texts = table(spark, d, "documents").select(sha.alias("sha256"), F.concat(F.lit("COMPLAINT FOR\n1. FRAUD\n2. NEGLIGENCE\nJURY TRIAL\n"), pleaded()).alias("text")).dropDuplicates(["sha256"])
    return casefacts.choose_pleading(docs, "k", texts).select("k", "doc_id", "source", F.size("causes").alias("n"))
