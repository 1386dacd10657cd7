"""Queries of small functions that other queries use inside."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import bands, captions, casefacts, identity, rankings, records, taxonomy
from .bindings import CASES, cases, query, table
from .q_portal import _of, _orders, _values


@query("officer_aliases", "SELECT p_partkey, CASE WHEN p_size = 7 THEN 'ann lake' ELSE 'zed s' || p_size END AS norm FROM part")
def officer_aliases(spark, d):
    raw = F.concat(F.lit("Hon. Zed S"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", text.officer_identity(raw, {"zed s7": "ann lake"}).alias("norm"))


LISTS = ["LAKE, ANN, JR.; PRO PER; fox, bob; LAKE, ANN, JR.", "Unknown Judge", "fox, bob<br/>\nIn Pro Per", "Settlement Attorney 4; OAK, EVE, III, ELM, JO"]
NAMES = ["LAKE, ANN, JR.|FOX, BOB", "", "FOX, BOB", "OAK, EVE, III|ELM, JO"]


@query("attorney_lists", f"SELECT o_orderkey AS k, t AS names FROM orders JOIN (VALUES {_values(NAMES)}) v(i, t) ON i = o_orderkey % 4")
def attorney_lists(spark, d):
    rows = _orders(spark, d).withColumn("raw", _of(LISTS))
    return rows.select("k", F.array_join(captions.clean_attorneys(F.col("raw")), "|").alias("names"))


@query("redacted_urls", "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'http://a/?x=1' WHEN 1 THEN 'http://a/' WHEN 2 THEN 'http://a/?x=1&y=2#z' ELSE 'http://a/?x=' || o_orderkey END AS url FROM orders")
def redacted_urls(spark, d):
    k = F.col("k")
    url = F.when(k % 4 == 0, "http://a/?x=1&SessionID=9").when(k % 4 == 1, "http://a/?sessionid=9").when(k % 4 == 2, "http://a/?x=1&SESSIONID=9&y=2#z").otherwise(F.concat(F.lit("http://a/?x="), k.cast("string")))
    return _orders(spark, d).select("k", text.without_parameter(url, "sessionid").alias("url"))


@query("status_dates", f"WITH {CASES} SELECT o_orderkey, filed AS found, filed AS shown, filed AS day, '9:30 AM' AS hour FROM cases")
def status_dates(spark, d):
    t = F.to_date("filed")
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.col("filed")).when(k == 1, F.date_format(t, "M/d/yyyy")).otherwise(F.date_format(t, "MMM d, yyyy"))
    stamp = F.concat(F.date_format(t, "M/d/yyyy"), F.lit(" 9:30 AM"))
    c = cases(spark, d).select("o_orderkey", dates.status_date(F.concat(F.lit("on "), raw)).alias("found"), dates.short_date(t, F.col("filed")).alias("shown"), dates.date_and_time(stamp).alias("s"))
    return c.select("o_orderkey", "found", "shown", F.col("s.date").alias("day"), F.col("s.time").alias("hour"))


@query("cleaned_texts", "SELECT c_custkey, c_name || ' ' || c_mktsegment AS cleaned, c_name AS first FROM customer")
def cleaned_texts(spark, d):
    raw = F.concat(F.lit("  "), "c_name", F.lit(" \t\n"), "c_mktsegment", F.lit("\r"))
    return table(spark, d, "customer").select("c_custkey", text.clean(raw).alias("cleaned"), text.first_text(F.lit(" "), F.lit(None).cast("string"), F.concat(F.lit(" "), "c_name")).alias("first"))


@query("person_labels", "SELECT c_custkey, c_name AS label, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS private_firm, 'Ann Lake' AS party FROM customer")
def person_labels(spark, d):
    firm = F.when(F.col("c_custkey") % 3 == 0, "Lake & Fox").when(F.col("c_custkey") % 3 == 1, "Lake Law Group").otherwise("Ann Lake")
    return table(spark, d, "customer").select(
        "c_custkey", text.person_label(F.concat(F.lit("The Hon. Judge  "), "c_name", F.lit(" ,"))).alias("label"), text.private_firm_signal(firm).alias("private_firm"),
        text.strip_party_roles(F.lit("Ann Lake (PLAINTIFF AND APPELLANT), ")).alias("party"),
    )


@query("json_record_counts", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n FROM customer")
def json_record_counts(spark, d):
    raw = F.when(F.col("c_custkey") % 3 == 0, '["a-1"," A-1 ","b",""]').when(F.col("c_custkey") % 3 == 1, '["x"]').otherwise("{}")
    return table(spark, d, "customer").select("c_custkey", bands.json_record_count(raw).alias("n"))


@query("provenance_counts", """WITH x AS (SELECT l_orderkey AS k, l_linenumber % 4 = 0 AS gone, l_linenumber % 2 = 0 AND l_linenumber % 4 <> 0 AS held, l_linenumber % 3 = 0 AS deferred, CASE WHEN l_linenumber < 3 THEN 't' || l_linenumber ELSE ' ' END AS tag FROM lineitem),
 b AS (SELECT k, count(*) AS total, count(*) FILTER (WHERE held) AS held, count(*) FILTER (WHERE gone) AS gone, count(*) FILTER (WHERE NOT gone AND NOT held AND deferred) AS deferred, count(*) FILTER (WHERE NOT gone) AS open, string_agg(DISTINCT tag, ',' ORDER BY tag) FILTER (WHERE tag <> ' ') AS tags FROM x GROUP BY k),
 c AS (SELECT o_orderkey AS k, coalesce(total, 0) AS documents_total, coalesce(held, 0) AS documents_with_bytes, coalesce(gone, 0) AS documents_unavailable, coalesce(deferred, 0) AS documents_deferred, coalesce(open, 0) AS open, greatest(0, coalesce(open, 0) - coalesce(deferred, 0) - coalesce(held, 0)) AS documents_bytes_missing, coalesce(tags, '') AS tags FROM orders LEFT JOIN b ON k = o_orderkey)
 SELECT k, documents_total, documents_with_bytes, documents_unavailable, documents_deferred, documents_bytes_missing, tags, CASE WHEN k % 9 = 0 THEN '2021' ELSE '2020' END AS last_changed, CASE WHEN k % 9 = 0 THEN 'updated' WHEN k % 5 = 0 AND documents_total = 0 THEN 'unavailable' WHEN documents_deferred > 0 OR (open > 0 AND documents_bytes_missing > 0) THEN 'partial' ELSE 'complete' END AS mode FROM c""")
def provenance_counts(spark, d):
    n, k = F.col("l_linenumber"), F.col("k")
    docs = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), (n % 4 != 0).alias("available"), ((n % 2 == 0) & (n % 4 != 0)).alias("held"), (n % 3 == 0).alias("deferred"),
        F.when(n < 3, F.concat(F.lit("t"), n.cast("string"))).otherwise(" ").alias("tag"),
    )
    zero, no = F.lit(0), F.lit(False)
    c = _orders(spark, d).select(
        "k", (k % 5 == 0).alias("unavailable"), zero.alias("docket"), no.alias("no_documents"), zero.alias("pending"), no.alias("captured"), zero.alias("failures"),
        F.when(k % 9 == 0, "2021").alias("updated_at"), F.lit("2020").alias("captured_at"),
    )
    return records.provenance(docs, "k", c).withColumn("tags", F.array_join("release_tags", ",")).drop("release_tags")


@query("document_order", "SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END NULLS LAST, CAST(doc_id % 50 AS VARCHAR), doc_id) AS place FROM documents")
def document_order(spark, d):
    i = F.col("doc_id")
    filed = F.when(i % 4 > 0, F.col("lang")).otherwise(" ")
    return rankings.ordinals(table(spark, d, "documents").select("doc_id", filed.alias("filed")), records.date_order(F.col("filed"), i % 50, i), "place").select("doc_id", "place")


@query("facet_order", "SELECT p_brand AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS place FROM part GROUP BY p_brand")
def facet_order(spark, d):
    f = table(spark, d, "part").groupBy(F.col("p_brand").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return rankings.ordinals(f, [F.col("n").desc(), F.col("label")], "place")


@query("current_finals", "SELECT o_orderkey AS k, o_orderkey % 5 = 0 OR (o_orderkey % 3 = 0 AND o_orderkey % 4 > 0 AND o_orderkey % 7 > 0) AS final FROM orders")
def current_finals(spark, d):
    k = F.col("k")
    x = casefacts.current_final(k % 5 == 0, k % 3 == 0, F.when(k % 4 == 0, "Set Aside").otherwise("operative"), F.when(k % 7 == 0, "vacatur").otherwise("judgment"))
    return _orders(spark, d).select("k", x.alias("final"))


@query("allowed_urls", "SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'https://ok.example/a' WHEN 1 THEN 'https://ok.example/b' END AS url FROM orders")
def allowed_urls(spark, d):
    k = F.col("k") % 3
    urls = [F.when(k == 0, " https://ok.example/a ").otherwise("http://evil.example/a"), F.when(k == 1, "https://ok.example/b")]
    return _orders(spark, d).select("k", casefacts.first_allowed(urls, r"^https://ok\.example/").alias("url"))


@query("profile_labels", "SELECT s_suppkey, 's' || s_suppkey AS norm, 'S' || s_suppkey AS label FROM supplier UNION ALL SELECT s_suppkey, 'other', 'Other' FROM supplier")
def profile_labels(spark, d):
    k = F.col("s_suppkey").cast("string")
    labels = F.array(F.concat(F.lit("S"), k), F.concat(F.lit("Judge s"), k), F.lit("Other"), F.lit(" "), F.lit("OTHER"))
    p = table(spark, d, "supplier").select("s_suppkey", labels.alias("labels"))
    return identity.profile_labels(p, "s_suppkey", "labels", text.officer_key)


@query("exploded_cases", "SELECT o_orderstatus AS s, 'C' || o_orderkey AS case_number FROM orders")
def exploded_cases(spark, d):
    packed = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("s"), (F.col("o_orderkey") % 100).alias("g")).agg(F.concat(F.array_join(F.collect_list(F.concat(F.lit("C"), F.col("o_orderkey").cast("string"))), ","), F.lit(",")).alias("cases"))
    return taxonomy.exploded_cases(packed, "s", "cases")


@query("tag_values", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'solid' WHEN 1 THEN 'tentative' ELSE 'invalid' END AS roster, event_id % 4 IN (0, 1) AND event_id % 3 = 0 AS valid FROM events")
def tag_values(spark, d):
    i = F.col("event_id")
    source = F.when(i % 4 == 0, "judicial_council").when(i % 4 == 1, "docket").when(i % 4 == 2, "tentative").otherwise("ocr")
    t = table(spark, d, "events").select(i, F.lit("vexatious").alias("namespace"), source.alias("source"), F.when(i % 3 == 0, "yes").otherwise("maybe").alias("value"))
    ok = records.valid_tags(t, {"vexatious": ("judicial_council", "docket")}, {"vexatious": ("yes", "no")})
    return t.select("event_id", casefacts.roster_rule(F.col("source")).alias("roster"), ok.alias("valid"))


@query("statute_texts", "SELECT o_orderkey AS k, 'PC ' || o_orderkey AS code FROM orders")
def statute_texts(spark, d):
    k = F.col("k")
    head = F.when(k % 3 == 0, "Pen Code § ").when(k % 3 == 1, "penal code section ").otherwise("pc  ")
    return _orders(spark, d).select("k", records.statute_code(F.concat(head, k.cast("string"))).alias("code"))


@query("facet_blocks", """WITH r AS (SELECT o_orderstatus AS s, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS p, 'C' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS c FROM orders), n AS (SELECT *, (row_number() OVER (PARTITION BY s, p ORDER BY c) - 1) // 200 AS block FROM r)
 SELECT s, p, CAST(block AS BIGINT) AS block, count(*) AS case_count, string_agg(c, ',' ORDER BY c) AS cases FROM n GROUP BY s, p, block""")
def facet_blocks(spark, d):
    from ..operators import facets

    p = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("s"), p.alias("p"), F.concat(F.lit("C"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("c"))
    return facets.pack_blocks(rows, ["s", "p"], "c", 200)
