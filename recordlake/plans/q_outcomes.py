"""Queries of outcomes in words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import outcomes
from .bindings import query, table
from .q_portal import _of, _orders, _values

KINDS = [
    "family_support_order", "family_support_order", "family_custody_order", "family_support_modification", "family_custody_modification", "appeal_mixed", "dismissal", "dismissal",
    "writ_granted", "", "unheard_of", "", "appeal_modified", "",
]
DOMAINS = ["child_support", "", "", "spousal_support", "", "", "", "", "", "name_change", "", "", "", ""]
RESULTS = [
    "Child support and custody order entered", "Child and spousal support order entered", "Child support and custody order entered", "Spousal support order modified",
    "Child custody modified; family support order also on file", "Appeal resolved: affirmed in part, reversed in part, and remanded", "Case dismissed", "Dismissal entered",
    "Writ granted", "Name change decree entered", "unheard of recorded", "Possession judgment entered", "Judgment or order modified on appeal", "Disposition recorded",
]


@query("result_labels", f"SELECT o_orderkey AS k, t AS label FROM orders JOIN (VALUES {_values(RESULTS)}) v(i, t) ON i = o_orderkey % 14")
def result_labels(spark, d):
    i = F.col("k") % 14
    some = lambda *v: F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")
    domains = F.when(i == 0, some("child_custody")).when(i == 1, some("spousal_support", "child_support")).when(i == 2, some("child_support")).when(i == 4, some("family_support")).when(i == 11, some("new", "possession")).otherwise(some())
    parts = F.when(i == 5, some("affirmed_in_part", "reversed_in_part", "remanded", " ")).otherwise(some())
    return _orders(spark, d).select("k", outcomes.result_label(_of(KINDS), _of(DOMAINS), domains, parts, i == 6).alias("label"))


OBSERVED = ["Reversed + remanded", "Take-nothing judgment", "some new kind", "Event"]


@query("observed_labels", f"SELECT o_orderkey AS k, t AS label, CASE o_orderkey % 4 WHEN 0 THEN 'Child custody' WHEN 1 THEN 'a b c' ELSE '' END AS domain FROM orders JOIN (VALUES {_values(OBSERVED)}) v(i, t) ON i = o_orderkey % 4")
def observed_labels(spark, d):
    i = F.col("k") % 4
    parts = F.when(i == 0, F.array(F.lit("reversed"), F.lit("remanded")))
    label = outcomes.observed_label(_of(["appeal_mixed", "take_nothing", "some_new/kind", ""]), parts)
    return _orders(spark, d).select("k", label.alias("label"), outcomes.domain_label(_of(["child_custody", "a_b/c", "", ""])).alias("domain"))


@query("first_amounts", "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'r' WHEN 1 THEN 'n' WHEN 2 THEN 'o' END AS amount FROM orders")
def first_amounts(spark, d):
    i = F.col("k") % 4
    a = outcomes.amount(F.when(i == 0, "r").otherwise(" "), F.when(i < 2, "n"), F.lit(None).cast("string"), F.when(i < 3, "o"))
    return _orders(spark, d).select("k", a.alias("amount"))


@query("satisfaction_postures", """SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'From the status.' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN 'Stayed.' ELSE 'No current full satisfaction recorded.' END AS posture,
 CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN 'Satisfaction of judgment on file.' WHEN o_orderkey % 2 = 0 THEN '' ELSE 'No current full satisfaction recorded.' END AS fallback FROM orders""")
def satisfaction_postures(spark, d):
    k = F.col("k")
    i = k % 5
    p = outcomes.posture(i == 0, F.lit("From the status."), F.when(i == 1, "take_nothing").otherwise("judgment"), F.when(i == 4, "unsatisfied"), F.when(i == 3, "stayed.."), F.when(i == 3, "stayed..").otherwise("No current full satisfaction recorded"))
    f = outcomes.fallback_satisfaction(F.lit(True), k % 7 == 0, F.when(k % 2 == 0, "writ").otherwise("Default Judgment"), k % 3 == 0, F.lit(False))
    return _orders(spark, d).select("k", p.alias("posture"), f.alias("fallback"))


@query("fallback_texts", """SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'Final amount: not stated.' WHEN 1 THEN 'Final amount: no money judgment amount detected in the extracted case-status signal.' WHEN 2 THEN 'Final amount: not stated in the extracted satisfaction signal.' ELSE 'Final amount: not stated in extracted ROA/document metadata.' END AS amount,
 CASE o_orderkey % 3 WHEN 0 THEN 'own words' WHEN 1 THEN 'second' ELSE '' END AS source FROM orders""")
def fallback_texts(spark, d):
    k = F.col("k")
    a = outcomes.fallback_amount(k % 4 > 0, F.lit(False), k % 4 == 1, k % 4 == 3, k % 4 == 2)
    s = outcomes.fallback_source(F.when(k % 3 == 0, "own \n words"), F.lit(" "), F.when(k % 3 == 1, "second"))
    return _orders(spark, d).select("k", a.alias("amount"), s.alias("source"))


@query("data_errors", """SELECT o_orderkey AS k, 'data_state_error' AS case_status, CASE o_orderkey % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'Judgment data error: the evidence manifest is missing or invalid.' ELSE 'Judgment data error: evidence could not be validated.' END AS status_detail,
 CASE o_orderkey % 3 WHEN 2 THEN 'judgment_data_error' ELSE 'manifest_invalid' END AS error_code, false AS satisfied FROM orders""")
def data_errors(spark, d):
    i = F.col("k") % 3
    e = outcomes.data_error(F.when(i < 2, "manifest_invalid"), F.when(i == 0, "own"))
    return _orders(spark, d).select("k", e.alias("e")).select("k", "e.case_status", "e.status_detail", "e.error_code", "e.satisfied")


@query("money_formats", """SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN '$1,234,567.5' WHEN 1 THEN '-$100' WHEN 2 THEN 'about 5' ELSE 'not stated' END AS money, CASE o_orderkey % 3 WHEN 0 THEN '100%' WHEN 1 THEN '87.5%' ELSE 'not stated' END AS confidence,
 CASE o_orderkey % 2 WHEN 0 THEN '2.00 KB' ELSE '3.50 MB' END AS bytes, CASE o_orderkey % 2 WHEN 0 THEN '50%' ELSE '33%' END AS pct FROM orders""")
def money_formats(spark, d):
    k = F.col("k")
    return _orders(spark, d).select(
        "k", text.amount_text(_of(["1,234567.5", "-100", "about 5", None])).alias("money"), text.confidence_text(F.when(k % 3 == 0, 1.0).when(k % 3 == 1, 0.875)).alias("confidence"),
        text.bytes_text(F.when(k % 2 == 0, 2048.0).otherwise(3.5 * 1048576)).alias("bytes"), text.percent_text(F.when(k % 2 == 0, 0.5).otherwise(0.333)).alias("pct"),
    )


@query("operative_summaries", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'summary' WHEN o_orderkey % 3 = 1 THEN 'operative' END AS kind FROM orders")
def operative_summaries(spark, d):
    i = F.col("k") % 3
    record = F.to_json(F.struct(F.when(i == 0, F.struct(F.lit("summary").alias("kind"))).alias("summary"), F.when(i < 2, F.struct(F.lit("operative").alias("kind"))).alias("operative_summary")))
    v = F.try_parse_json(record)
    pick = outcomes.summary_of(F.try_variant_get(v, "$.summary", "variant"), F.try_variant_get(v, "$.operative_summary", "variant"))
    return _orders(spark, d).select("k", F.try_variant_get(pick, "$.kind", "string").alias("kind"))


@query("outcome_descriptions", """WITH e AS (SELECT l_orderkey AS k, l_linenumber * 100000000000 + l_partkey * 100000 + l_suppkey AS pos, 'h' || l_linenumber AS h, l_returnflag = 'R' AS op, CASE WHEN l_linenumber % 2 = 0 THEN 'default_judgment' ELSE 'dismissal' END AS kind, strftime(l_shipdate, '%Y-%m-%d') AS day, l_linestatus AS r FROM lineitem),
 s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'h2' END AS cur, CASE WHEN o_orderkey % 4 = 0 THEN 'h1' END AS fin, CASE WHEN o_orderkey % 5 = 0 THEN 1500.5 END AS amount FROM orders),
 c AS (SELECT s.k, arg_min(e.kind, CASE WHEN e.h = s.cur THEN 0 WHEN e.op THEN 100 ELSE 200 END * 100000000000 + e.pos) AS ckind, arg_min(e.day, CASE WHEN e.h = s.cur THEN 0 WHEN e.op THEN 100 ELSE 200 END * 100000000000 + e.pos) AS cday, bool_or(e.op) AS op, count(*) AS n,
  arg_min(e.kind, e.pos) FILTER (WHERE e.h = s.fin) AS fkind, arg_min(e.day, e.pos) FILTER (WHERE e.h = s.fin) AS fday, bool_or(e.r = 'F') AS review FROM s JOIN e ON e.k = s.k GROUP BY s.k),
 j AS (SELECT s.*, coalesce(c.n, 0) AS n, c.ckind, c.cday, coalesce(c.fkind, c.ckind) AS fk, coalesce(c.fday, c.cday) AS fd, coalesce(c.review, false) AS review, s.cur IS NOT NULL OR s.amount IS NOT NULL OR coalesce(c.op, false) AS judged FROM s LEFT JOIN c ON c.k = s.k),
 w AS (SELECT *, CASE fk WHEN 'dismissal' THEN 'Dismissal' ELSE 'Default judgment' END AS fl, CASE ckind WHEN 'dismissal' THEN 'Dismissal' ELSE 'Default judgment' END AS cl FROM j)
 SELECT k, CASE WHEN n = 0 AND cur IS NULL AND fin IS NULL AND amount IS NULL THEN 'No extracted judgment/end-state events are recorded for this case.' WHEN n = 0 THEN 'Final disposition: Judgment.' WHEN NOT judged THEN 'no operative judgment was extracted; reference and rejected judgment source rows are retained for review.'
  ELSE 'Final disposition: ' || fl || ' on ' || fd || '.' || CASE WHEN fl <> cl THEN ' Operative judgment: ' || cl || CASE WHEN cday <> fd THEN ' on ' || cday ELSE '' END || '.' ELSE '' END END AS nature,
  CASE WHEN n = 0 AND cur IS NULL AND fin IS NULL AND amount IS NULL THEN 'Final amount: not stated.' WHEN amount IS NOT NULL THEN 'Final amount: $1,500.5 recorded in the judgment/renewal source.' ELSE 'Final amount: not stated in extracted judgment rows.' END AS amount_description,
  CASE WHEN n = 0 AND cur IS NULL AND fin IS NULL AND amount IS NULL THEN 'No judgment source rows were found in the generated judgment shard.' ELSE n || ' judgment/end-state source event' || CASE WHEN n = 1 THEN '' ELSE 's' END || '; 1 disposition track; 0 final events.' END AS source_description,
  CASE WHEN review THEN 'review required: late filing' ELSE 'no review flags' END AS review FROM w""")
def outcome_descriptions(spark, d):
    li = table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    none = F.lit(None).cast("array<string>")
    e = li.select(
        F.col("l_orderkey").alias("k"), (n * F.lit(100000000000) + F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("pos"), F.concat(F.lit("h"), n.cast("string")).alias("hash"), F.when(F.col("l_returnflag") == "R", "operative").otherwise("denied").alias("status"),
        F.when(n % 2 == 0, "default_judgment").otherwise("dismissal").alias("event_kind"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("entry_date"), none.alias("outcome_components"),
        F.when(F.col("l_linestatus") == "F", F.array(F.lit("late_filing"))).otherwise(F.array().cast("array<string>")).alias("review_reasons"),
    )
    k, text_ = F.col("k"), F.lit(None).cast("string")
    s = _orders(spark, d).select(
        "k", F.when(k % 3 == 0, "h2").alias("current_hash"), text_.alias("selected_hash"), F.when(k % 4 == 0, "h1").alias("final_hash"), text_.alias("actual_kind"), text_.alias("final_kind"), text_.alias("final_date"),
        none.alias("final_components"), none.alias("domains"), F.when(k % 5 == 0, 1500.5).alias("amount"), F.lit(0).alias("final_count"), F.lit(1).alias("group_count"), none.alias("conflict_reasons"),
        F.lit(False).alias("satisfied"), text_.alias("satisfaction_state"), text_.alias("satisfaction_label"), ((k % 3 > 0) & (k % 4 > 0) & (k % 5 > 0)).alias("bare"),
    )
    return outcomes.described(s, e, "k").select("k", "nature", "amount_description", "source_description", "review")
