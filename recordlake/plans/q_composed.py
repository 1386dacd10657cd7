"""Queries of records put together, and of the hard cases: ties, repeated keys, null groups, unknown namespaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.fixed import EVENT_RESULTS
from ..operators import bands, caseparts, charges, outcomes, routes, search, udtfs
from .bindings import CASES, cases, query, table
from .q_portal import _case_records, _json

CHARGED = """ch AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS filed, CASE WHEN o_orderkey % 2 = 0 THEN 'PC' ELSE 'FGC' END AS s,
  CAST(100 + o_orderkey % 60 AS VARCHAR) || CASE WHEN o_orderkey % 4 = 0 THEN '(a)' ELSE '' END AS sec FROM orders),
 one AS (SELECT k, filed, 0 AS pos, CASE k % 3 WHEN 0 THEN s || ' ' || sec || ' / F' WHEN 1 THEN 'BURGLARY ' || s || ' ' || sec || ' M' ELSE s || ' ' || sec || '/I' END AS raw, CASE WHEN k % 3 = 1 THEN 'BURGLARY' END AS own, s, sec,
   CASE k % 3 WHEN 0 THEN 'felony' WHEN 1 THEN 'misdemeanor' ELSE 'infraction' END AS classification FROM ch
  UNION ALL SELECT k, filed, 1, 'PC 2' || sec, NULL, 'PC', '2' || sec, NULL FROM ch WHERE k % 3 = 2
  UNION ALL SELECT k, filed, 2, 'loud noises', NULL, NULL, NULL, NULL FROM ch WHERE k % 3 = 2),
 c AS (SELECT *, CASE s WHEN 'FGC' THEN 'FG' ELSE s END AS sys, CASE s WHEN 'FGC' THEN 'Fish and Game Code' ELSE 'Penal Code' END AS law FROM one),
 sch AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'PC ' ELSE 'FG ' END || (100 + p_partkey % 50) || CASE WHEN p_partkey % 16 = 0 THEN '(a)' ELSE '' END AS code, p_name || CASE WHEN p_partkey % 3 = 0 THEN ': SECOND DEGREE' ELSE '' END AS title, (1994 + p_partkey % 8) || '-01-01' AS effective_from,
   CASE WHEN p_partkey % 2 = 0 THEN (1994 + p_partkey % 8) || '-12-31' END AS effective_to, CASE p_partkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS priority, 'src' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS source, p_brand AS source_label, CASE WHEN p_partkey % 5 = 1 THEN 'state_table' END AS title_source FROM part),
 keyed AS (SELECT *, CASE WHEN sys || ' ' || sec IN (SELECT code FROM sch) THEN sys || ' ' || sec ELSE sys || ' ' || split_part(sec, '(', 1) END AS code FROM c),
 j AS (SELECT k, pos, sch.*, CASE WHEN filed = '' THEN 6 WHEN effective_from <= filed AND (effective_to IS NULL OR filed <= effective_to) THEN CASE WHEN priority = 3 THEN 0 ELSE 1 END WHEN effective_from <= filed THEN CASE WHEN priority = 3 THEN 2 ELSE 3 END ELSE CASE WHEN priority = 3 THEN 4 ELSE 5 END END AS tier,
   (CASE WHEN title LIKE '%:%' THEN 0 ELSE 2 END) + (CASE WHEN title LIKE '%DEGREE%' THEN 0 ELSE 1 END) AS gen, CAST(replace(effective_from, '-', '') AS BIGINT) AS dt FROM keyed JOIN sch USING (code)),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, pos ORDER BY tier, priority DESC, gen DESC, CASE WHEN tier IN (4, 5) THEN dt ELSE -dt END, length(title), source) AS rk FROM j) WHERE rk = 1),
 ver AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'PC ' ELSE 'FG ' END || (100 + p_partkey % 60) AS code, p_partkey AS pos, (1993 + p_partkey % 7) || '-06-01' AS f, CASE WHEN p_partkey % 3 > 0 THEN (1994 + p_partkey % 7) || '-05-31' END AS t, 'u' || p_partkey AS url FROM part),
 cur AS (SELECT code, 'c' || code AS url, CASE WHEN min(pos) % 4 > 0 THEN '1999-01-01' END AS began FROM ver GROUP BY code),
 h AS (SELECT k, c.pos, arg_min(ver.url, ver.pos) AS url FROM c JOIN ver ON ver.code = sys || ' ' || split_part(sec, '(', 1) WHERE filed <> '' AND f <= filed AND coalesce(t, '9999') >= filed GROUP BY k, c.pos)"""


@query("charge_full", f"""WITH {CHARGED} SELECT c.k, c.pos, c.raw, coalesce(c.own, b.title, c.law || ' § ' || c.sec, c.raw) AS title,
 CASE WHEN c.own IS NOT NULL THEN 'criminal_index_text' WHEN b.title IS NOT NULL THEN coalesce(b.title_source, 'court_bail_schedule') WHEN c.sys IS NOT NULL THEN 'programmatic_citation' ELSE 'raw_index_text' END AS title_source, CASE WHEN c.own IS NOT NULL AND lower(b.title) <> lower(c.own) THEN b.title END AS schedule_title,
 list_extract(['effective_at_filing', 'effective_at_filing_supplemental_source', 'latest_available_before_filing', 'latest_available_before_filing_supplemental_source', 'earliest_available_after_filing', 'earliest_available_after_filing_supplemental_source', 'latest_available_no_filing_date'], b.tier + 1) AS title_version_status,
 b.source AS title_schedule_source, b.source_label AS title_schedule_source_label, b.effective_from AS title_schedule_effective_from, b.effective_to AS title_schedule_effective_to, c.sys || ' ' || c.sec AS code, c.classification,
 CASE WHEN c.sys IS NULL THEN NULL WHEN h.url IS NOT NULL THEN h.url WHEN cur.url IS NOT NULL THEN CASE WHEN c.filed <> '' AND c.filed < began THEN NULL ELSE cur.url END
  ELSE 'https://leginfo.legislature.ca.gov/faces/codes_displaySection.xhtml?sectionNum=' || split_part(c.sec, '(', 1) || '.&lawCode=' || CASE c.sys WHEN 'FG' THEN 'FGC' ELSE 'PEN' END END AS url,
 CASE WHEN c.sys IS NULL THEN NULL WHEN h.url IS NOT NULL THEN 'historical_version_at_filing' WHEN cur.url IS NULL THEN 'no_version' WHEN c.filed <> '' AND c.filed < began THEN 'current_version_postdates_filing' WHEN c.filed = '' THEN 'current_version_filing_date_unknown' WHEN began IS NULL THEN 'current_version_unverified' ELSE 'current_version_at_or_before_filing' END AS url_version_status
 FROM c LEFT JOIN best b ON b.k = c.k AND b.pos = c.pos LEFT JOIN h ON h.k = c.k AND h.pos = c.pos LEFT JOIN cur ON cur.code = c.sys || ' ' || split_part(c.sec, '(', 1)""")
def charge_full(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    s = F.when(k % 2 == 0, "PC").otherwise("FGC")
    sec = F.concat((100 + k % 60).cast("string"), F.when(k % 4 == 0, "(a)").otherwise(""))
    cite = F.concat(s, F.lit(" "), sec)
    listed = F.when(k % 3 == 0, F.concat(cite, F.lit(" / F"))).when(k % 3 == 1, F.concat(F.lit("BURGLARY "), cite, F.lit(" M"))).otherwise(F.concat(cite, F.lit("/I; PC 2"), sec, F.lit(" | loud noises")))
    rows = o.select(k.alias("k"), F.when(k % 11 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("filed"), listed.alias("listed"))
    p, n = table(spark, d, "part"), F.col("p_partkey")
    system, y = F.when(n % 2 == 0, "PC ").otherwise("FG "), (1994 + n % 8).cast("string")
    schedule = p.select(
        F.concat(system, (100 + n % 50).cast("string"), F.when(n % 16 == 0, "(a)").otherwise("")).alias("code"), F.concat("p_name", F.when(n % 3 == 0, ": SECOND DEGREE").otherwise("")).alias("title"), F.concat(y, F.lit("-01-01")).alias("effective_from"),
        F.when(n % 2 == 0, F.concat(y, F.lit("-12-31"))).alias("effective_to"), F.when(n % 5 == 0, 3).when(n % 5 == 1, 2).otherwise(1).alias("priority"), F.concat(F.lit("src"), F.lpad(n.cast("string"), 9, "0")).alias("source"),
        F.col("p_brand").alias("source_label"), F.when(n % 5 == 1, "state_table").alias("title_source"),
    )
    versions = p.select(
        F.concat(system, (100 + n % 60).cast("string")).alias("code"), n.alias("pos"), F.concat((1993 + n % 7).cast("string"), F.lit("-06-01")).alias("effective_from"),
        F.when(n % 3 > 0, F.concat((1994 + n % 7).cast("string"), F.lit("-05-31"))).alias("effective_to"), F.concat(F.lit("u"), n.cast("string")).alias("url"),
    )
    current = versions.groupBy("code").agg(F.min("pos").alias("m")).select("code", F.concat(F.lit("c"), "code").alias("url"), F.when(F.col("m") % 4 > 0, "1999-01-01").alias("current_start"))
    c = charges.full(rows, "k", "listed", "filed", schedule, versions, current)
    return c.select(
        "k", "pos", "raw", "title", "title_source", "schedule_title", "title_version_status", "title_schedule_source", "title_schedule_source_label", "title_schedule_effective_from", "title_schedule_effective_to",
        "code", "classification", "url", "url_version_status",
    )


_KINDS = ("dismissal", "default_judgment", "name_change_decree")
_RESULT = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{EVENT_RESULTS[k]}'" for k in _KINDS if k in EVENT_RESULTS) + " WHEN '' THEN 'Disposition recorded' END"


@query("outcome_projection", f"""WITH e AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, 'h' || l_linenumber AS h, CASE l_returnflag WHEN 'R' THEN 'operative' WHEN 'A' THEN 'superseding' ELSE 'denied' END AS status,
  CASE l_linenumber % 3 WHEN 0 THEN '{_KINDS[0]}' WHEN 1 THEN '{_KINDS[1]}' ELSE '{_KINDS[2]}' END AS kind, strftime(l_shipdate, '%Y-%m-%d') AS day, l_quantity % 4 = 0 AS undone, l_linenumber % 2 = 0 AS final, CASE WHEN l_linestatus = 'F' THEN 'case' ELSE 'party' END AS scope FROM lineitem),
 s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'h2' END AS latest, CASE WHEN o_orderkey % 4 = 0 THEN 'h1' END AS closing, CASE o_orderkey % 5 WHEN 0 THEN 'Whole Case-Terminated' WHEN 1 THEN 'open' WHEN 2 THEN 'closed' ELSE '' END AS closure, o_orderkey % 11 = 0 AS vac, o_orderkey % 13 = 0 AS sat, o_orderkey % 6 = 0 AS grp, o_orderkey % 17 = 0 AS nodata FROM orders),
 p AS (SELECT s.k, any_value(latest) AS latest, any_value(closing) AS closing, any_value(closure) AS closure, any_value(vac) AS vac, any_value(sat) AS sat, any_value(grp) AS grp, any_value(nodata) AS nodata,
   arg_min(e, e.pos) FILTER (WHERE e.h = s.latest) AS named, arg_max(e, e.pos) FILTER (WHERE e.status <> 'denied') AS lastop, arg_min(e, e.pos) FILTER (WHERE e.h = s.closing) AS cl, count(*) FILTER (WHERE e.status <> 'denied') AS nop, coalesce(bool_or(e.status <> 'denied' AND e.final AND NOT e.undone), false) AS evfinal FROM s LEFT JOIN e ON e.k = s.k GROUP BY s.k),
 q AS (SELECT *, coalesce(named.kind, lastop.kind, '') AS kind, coalesce(named.day, lastop.day, '') AS day, coalesce(named.h, lastop.h, latest, '') AS hash, nop > 0 OR grp AS evidence,
   cl IS NOT NULL AND coalesce(cl.status <> 'denied' AND NOT cl.undone AND (cl.scope = 'case' OR (cl.kind = 'name_change_decree' AND k % 8 = 0)) AND cl.final, false) AS valid FROM p),
 r AS (SELECT *, closure IN ('Whole Case-Terminated', 'closed') AND k % 7 > 0 AND valid AND NOT vac AS ended, {_RESULT.format('kind')} AS base FROM q),
 t AS (SELECT *, CASE WHEN ended AND kind = 'dismissal' THEN 'Case dismissed' ELSE base END AS result, closure = 'open' AS open FROM r)
 SELECT k, CASE WHEN nodata THEN 'unavailable' WHEN sat THEN 'judgment_satisfied' WHEN ended THEN 'case_terminated' WHEN vac AND evidence THEN 'disposition_vacated' WHEN evidence THEN 'disposition_evidence' WHEN open THEN 'affirmatively_open' ELSE 'unknown' END AS case_status,
 CASE WHEN nodata THEN 'No data' WHEN sat THEN 'Satisfaction of judgment on file' WHEN ended THEN result WHEN vac AND evidence THEN 'Prior disposition vacated or set aside' WHEN evidence THEN result WHEN open THEN 'Court status: open' ELSE 'Unknown / no final disposition detected' END AS status_label,
 CASE WHEN nodata THEN 'No data' WHEN ended THEN result || CASE WHEN day <> '' THEN ' on ' || day ELSE '' END || CASE WHEN k % 8 = 0 THEN ' (observed single petition:name change decree)' ELSE '' END WHEN evidence THEN result || CASE WHEN day <> '' THEN ' on ' || day ELSE '' END || '; closure of the entire case not established' ELSE 'Unknown / no final disposition detected' END AS finality_label,
 evidence AS has_disposition_evidence, NOT vac AND (grp OR evfinal) AS has_current_final_disposition, ended AS whole_case_terminated, open AS affirmatively_open, kind AS final_disposition_type, day AS final_disposition_date, vac AS judgment_is_vacated, sat AS satisfied, hash AS current_event_hash,
 CASE closure WHEN '' THEN 'unknown' ELSE closure END AS case_closure_status, valid AS case_closure_evidence_valid FROM t""")
def outcome_projection(spark, d):
    li, n = table(spark, d, "lineitem"), F.col("l_linenumber")
    event = F.struct(
        F.concat(F.lit("h"), n.cast("string")).alias("entry_hash"), F.when(F.col("l_returnflag") == "R", "operative").when(F.col("l_returnflag") == "A", "superseding").otherwise("denied").alias("status"),
        F.when(n % 3 == 0, _KINDS[0]).when(n % 3 == 1, _KINDS[1]).otherwise(_KINDS[2]).alias("event_kind"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("entry_date"),
        F.when(F.col("l_quantity") % 4 == 0, "set-aside").otherwise("operative").alias("current_effect"), F.lit("terminal").alias("finality"), F.when(F.col("l_linestatus") == "F", "Case").otherwise("party").alias("disposition_scope"),
        (n % 2 == 0).alias("is_final_disposition"), F.lit("closes case").alias("case_closure_effect"),
    )
    events = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct(n, "l_partkey", "l_suppkey", event.alias("e")))), lambda x: x["e"]).alias("events"))
    k = F.col("k")
    summary = F.struct(
        F.when(k % 3 == 0, "h2").alias("latest_dispositive_event_hash"), F.when(k % 4 == 0, "h1").alias("case_closure_event_hash"),
        F.when(k % 5 == 0, "Whole Case-Terminated").when(k % 5 == 1, "open").when(k % 5 == 2, "closed").alias("case_closure_status"), F.when(k % 7 > 0, "closes_case").alias("case_closure_effect"),
        F.when(k % 8 == 0, "observed_single_petition:name_change_decree").alias("case_closure_basis"), (k % 11 == 0).alias("judgment_is_vacated"), (k % 13 == 0).alias("judgment_is_satisfied"),
        F.when(k % 6 == 0, F.array(F.struct(F.lit("operative").alias("current_effect"), F.lit(True).alias("is_final")))).alias("disposition_groups"),
    )
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).join(events, "k", "left")
    record = F.when(k % 2 == 0, F.to_json(F.struct(summary.alias("summary"), "events"))).otherwise(F.to_json(F.struct(summary.alias("operative_summary"), "events")))
    r = outcomes.projection(rows.select("k", record.alias("record")), "k", "record", no_data=k % 17 == 0)
    return r.select(
        "k", "case_status", "status_label", "finality_label", "has_disposition_evidence", "has_current_final_disposition", "whole_case_terminated", "affirmatively_open", "final_disposition_type", "final_disposition_date",
        "judgment_is_vacated", "satisfied", "current_event_hash", "case_closure_status", "case_closure_evidence_valid",
    )


@query("case_parts", """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber = 2 THEN '' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS day, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS idx FROM lineitem),
 twice AS (SELECT DISTINCT k, 1 AS c FROM l UNION ALL SELECT DISTINCT k, 2 FROM l WHERE k % 10 = 0),
 p AS (SELECT k, 'docket_events' AS part, row_number() OVER (PARTITION BY k ORDER BY day, idx) - 1 AS place, idx, 'Line ' || n AS said FROM l
  UNION ALL SELECT k, 'documents', row_number() OVER (PARTITION BY k ORDER BY day = '', day, 'd' || n, idx) - 1, idx, 'd' || n FROM l WHERE k % 3 = 0
  UNION ALL SELECT DISTINCT k, 'payments', 0, 0, '5' FROM l WHERE k % 4 = 0
  UNION ALL SELECT DISTINCT k, 'parties', 0, 0, 'A Co' FROM l WHERE k % 5 = 0 UNION ALL SELECT DISTINCT k, 'parties', 1, 1, 'B' FROM l WHERE k % 5 = 0
  UNION ALL SELECT DISTINCT k, 'parties', 0, 0, 'Lee' FROM l WHERE k % 5 = 1 UNION ALL SELECT DISTINCT k, 'attorneys', 0, 0, 'FOX, ANN' FROM l WHERE k % 5 = 1
  UNION ALL SELECT DISTINCT k, 'representation_edges', 0, NULL, 'FOX, ANN' FROM l WHERE k % 5 = 1 UNION ALL SELECT DISTINCT k, 'representation_edges', 1, NULL, 'LAKE, BO' FROM l WHERE k % 5 = 1)
 SELECT k, part, CAST(place AS INTEGER) AS place, CAST(idx AS INTEGER) AS idx, said FROM p JOIN twice USING (k)""")
def case_parts(spark, d):
    n, k = F.col("l_linenumber"), F.col("k")
    day = F.when(n == 2, "").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    entry, doc = F.struct(day.alias("FILEDATE"), F.concat(F.lit("Line "), n.cast("string")).alias("RTEXT")), F.struct(day.alias("filed"), F.concat(F.lit("d"), n.cast("string")).alias("DocID"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct(n, "l_partkey", "l_suppkey", entry.alias("e"), doc.alias("d")))).alias("x"))
    person = lambda **f: F.array(F.struct(*[F.lit(v).alias(c) for c, v in f.items()]))
    record = _json({
        "case_number": F.concat(F.lit("CGC-20-"), k.cast("string")), "title": F.when(k % 5 == 0, "A Co. vs B et al.").otherwise("no caption"), "docket_entries": F.transform("x", lambda r: r["e"]),
        "documents": F.when(k % 3 == 0, F.transform("x", lambda r: r["d"])), "payments": F.when(k % 4 == 0, F.array(F.struct(F.lit("5").alias("AMOUNT")))),
        "parties": F.when(k % 5 == 1, person(PARTY="Lee", **{"ATTORNEY(S)": "Lake, Bo"})), "attorneys": F.when(k % 5 == 1, person(NAME="FOX, ANN", PARTY="LEE (DEFENDANT)")),
    })
    rows = rows.select("k", record.alias("record"))
    p = caseparts.case_parts(rows.union(rows.where(k % 10 == 0)), "k", "record")
    f = lambda name: F.nullif(F.col("fields")[name], F.lit(""))
    said = F.when(F.col("part") == "documents", f("doc_id")).otherwise(F.coalesce(f("attorney_name"), f("name"), f("description"), f("amount")))
    return p.select("k", "part", "place", "idx", said.alias("said"))


@query("case_facts_repeated", """WITH l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT k, n AS docket_events, CAST(CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS documents, CAST(CASE k % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS BIGINT) AS parties
 FROM (SELECT * FROM l UNION ALL SELECT * FROM l WHERE k % 7 = 0)""")
def case_facts_repeated(spark, d):
    r = _case_records(spark, d)
    return caseparts.case_facts(r.union(r.where("k % 7 = 0")), "k", "record").select("k", "docket_events", "documents", "parties")


PACKED = """r AS (SELECT p_size % 3 AS grp, p_partkey // 4 AS o, CAST(p_size * 100 AS BIGINT) AS s, row_number() OVER (PARTITION BY p_size % 3 ORDER BY p_partkey // 4, p_size * 100) AS k FROM part),
 w(grp, k, o, s, part, n, total) AS (SELECT grp, k, o, s, CAST(0 AS BIGINT), CAST(1 AS BIGINT), s FROM r WHERE k = 1
 UNION ALL SELECT r.grp, r.k, r.o, r.s, CASE WHEN w.n >= 20 OR w.total + r.s > 30000 THEN w.part + 1 ELSE w.part END, CASE WHEN w.n >= 20 OR w.total + r.s > 30000 THEN 1 ELSE w.n + 1 END,
 CASE WHEN w.n >= 20 OR w.total + r.s > 30000 THEN r.s ELSE w.total + r.s END FROM w JOIN r ON r.grp = w.grp AND r.k = w.k + 1)"""


def _sized(spark, d):
    return table(spark, d, "part").select((F.col("p_size") % 3).alias("grp"), F.floor(F.col("p_partkey") / 4).alias("o"), (F.col("p_size") * 100).cast("long").alias("s"))


@query("part_packing_ties", f"WITH RECURSIVE {PACKED} SELECT grp, o, s, part FROM w")
def part_packing_ties(spark, d):
    return bands.pack_parts(_sized(spark, d), "grp", "o", "s", 20, 30000)


@query("part_packing_sql", f"WITH RECURSIVE {PACKED} SELECT grp, o, s, part FROM w")
def part_packing_sql(spark, d):
    udtfs.register(spark)
    return spark.sql("SELECT * FROM pack_parts(TABLE({rows}) PARTITION BY grp ORDER BY (o, s), 's', 20, 30000)", rows=_sized(spark, d))


@query("parts_of_null_groups", "SELECT p_partkey, CAST((row_number() OVER (PARTITION BY CASE WHEN p_size % 4 > 0 THEN p_size % 4 END ORDER BY p_partkey) - 1) // 50 AS BIGINT) AS part FROM part")
def parts_of_null_groups(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 4 > 0, F.col("p_size") % 4).alias("grp"))
    return bands.parts_by_count(p, "grp", [F.col("p_partkey")], 50).select("p_partkey", "part")


@query("places_of_null_keys", "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS record_index FROM part WHERE p_size % 4 = 0")
def places_of_null_keys(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 4 > 0, F.col("p_name")).alias("id"))
    return routes.record_places(p, "part", "id", "p_partkey").where("record_bucket is null").select("p_partkey", "record_index")


WEB = f"{CASES}, web AS (SELECT case_number, CASE o_orderkey % 3 WHEN 0 THEN 'see http://x.y/' || o_orderkey WHEN 1 THEN 'foo:bar ' || o_orderkey ELSE 'plain -from:2001 ' || o_orderkey END AS case_title, year, prefix FROM cases)"


@query("dsl_unknown_namespaces", f"WITH {WEB} SELECT case_number, 'url' AS q FROM web WHERE contains(case_title, 'see http://x.y/1') AND year >= 1995 UNION ALL SELECT case_number, 'word' FROM web WHERE contains(case_title, 'foo:bar 1') AND contains(case_title, '7') UNION ALL SELECT case_number, 'negated' FROM web WHERE contains(case_title, '-from:2001')")
def dsl_unknown_namespaces(spark, d):
    k = F.col("o_orderkey").cast("string")
    title = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("see http://x.y/"), k)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("foo:bar "), k)).otherwise(F.concat(F.lit("plain -from:2001 "), k))
    web = cases(spark, d).select("case_number", title.alias("case_title"), "year", "prefix")
    out = None
    for name, q in (("url", "see http://x.y/1 from:1995"), ("word", "foo:bar 1 case-title:7"), ("negated", "-from:2001")):
        found = search.directory(web, search.parse_query(q)).select("case_number", F.lit(name).alias("q"))
        out = found if out is None else out.union(found)
    return out


@query("dotted_labels", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Violation of A.D.A. ' || p_partkey WHEN 1 THEN 'Breach AND/OR ' || p_partkey WHEN 2 THEN 'Fraud (UCL) ' || p_partkey WHEN 3 THEN 'Wrongful Use of B.P.C. § ' || p_partkey ELSE 'Of Counsel, INC. ' || p_partkey END AS label FROM part""")
def dotted_labels(spark, d):
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    head = F.when(k % 5 == 0, "VIOLATION OF A.D.A.").when(k % 5 == 1, "BREACH AND/OR").when(k % 5 == 2, "AND FRAUD (UCL)").when(k % 5 == 3, "WRONGFUL USE OF B.P.C. §").otherwise("OF COUNSEL, INC.")
    return table(spark, d, "part").select("p_partkey", text.pretty_label(F.concat(head, F.lit(" "), n, F.lit(" ;"))).alias("label"))
