"""Queries of portal records, assembled case facts, charges and causes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import captions, caseparts, casefacts, portal
from .bindings import query, table


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))


def _of(values: list, by=None):
    """One of the values by the key."""
    return F.element_at(F.array(*[v if not isinstance(v, str | None) else F.lit(v) for v in values]), ((F.col("k") if by is None else by) % len(values) + 1).cast("int"))


def _values(rows: list[str]) -> str:
    """SQL rows (i, text)."""
    return ", ".join(f"({i}, '{r.replace(chr(39), chr(39) * 2)}')" for i, r in enumerate(rows))


def _json(fields: dict) -> F.Column:
    """JSON text of the fields that are not null."""
    return F.to_json(F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(n) for n, v in fields.items()]))


def _portal(spark, d):
    k = F.col("k")
    digits, person = F.lpad(k.cast("string"), 8, "0"), F.concat(F.lit("Person "), k.cast("string"))
    row = F.struct(F.lit("2024-01-02").alias("date"), F.lit("Arraigned").alias("docketEntryComment"))
    record = _json({
        "case_number": F.when(k % 3 == 0, F.concat(F.lit("CRI-"), digits)).when(k % 3 == 1, "X9").otherwise(F.concat(F.lit("CGC-20-"), digits)),
        "criminal_case_number": F.when(k % 3 == 1, F.concat(F.lit("No. "), digits)),
        "case_header": F.struct(F.when(k % 2 == 0, person).alias("defendant")),
        "case_title": F.when(k % 5 == 1, "San Francisco criminal case 12").when(k % 5 == 2, "Criminal identity unresolved: X").when(k % 5 == 3, "Smith v. Jones et al.").when(k % 5 == 4, F.upper(person)),
        "status": F.when(k % 7 == 0, "Unavailable"), "message": F.when((k % 7 == 0) & (k % 2 == 1), "Sealed by order"),
        "portal_case_id": F.when(k % 11 == 0, k.cast("string")), "charges": F.when(k % 4 == 0, "PC 459"), "roa": F.when(k % 9 == 0, F.array(row)),
        "calendar": F.when(k % 9 == 0, F.array(F.struct(F.when(k % 2 == 0, "2024-01-02T09:30").otherwise("1/2/2024 9:30 AM").alias("startTime"), F.lit("Plea").alias("hearingType"), F.lit("5").alias("dept")))),
    })
    return _orders(spark, d).withColumn("record", record)


@query("portal_cases", """WITH r AS (SELECT o_orderkey AS k, 'Person ' || o_orderkey AS p, o_orderkey % 2 = 0 AS named, o_orderkey % 5 AS t, o_orderkey % 7 = 0 AS closed, o_orderkey % 4 = 0 AS ch, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS d FROM orders WHERE o_orderkey % 3 < 2),
 u AS (SELECT *, CASE WHEN closed THEN CASE WHEN named THEN 'Criminal portal indicates this case is not publicly available.' ELSE 'Sealed by order' END
  WHEN k % 9 = 0 OR NOT (named OR ch) THEN '' WHEN named AND ch THEN 'No information available besides the name of the defendant, ' || p || ', and charges in the case: PC 459.'
  WHEN named THEN 'No information available besides the name of the defendant, ' || p || '.' ELSE 'No information available besides charges in the case: PC 459.' END AS said FROM r)
 SELECT k, 'CRI' || d AS case_number, d AS criminal_case_number, CASE WHEN named AND t <> 3 THEN 'People v. ' || p WHEN t IN (0, 1) THEN 'Criminal identity unresolved: CRI' || d WHEN t = 2 THEN 'Criminal identity unresolved: X' WHEN t = 3 THEN 'Smith v. Jones et al.' ELSE upper(p) END AS case_title,
 NOT named AND k % 11 = 0 AS identity_incomplete, CASE WHEN said <> '' THEN 'unavailable' ELSE '' END AS status, said AS unavailable_text, CASE WHEN closed THEN 'criminal_portal_not_publicly_available' WHEN said <> '' THEN 'criminal_portal_no_public_entries' ELSE '' END AS unavailable_reason,
 CASE WHEN k % 11 = 0 THEN 'https://portal.example/criminal?CaseId=' || k ELSE 'https://portal.example/criminal' END AS source_url FROM u""")
def portal_cases(spark, d):
    n = portal.normalize(_portal(spark, d), "k", "record")
    return n.select("k", "case_number", "criminal_case_number", "case_title", "identity_incomplete", "status", "unavailable_text", "unavailable_reason", "source_url")


@query("portal_calendar", """SELECT o_orderkey AS k, CAST(0 AS BIGINT) AS idx, CASE WHEN o_orderkey % 2 = 0 THEN '2024-01-02' ELSE '1/2/2024' END AS court_date, CASE WHEN o_orderkey % 2 = 0 THEN '09:30' ELSE '9:30 AM' END AS hearing_time, 'Plea' AS matters, 'Plea' AS hearing_type, '5' AS department FROM orders WHERE o_orderkey % 9 = 0""")
def portal_calendar(spark, d):
    c = portal.calendar_rows(_portal(spark, d), "k", "record")
    return c.select("k", F.col("idx").cast("long").alias("idx"), "court_date", "hearing_time", "matters", "hearing_type", "department")


@query("portal_docket", "SELECT o_orderkey AS k, '2024-01-02' AS date_filed, 'Arraigned' AS description, '' AS submitter FROM orders WHERE o_orderkey % 9 = 0")
def portal_docket(spark, d):
    return portal.docket_rows(_portal(spark, d), "k", "record").select("k", "date_filed", "description", "submitter")


@query("case_sources", """SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'http://a/?x=1' WHEN 1 THEN 'https://b/c' WHEN 2 THEN 'https://portal.example/case?number=CGC20' || o_orderkey WHEN 3 THEN 'http://p/?CaseId=7' ELSE '' END AS url FROM orders""")
def case_sources(spark, d):
    k = F.col("k") % 5
    record = _json({
        "case_url": F.when(k == 0, "http://a/?x=1"), "source": F.when(k == 1, "https://b/c"), "CASE_NUMBER": F.when(k == 2, F.concat(F.lit("cgc-20-"), F.col("k").cast("string"))),
        "case_type": F.when(k == 3, "criminal"), "url": F.when(k == 3, "http://p/?SessionID=abc&CaseId=7"),
    })
    rows = _orders(spark, d).select("k", F.try_parse_json(record).alias("v"))
    return rows.select("k", portal.source_url(F.col("v")).alias("url"))


NOTICE_TEXTS = ["", "per CCP 1161.2.5", "see ccp 1161.2", "Rule 2.503(b)", "Restricted pursuant to court order", "CCP 482.050", "GOV 12652(c)", "Not available for viewing", "confidential"]
NOTICE_TITLES = [
    "Case not available for viewing", "Case is not available for viewing per Civ. Proc. Code § 1161.2.5", "Case is not available for viewing per Civ. Proc. Code § 1161.2",
    "Case is restricted from the Court's website pursuant to Rule of Court subdivisions 2.503(A)(1) and 2.503(C).", "Case is restricted pursuant to an order of the Court.",
    "Public access to this case is restricted pursuant to Civ. Proc. Code 482.050", "Public access to this case is restricted pursuant to Government Code § 12652 subd. (c)", "Case not available for viewing", "confidential",
]


@query("notice_titles", f"SELECT o_orderkey AS k, t AS title, CASE WHEN i IN (1, 2, 3, 5, 6) THEN '' ELSE 'No additional public docket detail is available in the captured record.' END AS subtitle FROM orders JOIN (VALUES {_values(NOTICE_TITLES)}) v(i, t) ON i = o_orderkey % 9")
def notice_titles(spark, d):
    return _orders(spark, d).select("k", casefacts.notice(_of(NOTICE_TEXTS)).alias("n")).select("k", "n.*")


@query("status_parts", """SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'Minimal tentative ruling profile' WHEN 1 THEN 'Known text.' WHEN 2 THEN 'No information available besides date of filing, 2020.' ELSE 'Case not available for viewing' END AS label,
 CASE o_orderkey % 4 WHEN 0 THEN 'Generated from tentative ruling data; the CaseInfo docket was not captured.' WHEN 3 THEN 'No additional public docket detail is available in the captured record.' ELSE '' END AS detail FROM orders""")
def status_parts(spark, d):
    k = F.col("k") % 4
    reason = F.when(k == 0, "Sealed_or_unavailable_tentative_stub").when(k.isin(1, 2), "criminal_portal_no_public_entries").otherwise("")
    shown = F.when(k == 1, "Known text criminal_portal_no_public_entries.").otherwise("")
    return _orders(spark, d).select("k", portal.status_parts(reason, shown, F.lit(""), F.lit("2020"), F.lit("")).alias("s")).select("k", "s.*")


def _case_records(spark, d):
    """JSON cases: docket rows of the lines, captions of five kinds, documents and payments of some."""
    li = table(spark, d, "lineitem").withColumn("e", F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("FILEDATE"), F.concat(F.lit("Line "), F.col("l_linenumber").cast("string")).alias("RTEXT")))
    rows = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list("e")).alias("entries"))
    k = F.col("k")
    doc = lambda i, sha: F.struct(F.lit(i).alias("DocID"), sha.alias("sha"))
    record = _json({
        "case_number": F.concat(F.lit("CGC-20-"), k.cast("string")), "CASETITLE": _of(["A Co. vs B et al.", "Conservatorship of: Cee", "Civil case 7", "X v. Y versus Z", "no caption"], k),
        "docket_entries": F.col("entries"), "documents": F.when(k % 3 == 0, F.array(doc("d1", F.lit("abc")), doc("d2", F.lit(None).cast("string")))),
        "payments": F.when(k % 4 == 0, F.array(F.struct(F.lit("5").alias("AMOUNT")))), "court": "Civil", "status": F.when(k % 5 == 0, "Case-Pending"), "filed": F.when(k % 6 == 0, "2/3/2020"),
    })
    return rows.select("k", record.alias("record"))


@query("case_facts", """WITH l AS (SELECT l_orderkey AS k, count(*) AS n, min(strftime(l_shipdate, '%Y-%m-%d')) AS f FROM lineitem GROUP BY 1)
 SELECT k, 'CGC-20-' || k AS case_number, CASE k % 5 WHEN 0 THEN 'A Co. vs B et al.' WHEN 1 THEN 'Conservatorship of: Cee' WHEN 2 THEN 'Civil case 7' WHEN 3 THEN 'X v. Y versus Z' ELSE 'no caption' END AS case_title, CASE WHEN k % 6 = 0 THEN '2020-02-03' ELSE f END AS filing_date,
 n AS docket_events, CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END AS documents, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS captured_documents, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS metadata_only_documents, CASE k % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS parties,
 CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS financial_rows, 'https://portal.example/case?number=CGC20' || k AS source_url, CASE WHEN k % 5 = 0 THEN 'affirmatively_open' ELSE 'unknown' END AS case_status FROM l""")
def case_facts(spark, d):
    f = caseparts.case_facts(_case_records(spark, d), "k", "record")
    return f.select("k", "case_number", "case_title", "filing_date", "docket_events", "documents", "captured_documents", "metadata_only_documents", "parties", "financial_rows", "source_url", "case_status")


@query("caption_parties", """WITH k AS (SELECT DISTINCT l_orderkey AS k FROM lineitem) SELECT k, name, party_type FROM k JOIN (VALUES (0, 'A Co', 'Plaintiff (caption)'), (0, 'B', 'Defendant (caption)'), (1, 'Cee', 'Subject (caption)'), (3, 'X', 'Plaintiff (caption)'), (3, 'Y v. Z', 'Defendant (caption)')) v(i, name, party_type) ON i = k % 5""")
def caption_parties(spark, d):
    return portal.parties(_case_records(spark, d), "k", "record").select("k", "name", "party_type")


CHARGES = [
    "PC 459 / F", "BURGLARY PC 459 F", "HSC 11350; FGC 2000(a)", "PC 459/F PC 211/M 99999", "H & S 11377; 23152(a) VEHICLE CODE M", "disturbing the peace | 88888", "REV AND TAX CODE § 19706; UNEMPLOYMENT INSURANCE CODE 2101",
]
CHARGE_ROWS = [
    (0, "PC 459 / F", "PC 459", "felony", "Penal Code § 459", "programmatic_citation"), (1, "BURGLARY PC 459 F", "PC 459", "felony", "BURGLARY", "criminal_index_text"),
    (2, "HSC 11350", "", "", "HSC 11350", "raw_index_text"), (2, "FGC 2000(a)", "FG 2000(a)", "", "Fish and Game Code § 2000(a)", "programmatic_citation"),
    (3, "PC 459/F", "PC 459", "felony", "Penal Code § 459", "programmatic_citation"), (3, "PC 211/M", "PC 211", "misdemeanor", "Penal Code § 211", "programmatic_citation"),
    (3, "99999", "", "", "Unrecognized criminal index charge code 99999", "raw_index_text"),
    (4, "H & S 11377", "HS 11377", "", "Health and Safety Code § 11377", "programmatic_citation"), (4, "23152(a) VEHICLE CODE M", "VC 23152(a)", "misdemeanor", "Vehicle Code § 23152(a)", "programmatic_citation"),
    (5, "disturbing the peace", "", "", "disturbing the peace", "raw_index_text"), (5, "88888", "", "", "Unrecognized criminal index charge code 88888", "raw_index_text"),
    (6, "REV AND TAX CODE § 19706", "RT 19706", "", "Revenue and Taxation Code § 19706", "programmatic_citation"), (6, "UNEMPLOYMENT INSURANCE CODE 2101", "UI 2101", "", "Unemployment Insurance Code § 2101", "programmatic_citation"),
]


def _tuples(rows) -> str:
    q = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows)


@query("charge_rows", f"SELECT o_orderkey AS k, raw, code, classification, title, title_source FROM orders JOIN (VALUES {_tuples(CHARGE_ROWS)}) v(i, raw, code, classification, title, title_source) ON i = o_orderkey % 7")
def charge_rows(spark, d):
    rows = _orders(spark, d).select("k", F.explode(captions.parse_charges(_of(CHARGES))).alias("c")).select("k", "c.*")
    t = captions.charge_title(F.col("provided_title"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("citation"), F.col("title"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select("k", "raw", blank("code"), blank("classification"), t["title"].alias("title"), t["title_source"].alias("title_source"))


@query("charge_titles", """SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'Own' WHEN 1 THEN 'Listed' WHEN 2 THEN 'Penal Code § 1' ELSE 'raw' END AS title, CASE o_orderkey % 4 WHEN 0 THEN 'criminal_index_text' WHEN 1 THEN 'local' WHEN 2 THEN 'programmatic_citation' ELSE 'raw_index_text' END AS title_source,
 CASE WHEN o_orderkey % 8 = 0 THEN 'Listed' END AS schedule_title FROM orders""")
def charge_titles(spark, d):
    k = F.col("k")
    listed = F.when(k % 8 == 0, "Listed").when(k % 8 == 4, "OWN").when(k % 4 == 1, "Listed")
    t = captions.charge_title(F.when(k % 4 == 0, "Own"), listed, F.lit("local"), F.when(k % 4 < 3, "Penal Code § 1"), F.lit("raw"))
    return _orders(spark, d).select("k", t.alias("t")).select("k", "t.*")


@query("law_urls", "SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'https://leginfo.legislature.ca.gov/faces/codes_displaySection.xhtml?sectionNum=' || o_orderkey || '.&lawCode=PEN' WHEN 1 THEN 'https://leginfo.legislature.ca.gov/faces/codes_displaySection.xhtml?sectionNum=12.5.&lawCode=VEH' ELSE '' END AS url FROM orders")
def law_urls(spark, d):
    section = F.when(F.col("k") % 3 == 0, F.concat(F.col("k").cast("string"), F.lit("(a)(1)"))).otherwise("12.5")
    return _orders(spark, d).select("k", captions.law_url(_of(["PC", "VC", "XX"]), section).alias("url"))


CAPTIONS = [
    "FIRST AMENDED COMPLAINT FOR DAMAGES FOR: 1. BREACH OF CONTRACT 2. BREACH OF THE IMPLIED COVENANT 3. CONVERSION  DEMAND FOR JURY TRIAL  PARTIES 1. Plaintiff is a company",
    "COMPLAINT\n1. UCL (B.P.C. §§ 17200 et seq.)\n2. FRAUD (CONCEALMENT)\nJURY TRIAL DEMANDED",
    "COMPLAINT FOR DAMAGES 1. RESIDENCY VERIFIED 2. NEGLIGENCE DEMAND FOR JURY TRIAL",
    "Plaintiff alleges: FACTS COMMON TO ALL CAUSES OF ACTION 1. Plaintiff is a corporation. 2. Venue is proper.",
    "INTRO\nTWENTY-FIRST CAUSE OF ACTION\n(For Fraud)\nSECOND CAUSE OF ACTION - Negligence against all defendants\n",
]
CAUSE_ROWS = [
    (0, 1, "Breach of Contract", ""), (0, 2, "Breach of the Implied Covenant", ""), (0, 3, "Conversion", ""), (1, 1, "UCL", "B.P.C. §§ 17200 et seq."), (1, 2, "Fraud (Concealment)", ""),
    (2, 2, "Negligence", ""), (4, 2, "Negligence", ""), (4, 21, "Fraud", ""),
]


@query("caption_causes", f"SELECT o_orderkey AS k, CAST(n AS INTEGER) AS n, label, statute FROM orders JOIN (VALUES {_tuples(CAUSE_ROWS)}) v(i, n, label, statute) ON i = o_orderkey % 5")
def caption_causes(spark, d):
    rows = _orders(spark, d).select("k", F.explode(captions.parse_causes(_of(CAPTIONS))).alias("c"))
    return rows.select("k", "c.n", "c.label", F.coalesce("c.statute", F.lit("")).alias("statute"))


PETITIONS = ["PETITION FOR PROBATE OF WILL AND FOR LETTERS TESTAMENTARY, NO WILL FILED", "AMENDED PETITION TO ADMINISTER ESTATE FILED BY X", "PETITION: LETTERS OF ADMINISTRATION (X)", "COMPLAINT"]
RELIEF = ["Probate of Will and for Letters Testamentary", "Administer Estate", "Letters of Administration", ""]


@query("petition_relief", f"SELECT o_orderkey AS k, t AS relief FROM orders JOIN (VALUES {_values(RELIEF)}) v(i, t) ON i = o_orderkey % 4")
def petition_relief(spark, d):
    return _orders(spark, d).select("k", F.coalesce(captions.petition_for(_of(PETITIONS)), F.lit("")).alias("relief"))


@query("canonical_causes", """SELECT o_orderkey AS k, slug, name FROM orders JOIN (VALUES (0, 'name-change', 'Name change'), (0, 'gender-change', 'Gender change'), (1, 'name-change', 'Name change'), (1, 'gender-change', 'Gender change'), (2, 'breach-of-contract', 'Breach of contract')) v(i, slug, name) ON i = o_orderkey % 3""")
def canonical_causes(spark, d):
    k = F.col("k") % 3
    labels = F.when(k == 0, F.array(F.lit("change of name"), F.lit("gender"), F.lit("residency verified"))).when(k == 1, F.array(F.lit("Change of Name and Gender"), F.lit("change of name"))).otherwise(F.array(F.lit("breach of contract"), F.lit(" ")))
    return _orders(spark, d).select("k", F.explode(captions.canonical_causes(labels)).alias("c")).select("k", "c.*")


def _pleading_rows(spark, d):
    """Three documents a case: what they say, whether they are captured, and the texts of some."""
    o = _orders(spark, d).select("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("pos"))
    k, n = F.col("k") % 6, F.col("pos")
    description = (
        F.when((k == 0) & (n == 1), "COMPLAINT").when((k == 0) & (n == 2), "FIRST AMENDED COMPLAINT (TRANSACTION ID # 1) FILED BY X; SUMMONS").when((k == 0) & (n == 3), "CROSS-COMPLAINT FILED BY Y")
        .when((k == 1) & (n == 1), "PETITION FOR LETTERS OF ADMINISTRATION, FILED BY X").when((k == 1) & (n == 2), "ACCOUNTING PETITION").when((k == 2) & (n == 1), "COMPLAINT FOR QUIET TITLE, FILED BY X")
        .when((k == 3) & (n == 1), "COMPLAINT").when((k == 4) & (n == 2), "COMPLAINT").otherwise("ANSWER TO COMPLAINT")
    )
    sha = F.when((k == 0) & (n < 3), F.concat(F.lit("a"), n.cast("string"))).when((k == 0) & (n == 3), "c").when((k == 3) & (n == 1), "none").when((k == 4) & (n == 2), "lost")
    docs = o.select("k", F.concat_ws("/", F.col("k").cast("string"), n.cast("string")).alias("doc_id"), description.alias("description"), F.concat(F.lit("2020-01-0"), n.cast("string")).alias("filed"), sha.alias("sha256"), "pos")
    texts = spark.createDataFrame([("a1", "COMPLAINT 1. FRAUD 2. NEGLIGENCE 3. TRESPASS JURY TRIAL"), ("a2", "COMPLAINT 1. CONVERSION JURY TRIAL"), ("c", "CROSS-COMPLAINT 1. INDEMNITY JURY TRIAL"), ("none", "nothing enumerated")], "sha256 string, text string")
    cases = _orders(spark, d).select("k", F.lit("CGC20").alias("case_number"), F.when(F.col("k") % 6 == 3, "OTHER NON EXEMPT COMPLAINTS (VERIFIED COMPLAINT FOR REFUND OF TAX)").otherwise("RESIDENCY VERIFIED").alias("cause_of_action"))
    return cases, docs, texts


@query("pleading_kinds", """SELECT o_orderkey AS k, kind, CAST(amendment AS INTEGER) AS amendment, CAST(place AS INTEGER) AS place FROM orders JOIN (VALUES (0, 'complaint', 1, 1), (0, 'complaint', 0, 2), (0, 'cross', 0, 1), (1, 'petition', 0, 1), (2, 'complaint', 0, 1), (3, 'complaint', 0, 1), (4, 'complaint', 0, 1)) v(i, kind, amendment, place) ON i = o_orderkey % 6""")
def pleading_kinds(spark, d):
    return casefacts.pleadings(_pleading_rows(spark, d)[1], "k").select("k", "kind", "amendment", "place")


@query("causes_of_action", """SELECT o_orderkey AS k, kind, filed, petition_for, complaint, cross_complaint, source, available, note FROM orders JOIN (VALUES
 (0, 'complaint', '2020-01-02', NULL, 'Conversion', 'Indemnity', 'ocr', true, NULL), (1, 'petition', '2020-01-01', 'Letters of Administration', 'Letters of Administration', '', 'description', false, 'complaint document not captured; causes inferred from docket description'),
 (2, 'complaint', '2020-01-01', NULL, 'Quiet Title', '', 'description', false, 'complaint document not captured; causes inferred from docket description'),
 (3, 'complaint', '2020-01-01', NULL, 'Refund of Tax', '', 'description', true, 'no enumerated cause list found in OCR caption; using document description'), (4, 'complaint', '2020-01-02', NULL, '', '', 'none', false, 'complaint OCR not available'),
 (5, 'complaint', NULL, NULL, '', '', 'none', false, 'no complaint document found')) v(i, kind, filed, petition_for, complaint, cross_complaint, source, available, note) ON i = o_orderkey % 6""")
def causes_of_action(spark, d):
    cases, docs, texts = _pleading_rows(spark, d)
    labels = lambda c: F.array_join(F.transform(c, lambda x: x["label"]), "; ").alias(c)
    out = casefacts.causes_of_action(cases, "k", docs, texts)
    return out.select("k", "kind", "filed", "petition_for", labels("complaint"), labels("cross_complaint"), "source", "available", "note")


@query("statute_classes", """SELECT o_orderkey % 50 AS k, 'PC 1385' AS code, 'procedural' AS classification, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT o_orderkey % 50, 'PC 459(A)', 'charge_candidate', count(*) FROM orders GROUP BY 1 UNION ALL SELECT o_orderkey % 50, 'VC 10', 'unknown', count(*) FROM orders GROUP BY 1""")
def statute_classes(spark, d):
    from ..operators import records

    line = F.explode(F.array(F.lit("Dismissed under PENAL CODE § 1385, plea, "), F.lit("Complaint: PC459(a) "), F.lit("see VC SECTION 10 "))).alias("head")
    rows = _orders(spark, d).select((F.col("k") % 50).alias("r"), "k", line).select("r", F.concat("head", F.col("k").cast("string")).alias("line"), F.lit("roa").alias("source"))
    return records.statute_hits(rows, "r", "line", "source").select(F.col("r").alias("k"), "code", "classification", F.col("hits").alias("n"))


@query("criminal_numbers", """SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 3 THEN 'CGC20' ELSE 'CRI' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') END AS number, CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE lpad(CAST(o_orderkey AS VARCHAR), 8, '0') END AS raw FROM orders""")
def criminal_numbers(spark, d):
    k = F.col("k")
    digits = F.lpad(k.cast("string"), 8, "0")
    number = F.when(k % 4 == 0, F.concat(F.lit("cri"), digits)).when(k % 4 == 1, F.concat(F.lit("CRI_ "), digits)).when(k % 4 == 2, "other").otherwise("cgc20")
    own = F.when(k % 4 == 2, F.concat(F.lit("#"), digits))
    return _orders(spark, d).select("k", text.criminal_archive_number(own, number).alias("number"), text.criminal_raw_number(own, number).alias("raw"))
