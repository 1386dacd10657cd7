"""Queries of text functions, keys, hashes and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, hashing, text
from .bindings import CASES, OFFICER_KEY, OFFICERS, SEARCH_KEY, cases, officers, query, table


@query("norm_location", f"SELECT p_partkey, {SEARCH_KEY.format('raw')} AS key, coalesce(nullif(replace({SEARCH_KEY.format('raw')}, ' ', '_'), ''), 'unknown') AS compact FROM (SELECT p_partkey, p_name || ' -- & ' || upper(p_type) || '.' AS raw FROM part)")
def norm_location(spark, d):
    raw = F.concat("p_name", F.lit(" -- & "), F.upper("p_type"), F.lit("."))
    return table(spark, d, "part").select("p_partkey", text.search_key(raw).alias("key"), text.compact_key(raw).alias("compact"))


@query("norm_clerk_category", r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower('The ' || p_type || ' & Parts of a ' || p_brand), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), '\b(?:the|a|an|of|for|to)\b', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM part""")
def norm_clerk_category(spark, d):
    return table(spark, d, "part").select("p_partkey", text.category_key(F.concat(F.lit("The "), "p_type", F.lit(" & Parts of a "), "p_brand")).alias("key"))


@query("norm_officer", f"WITH {OFFICERS} SELECT p_partkey, {OFFICER_KEY.format('raw')} AS key FROM officers")
def norm_officer(spark, d):
    return officers(spark, d).select("p_partkey", text.officer_key(F.col("raw")).alias("key"))


@query("comparable_name_key", r"""SELECT c_custkey, trim(regexp_replace(regexp_replace(trim(regexp_replace(upper(replace(n, '&', ' AND ')), '[^A-Z0-9]+', ' ', 'g')), '\b(?:COMPANY|COMPANIES|CO|CORP|CORPORATION|INCORPORATED|INC|LLC|LLP|LP|LTD|LIMITED|NA)\b', ' ', 'g'), '\s+', ' ', 'g')) AS key
 FROM (SELECT c_custkey, c_name || ' & ' || c_mktsegment || ' Co., Inc.' AS n FROM customer)""")
def comparable_name_key(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.name_key(F.concat("c_name", F.lit(" & "), "c_mktsegment", F.lit(" Co., Inc."))).alias("key"))


@query("case_prefix_category", f"""WITH {CASES} SELECT o_orderkey, prefix AS found, replace(case_number, '-', '') AS key,
 CASE WHEN prefix = 'CRI' THEN 'Criminal' WHEN prefix[1] = 'C' THEN 'Civil' WHEN prefix[1] = 'F' THEN 'Family' ELSE 'Probate' END AS category,
 CASE WHEN prefix IN ('CGC', 'CUD') THEN 'Civil' WHEN prefix = 'PES' THEN 'Probate' WHEN prefix = 'FDI' THEN 'Family' ELSE 'Criminal' END AS inferred FROM cases""")
def case_prefix_category(spark, d):
    n = F.lower("case_number")
    return cases(spark, d).select("o_orderkey", text.record_prefix(n).alias("found"), text.record_key(n).alias("key"), text.record_category(n).alias("category"), text.inferred_matter_type(n).alias("inferred"))


@query("prefix_info", f"""WITH {CASES} SELECT prefix AS code, count(*) AS n, CASE prefix WHEN 'CRI' THEN 'Criminal' WHEN 'PES' THEN 'Probate' WHEN 'FDI' THEN 'Family' ELSE 'Civil' END AS grp,
 CASE prefix WHEN 'CRI' THEN 'Criminal' WHEN 'PES' THEN 'Probate - Estate' WHEN 'FDI' THEN 'Family - Dissolution' WHEN 'CGC' THEN 'Civil - General Civil' ELSE 'Civil - Unlawful Detainer' END AS label,
 CAST(CASE prefix WHEN 'CRI' THEN 4 WHEN 'PES' THEN 2 WHEN 'FDI' THEN 1 ELSE 0 END AS BIGINT) AS grp_sort FROM cases GROUP BY prefix""")
def prefix_info(spark, d):
    by = cases(spark, d).groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).withColumn("i", text.prefix_info(F.lower("prefix")))
    return by.select(F.col("i.code").alias("code"), "n", F.col("i.grp").alias("grp"), F.col("i.label").alias("label"), F.col("i.grp_sort").cast("long").alias("grp_sort"))


@query("fnv_bucket", """SELECT c_custkey, h AS hash, lower(lpad(to_hex(h % 256), 2, '0')) AS bucket FROM (SELECT c_custkey, CAST(list_reduce([CAST(ord(c) AS HUGEINT) for c in string_split('litigants:' || c_name, '')], lambda a, b: (xor(a, b) * 16777619) % 4294967296, CAST(2166136261 AS HUGEINT)) AS BIGINT) AS h FROM customer)""")
def fnv_bucket(spark, d):
    h = hashing.fnv1a32(F.concat(F.lit("litigants:"), "c_name"))
    return table(spark, d, "customer").select("c_custkey", h.alias("hash")).withColumn("bucket", hashing.bucket_name(F.col("hash") % 256, 256))


@query("sha_bucket", f"WITH {CASES} SELECT substr(sha256(replace(case_number, '-', '')), 1, 2) AS bucket, count(*) AS n, min(case_number) AS first_case FROM cases GROUP BY 1")
def sha_bucket(spark, d):
    c = cases(spark, d).withColumn("bucket", hashing.sha_bucket(text.strict_record_key(F.col("case_number"))))
    return c.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("case_number").alias("first_case"))


@query("iso_dates", f"WITH {CASES} SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE filed END AS iso, CASE WHEN o_orderkey % 4 IN (0, 2) THEN filed ELSE '' END AS found FROM cases")
def iso_dates(spark, d):
    t = F.to_date("filed")
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.concat("filed", F.lit(" 11:18:18"))).when(F.col("o_orderkey") % 4 == 1, F.upper(F.date_format(t, "MMM-dd-yyyy"))).when(F.col("o_orderkey") % 4 == 2, F.date_format(t, "M/d/yyyy")).otherwise("soon")
    return cases(spark, d).select("o_orderkey", dates.to_iso(raw).alias("iso"), dates.find_iso(F.concat(F.lit("filed "), raw)).alias("found"))


@query("case_year_pivot", f"WITH {CASES} SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 2019 ELSE year END AS y FROM cases")
def case_year_pivot(spark, d):
    filed = F.when(F.col("o_orderkey") % 2 == 0, "2019-05-05")
    return cases(spark, d).select("o_orderkey", dates.record_year(F.col("case_number"), filed, 2026).cast("long").alias("y"))


@query("slug_labels", r"SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown') AS slug FROM part")
def slug_labels(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"))


@query("unique_text_list", """SELECT c_custkey, string_agg(v, '|' ORDER BY pos) AS names FROM (SELECT c_custkey, v, pos, row_number() OVER (PARTITION BY c_custkey, upper(v) ORDER BY pos) AS k FROM (
 SELECT c_custkey, unnest([c_name, lower(c_name), c_mktsegment, upper(c_name), lower(c_mktsegment)]) AS v, unnest([1, 2, 3, 4, 5]) AS pos FROM customer)) WHERE k = 1 GROUP BY c_custkey""")
def unique_text_list(spark, d):
    raw = F.concat_ws(" ; ", "c_name", F.lower("c_name"), "c_mktsegment", F.upper("c_name"), F.lit(" "), F.lower("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(text.unique_texts(text.as_list(raw)), "|").alias("names"))


@query("optional_numbers", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_acctbal ELSE NULL END AS number, CASE WHEN c_custkey % 3 = 2 THEN c_custkey END AS n, c_custkey % 2 = 0 AS flag FROM customer")
def optional_numbers(spark, d):
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.col("c_acctbal").cast("string")).when(k % 3 == 1, "  ").otherwise("n/a")
    count = F.when(k % 3 == 2, k.cast("string")).when(k % 3 == 1, "-4").otherwise("x")
    flag = F.when(k % 2 == 0, " Yes ").otherwise("no")
    return table(spark, d, "customer").select("c_custkey", text.optional_number(raw).alias("number"), text.count_or_null(count).alias("n"), text.loose_bool(flag).alias("flag"))


@query("title_parties", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS plaintiff, CASE WHEN c_custkey % 3 = 0 THEN 'N' || c_nationkey END AS defendant, CASE WHEN c_custkey % 3 = 1 THEN c_name END AS subject FROM customer")
def title_parties(spark, d):
    k = F.col("c_custkey") % 3
    nation = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))
    title = F.when(k == 0, F.concat("c_name", F.lit("  vs. "), nation)).when(k == 1, F.concat(F.lit("In re "), "c_name")).otherwise(F.concat(F.lit("People v. "), "c_name"))
    return table(spark, d, "customer").select("c_custkey", text.title_parties(title).alias("t")).select("c_custkey", "t.*")


@query("represented_parties", "SELECT c_custkey, upper(c_name) || '|' || upper(c_mktsegment) AS names FROM customer")
def represented_parties(spark, d):
    raw = F.concat("c_name", F.lit(" (PLAINTIFF), "), F.lower("c_mktsegment"), F.lit(" (CROSS-DEFENDANT) ; "), "c_name", F.lit(" (AND TRUSTEE of x)"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(text.represented_parties(raw), "|").alias("names"))


@query("firm_types", """SELECT s_suppkey, gov, CASE WHEN k IN (0, 1) THEN 'Private' WHEN n <= 1 THEN 'Solo' ELSE 'Private' END AS category FROM (SELECT s_suppkey, s_suppkey % 6 AS k, s_nationkey % 3 AS n,
 CASE s_suppkey % 6 WHEN 2 THEN 'City and County of San Francisco' WHEN 3 THEN 'State' WHEN 4 THEN 'Municipalities' WHEN 5 THEN 'Federal' ELSE 'Other Government' END AS gov FROM supplier)""")
def firm_types(spark, d):
    names = ["Able Baker LLP", "Fox & Hound", "San Francisco City Attorney", "Office of the Attorney General", "Springfield County Counsel's helper", "The U.S. Trustee"]
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("s_suppkey") % 6 + 1).cast("int"))
    s = table(spark, d, "supplier").withColumn("firm", name)
    own = F.when(F.col("s_suppkey") % 6 == 4, "Springfield County hall").otherwise(F.col("firm"))
    return s.select("s_suppkey", text.government_bucket(F.col("firm")).alias("gov"), text.firm_category(own, F.col("s_nationkey") % 3).alias("category"))


@query("props_json", "SELECT user_id, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS total, count(*) AS n FROM events GROUP BY user_id")
def props_json(spark, d):
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k long"))
    return e.groupBy("user_id").agg(F.sum("p.k").alias("total"), F.count(F.lit(1)).alias("n"))


@query("storage_paths", f"WITH {CASES} SELECT o_orderkey, prefix || '/' || lpad(CAST(year % 100 AS VARCHAR), 2, '0') || '/' || case_number || '.json' AS path FROM cases")
def storage_paths(spark, d):
    return cases(spark, d).select("o_orderkey", text.safe_path(text.shard_path(F.lower("case_number"))).alias("path"))


@query("page_text", r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', ' ', 'g'), '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS cleaned FROM pages""")
def page_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.clean_inline(F.col("html")).alias("cleaned"))
