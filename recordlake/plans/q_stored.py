"""Queries over stored forms: partitions, pages, bitmaps, compressed postings, sketches, locale order, sets of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import bitmaps, builds, facets, identity, lineage, postings, rankings, search, sketches, udtfs
from ..sources import sinks, tables
from ..streaming import stateful
from .bindings import CASES, OFFICER_KEY, OFFICERS, cases, officers, query, table
from .q_builds import DIRECTORY
from .q_builds import _directory as _named_directory
from .q_records import DIR, GRAMS, _directory, _parts


@query("directory_stored", f"WITH {DIR} SELECT case_number, year, prefix FROM dir WHERE prefix IN ('CGC', 'PES') AND year BETWEEN 1995 AND 1996 AND contains(lower(title), '7')")
def directory_stored(spark, d):
    at = f"{lineage.folder(spark)}/directory"
    tables.write_directory(_directory(spark, d), at)
    q = search.parse_query("title:7 from:1995 to:1996")
    return search.directory(tables.read_directory(spark, at), q, prefixes=["CGC", "PES"]).select("case_number", F.col("year").cast("long").alias("year"), "prefix")


@query("references_stored", f"WITH {DIR} SELECT case_number, title FROM dir WHERE title = (SELECT min(title) FROM dir)")
def references_stored(spark, d):
    x, at = _directory(spark, d), f"{lineage.folder(spark)}/directory"
    tables.write_directory(x, at)
    least = x.agg(F.min("title").alias("title"))
    refs = x.join(least, "title", "left_semi").select("prefix", "year", "case_number")
    return tables.records_of(refs, tables.read_directory(spark, at)).select("case_number", "title")


def _numbered(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return rankings.ordinals(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query("page_stored", "SELECT o_orderkey, ordinal FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS ordinal FROM orders) WHERE ordinal > 480 AND ordinal <= 530")
def page_stored(spark, d):
    at = f"{lineage.folder(spark)}/pages"
    tables.write_pages(_numbered(spark, d), "ordinal", at, 500)
    return tables.page(spark, at, "ordinal", 480, 50, 500).select("o_orderkey", "ordinal")


def _facets(spark, d):
    """(rows with ordinals, stored bitmaps by facet, bitmap of all rows)."""
    rows = rankings.ordinals(_named_directory(spark, d), [F.col("case_number")])
    index = lineage.stored(bitmaps.build(rows.withColumn("f", text.search_key(F.col("decreed_name"))), "f", "ordinal"))
    return rows, index, lineage.stored(bitmaps.everything(rows, "ordinal"))


@query("bitmap_or_negative", f"""{DIRECTORY} SELECT case_number FROM d WHERE year >= 1997 AND (contains(lower(case_title), '33') OR decreed_name = 'FURNITURE' OR NOT (decreed_name IN ('BUILDING', 'MACHINERY') AND decreed_name IN ('BUILDING', 'HOUSEHOLD')))""")
def bitmap_or_negative(spark, d):
    rows, index, every = _facets(spark, d)
    q = search.parse_query("case_title:33 from:1997")
    base = bitmaps.everything(search.in_years(rows, q), "ordinal")
    clause = bitmaps.everything(search.directory(rows, q), "ordinal")
    either = bitmaps.without(every, [bitmaps.any_of(index, ["building", "machinery"]), bitmaps.any_of(index, ["building", "household"])], "or")
    found = bitmaps.all_of([base, bitmaps.union([clause, bitmaps.any_of(index, ["furniture"]), either])])
    return bitmaps.fetch(rows, "ordinal", found).select("case_number")


@query("bitmap_negative_and", f"{DIRECTORY} SELECT count(*) AS n FROM d WHERE NOT (decreed_name = 'BUILDING' OR decreed_name = 'MACHINERY')")
def bitmap_negative_and(spark, d):
    _, index, every = _facets(spark, d)
    return bitmaps.without(every, [bitmaps.any_of(index, ["building"]), bitmaps.any_of(index, ["machinery"])]).agg(bitmaps.count().alias("n"))


@query("postings_stored", "SELECT p_partkey + 1 AS ordinal, p_name FROM part WHERE contains(p_name, 'ed bol') OR contains(lower(p_brand || ' ' || p_type), 'ed bol')")
def postings_stored(spark, d):
    rows, at = _parts(spark, d).withColumn("ordinal", F.col("p_partkey") + 1), f"{lineage.folder(spark)}/postings"
    postings.build(rows, "ordinal", [F.col("p_name"), F.col("kind")], at, page=256)
    return postings.search_stored(spark, at, rows, "ordinal", ["p_name", "kind"], "ED  bol").select("ordinal", "p_name")


@query("posting_block_sizes", f"WITH {GRAMS} SELECT gram, CAST((p_partkey + 1) // 256 AS BIGINT) AS page, CAST(min(p_partkey + 1) AS BIGINT) AS first, CAST(max(p_partkey + 1) AS BIGINT) AS last, CAST(count(DISTINCT p_partkey) AS BIGINT) AS n FROM g GROUP BY 1, 2")
def posting_block_sizes(spark, d):
    """Blocks made by the table function of SQL, decoded and measured again."""
    udtfs.register(spark)
    rows = search.gram_rows(_parts(spark, d).withColumn("ordinal", (F.col("p_partkey") + 1).cast("long")), "ordinal", F.col("p_name"), F.col("kind"))
    b = spark.sql("SELECT * FROM posting_blocks(TABLE({rows}) PARTITION BY gram ORDER BY (ordinal), 'gram', 'ordinal', 256)", rows=rows)
    x = hashing.unpack_differences(F.col("data"))
    return b.withColumn("x", x).select("gram", "page", F.array_min("x").alias("first"), F.array_max("x").alias("last"), F.size("x").cast("long").alias("n"))


@query("quantile_sketch_bounds", f"""WITH {CASES}, c AS (SELECT o_custkey, count(*) AS n FROM cases GROUP BY 1), q AS (SELECT unnest(['p50', 'p90', 'p95', 'p99', 'p999']) AS name)
 SELECT name, (SELECT CAST(count(*) AS BIGINT) FROM c) AS entities, (SELECT CAST(max(n) AS BIGINT) FROM c) AS most, true AS within FROM q""")
def quantile_sketch_bounds(spark, d):
    """Sketches of two builds merged; each quantile's rank among the exact counts is off by no more than the stated bound."""
    counts = cases(spark, d).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("build", F.col("o_custkey") % 2)
    merged = sketches.merged_quantiles(lineage.stored(sketches.count_sketches(counts, ["build"], "n")))
    asked = merged.select("n", "max", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(q).alias("q"), F.col(name).alias("value")) for name, q in sketches.QUANTILES])).alias("x"))
    asked = asked.select(F.col("n").alias("entities"), F.col("max").alias("most"), "x.*")
    below = counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).withColumn("name", F.explode(F.array(*[F.lit(name) for name, _ in sketches.QUANTILES])))
    met = below.join(F.broadcast(asked), "name")  # five rows
    sums = [F.sum(F.when(c, F.col("k")).otherwise(0)).alias(n) for n, c in (("under", F.col("n") < F.col("value")), ("upto", F.col("n") <= F.col("value")))]
    at = met.groupBy("name", "q", "entities", "most").agg(*sums)
    slack = sketches.rank_error() * F.col("entities") + 1
    return at.select("name", "entities", "most", ((F.col("under") - slack <= F.col("q") * F.col("entities")) & (F.col("q") * F.col("entities") <= F.col("upto") + slack)).alias("within"))


@query("merged_name_sketches", f"""WITH {OFFICERS}, o AS (SELECT case_id, {OFFICER_KEY.format('raw')} AS norm FROM officers), n AS (SELECT norm, count(DISTINCT case_id) AS cases FROM o WHERE norm <> '' GROUP BY norm)
 SELECT CAST(count(*) AS BIGINT) AS names, true AS within FROM n""")
def merged_name_sketches(spark, d):
    """Distinct records of names before and after merging, from sketches alone, against the exact counts."""
    o = officers(spark, d).select("case_id", text.officer_identity(F.col("raw")).alias("norm")).where("norm <> ''")
    mapping = lineage.cut(identity.merge_names(o))
    held = lineage.stored(sketches.record_sketches(o, ["norm"], "case_id"))
    merged = sketches.merged_names(held, mapping).select("norm", sketches.distinct(F.col("records_hll")).alias("hll"), sketches.distinct(F.col("records_theta"), "theta").alias("theta"))
    exact = identity.merged_records(o, mapping, "case_id")
    near = lambda c: F.abs(F.col(c) - F.col("case_count")) <= 0.04 * F.col("case_count") + 1
    off = exact.join(merged, "norm", "full").select(F.lit(0).alias("names"), F.when(~F.coalesce(near("hll") & near("theta"), F.lit(False)), 1).otherwise(0).alias("off"))
    every = held.select(F.lit(1).alias("names"), F.lit(0).alias("off")).union(off)
    return every.agg(F.sum("names").alias("names"), (F.sum("off") == 0).alias("within"))


@query("facet_order_locale", """WITH l AS (SELECT p_partkey, p_size % 3 AS case_count, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(p_name, 'e', 'é') ELSE p_name || ' a' END AS label FROM part)
 SELECT p_partkey, row_number() OVER (ORDER BY case_count DESC, strip_accents(lower(label)), label LIKE '%é%', label = upper(label), p_partkey) AS place FROM l""")
def facet_order_locale(spark, d):
    k = F.col("p_partkey")
    label = F.when(k % 4 == 0, F.col("p_name")).when(k % 4 == 1, F.upper("p_name")).when(k % 4 == 2, F.replace("p_name", F.lit("e"), F.lit("é"))).otherwise(F.concat("p_name", F.lit(" a")))
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 3).alias("case_count"), label.alias("label"))
    return rankings.ordinals(rows, [*sinks.facet_order(collation="UNICODE"), F.col("p_partkey")], "place").select("p_partkey", "place")


@query("facet_label_locale", """WITH l AS (SELECT p_partkey, p_brand AS k, CASE p_partkey % 4 WHEN 0 THEN 'Elan' WHEN 1 THEN 'elan' WHEN 2 THEN 'élan' ELSE 'ELAN' END || ' ' || p_size % 2 AS label FROM part), n AS (SELECT k, label, count(*) AS n FROM l GROUP BY 1, 2),
 r AS (SELECT k, label, row_number() OVER (PARTITION BY k ORDER BY n DESC, strip_accents(lower(label)), label LIKE 'é%', CASE WHEN label LIKE 'e%' THEN 0 WHEN label LIKE 'El%' THEN 1 ELSE 2 END) AS place FROM n) SELECT k AS facet_key, label FROM r WHERE place = 1""")
def facet_label_locale(spark, d):
    k = F.col("p_partkey") % 4
    label = F.concat(F.when(k == 0, "Elan").when(k == 1, "elan").when(k == 2, "élan").otherwise("ELAN"), F.lit(" "), (F.col("p_size") % 2).cast("string"))
    rows = table(spark, d, "part").select("p_partkey", "p_brand", label.alias("label"))
    return facets.facet(rows, "label", "p_partkey", key=F.col("p_brand"), collation="UNICODE").select("facet_key", "label")


@query("published_set", "SELECT 'list' AS name, CAST(count(*) AS BIGINT) AS rows FROM (SELECT p_name FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) >= 2) UNION ALL SELECT 'search', CAST(count(DISTINCT p_name) AS BIGINT) FROM part UNION ALL SELECT 'cases', CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT p_name, p_brand FROM part) UNION ALL SELECT 'faults', 0")
def published_set(spark, d):
    t, at = builds.build_facet(table(spark, d, "part"), "p_name", "p_brand"), f"{lineage.folder(spark)}/facet"
    sinks.facet_tables(t["list"], t["search"], t["cases"], at, "UNICODE")
    rows = spark.read.parquet(f"{sinks.current(spark, at)}/_rows")
    return rows.union(sinks.set_faults(spark, at).agg(F.lit("faults"), F.count(F.lit(1))))


SEEN = "e AS (SELECT event_id, user_id, event_type, ts FROM events)"


@query("event_windows", f"WITH {SEEN}, w AS (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) - i * INTERVAL 6 HOUR AS start FROM e, (VALUES (0), (1)) v(i)) SELECT event_type, start, start + INTERVAL 12 HOUR AS \"end\", CAST(count(*) AS BIGINT) AS n FROM w GROUP BY 1, 2")
def event_windows(spark, d):
    ev = table(spark, d, "events")
    return stateful.sliding_counts(ev.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "12 hours", "6 hours").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("event_sessions", """WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", CAST(count(*) AS BIGINT) AS n FROM g GROUP BY user_id, k""")
def event_sessions(spark, d):
    ev = table(spark, d, "events")
    return stateful.session_counts(ev.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "1 hour").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("first_event_routes", "SELECT event_type || '/' || user_id AS route, CAST(arg_min(event_id, event_id) AS VARCHAR) AS record, CAST(min(event_id) AS BIGINT) AS pos, count(*) - 1 AS duplicates FROM events GROUP BY 1")
def first_event_routes(spark, d):
    ev = table(spark, d, "events").withColumn("route", F.concat_ws("/", "event_type", F.col("user_id").cast("string")))
    return stateful.first_routes(ev, "route", "event_id", "event_id")


@query("newest_event_facets", "SELECT event_type AS facet_key, count(*) AS case_count FROM (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1) GROUP BY 1")
def newest_event_facets(spark, d):
    return stateful.counts(stateful.facet_changes(table(spark, d, "events"), "user_id", "event_id", F.col("event_type")))
