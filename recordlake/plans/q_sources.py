"""Queries through the readers and writers: the given tables written in a published form and read back from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lineage, rankings, search
from ..sources import files, profiles, sinks
from .bindings import CASES, cases, query, table


@query("json_tree_rows", "SELECT n_nationkey AS nation, CAST(count(c_custkey) AS BIGINT) AS customers, CAST(sum(c_custkey) AS BIGINT) AS keys FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def json_tree_rows(spark, d):
    """One JSON file a nation in a tree; damaged files and those named *.error.json are no rows."""
    at = f"{lineage.folder(spark)}/tree"
    by = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.collect_list("c_custkey").alias("ids"))
    by.repartition(5, "nation").write.option("maxRecordsPerFile", 1).json(f"{at}/a/b")
    spark.createDataFrame([('{"nation": 99',)], "value string").coalesce(1).write.text(f"{at}/damaged.json")
    rows = files.json_tree(spark, at, "nation int, ids array<bigint>")
    return rows.select("nation", F.size("ids").cast("long").alias("customers"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("keys"))


@query("ndjson_mentions", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def ndjson_mentions(spark, d):
    at = f"{lineage.folder(spark)}/events"
    table(spark, d, "events").select("event_id", "user_id", "event_type").write.json(at)
    return files.ndjson(spark, at, "event_id bigint, user_id bigint", '"event_type":"purchase"')


@query("manifest_shards", "SELECT s_suppkey, s_name FROM supplier")
def manifest_shards(spark, d):
    s, at = table(spark, d, "supplier").select("s_suppkey", "s_name"), lineage.folder(spark)
    listed = []
    for k in range(3):
        own = s.where(F.col("s_suppkey") % 3 == k)
        own.write.json(f"{at}/shards/{k}")
        listed.append({"path": f"shards/{k}", "count": own.count()})
    import json

    spark.createDataFrame([(json.dumps({"shards": listed}),)], "value string").coalesce(1).write.text(f"{at}/suppliers-manifest.json")
    return profiles.canonical(spark, at, "suppliers", "s_suppkey bigint, s_name string")


@query("attorney_parquet", f"WITH {CASES} SELECT o_custkey AS attorney_id, CAST(count(*) AS BIGINT) AS listed, CAST(count(DISTINCT case_number) AS BIGINT) AS cases FROM cases GROUP BY 1")
def attorney_parquet(spark, d):
    c, at = cases(spark, d), f"{lineage.folder(spark)}/attorneys"
    own = c.groupBy(F.col("o_custkey").alias("attorney_id")).agg(F.collect_list("case_number").alias("x"))
    stated = own.select("attorney_id", F.lit("A").alias("name"), F.lit("1").alias("bar_number"), F.to_json(F.concat("x", F.slice("x", 1, 1), F.array(F.lit(" ")))).alias("case_numbers_json"), F.lit(999).alias("civil_case_count"))
    stated.write.parquet(at)
    rows = profiles.references(profiles.attorneys(spark, at), "attorney_id")
    return rows.groupBy("attorney_id").agg(F.count(F.lit(1)).alias("listed"), F.count_distinct("number").alias("cases"))


@query("ranked_shards_rows", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS ordinal FROM orders")
def ranked_shards_rows(spark, d):
    o = table(spark, d, "orders")
    rows = rankings.ordinals(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")]).withColumn("commit", F.lit("c1"))
    return files.ranked_shards(rows, "ordinal", "commit", o.count()).select("o_orderkey", "ordinal")


@query("materialized_texts", "SELECT DISTINCT sha256(text) AS sha256, CAST(length(text) AS BIGINT) AS n FROM documents WHERE trim(text) <> ''")
def materialized_texts(spark, d):
    """Texts of all documents in hash-named shards, fetched, verified and written only if complete."""
    docs = table(spark, d, "documents").where("trim(text) <> ''").select(F.sha2("text", 256).alias("sha256"), "text").distinct()
    at = lineage.folder(spark)
    line = F.to_json(F.struct("sha256", "text", F.length("text").alias("stored_char_count")))
    dealt = docs.withColumn("shard", F.substring("sha256", 1, 1))
    dealt.select("shard", line.alias("value")).repartition(16, "shard").sortWithinPartitions("shard").write.partitionBy("shard").text(f"{at}/shards")
    found = spark.read.format("binaryFile").load(f"{at}/shards").select("path", "length", F.sha2("content", 256).alias("d"), F.col("shard").cast("string").alias("shard"))
    listed = [{"name": r["shard"], "path": r["path"], "bytes": r["length"], "sha256": r["d"]} for r in found.collect()]  # one a shard, 16 at most
    names = {r["name"] for r in listed}
    shard = F.col("shard") if names & set("abcdef") else F.col("shard").cast("int").cast("string")
    out = files.materialize(spark, dealt.select("sha256", shard.alias("shard")), listed, f"{at}/texts")
    return out.select("sha256", F.length("text").cast("long").alias("n"))


@query("bucket_lookups", "SELECT 'Customer#000000007' AS c_name, 'found' AS status, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_name = 'Customer#000000007' UNION ALL SELECT 'nobody', 'not_found', 0 UNION ALL SELECT 'Customer#000000007 elsewhere', 'data_state_error', 0")
def bucket_lookups(spark, d):
    at = f"{lineage.folder(spark)}/lookup"
    sinks.bucketed(table(spark, d, "customer"), at, "people", "c_name", 64)
    one = "Customer#000000007"
    n = sinks.lookup(spark, at, "people", one, "c_name", 64).count()
    of = lambda path, key: sinks.lookup_status(spark, path, "people", key, "c_name", 64)
    rows = [(one, of(at, one), n), ("nobody", of(at, "nobody"), 0), (f"{one} elsewhere", of(f"{at}-gone", one), 0)]
    return spark.createDataFrame(rows, "c_name string, status string, n long")


@query("written_forms", "SELECT form, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders, (VALUES ('csv'), ('spooled'), ('partitioned')) v(form) GROUP BY form")
def written_forms(spark, d):
    o, at = table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), lineage.folder(spark)
    sinks.csv(o, f"{at}/csv")
    sinks.spooled(o, f"{at}/spool", "o_orderstatus")
    sinks.partitioned(o, f"{at}/parts", "o_orderstatus", salts=2)
    read = {
        "csv": spark.read.option("header", True).schema("o_orderkey bigint, o_orderstatus string").csv(sinks.current(spark, f"{at}/csv")),
        "spooled": spark.read.schema("o_orderkey bigint, o_orderstatus string").json(sinks.current(spark, f"{at}/spool")), "partitioned": spark.read.parquet(sinks.current(spark, f"{at}/parts")),
    }
    out = None
    for name, df in read.items():
        one = df.agg(F.lit(name).alias("form"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
        out = one if out is None else out.union(one)
    return out


@query("uncapped_list", "SELECT s_suppkey, false AS overflow FROM supplier")
def uncapped_list(spark, d):
    return rankings.capped(table(spark, d, "supplier").select("s_suppkey"), [F.col("s_suppkey")], 0)


@query("guarded_names", "SELECT count(*) > 2000 AS refused, CAST(CASE WHEN count(*) > 2000 THEN 0 ELSE count(*) END AS BIGINT) AS n FROM customer WHERE contains(c_name, '1')")
def guarded_names(spark, d):
    names = table(spark, d, "customer").where(F.col("c_name").contains("1")).select("c_name")
    try:
        return search.guarded(names).agg(F.lit(False).alias("refused"), F.count(F.lit(1)).alias("n"))
    except ValueError:
        return names.limit(1).select(F.lit(True).alias("refused"), F.lit(0).cast("long").alias("n"))


@query("date_windows", f"WITH {CASES}, e AS (SELECT max(filed) AS last FROM cases) SELECT prefix, CAST(count(*) FILTER (WHERE year BETWEEN 1994 AND 1996) AS BIGINT) AS overlapping, CAST(count(*) FILTER (WHERE CAST(filed AS DATE) BETWEEN CAST(last AS DATE) - INTERVAL 24 MONTH AND CAST(last AS DATE)) AS BIGINT) AS recent FROM cases, e GROUP BY prefix")
def date_windows(spark, d):
    c = cases(spark, d)
    last = c.agg(F.max("filed").alias("last")).withColumn("one", F.lit(1))
    rows = c.withColumn("one", F.lit(1)).join(F.broadcast(last), "one")  # one row
    over = profiles.overlapping(F.col("year"), F.lit("1994-06-30"), F.lit("1996-01-01"))
    return rows.groupBy("prefix").agg(F.count_if(over).alias("overlapping"), F.count_if(profiles.in_last_years(F.col("filed"), F.col("last"))).alias("recent"))
