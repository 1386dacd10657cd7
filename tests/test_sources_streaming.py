import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from recordlake.sources import checks, files, sinks
from recordlake.streaming import ingest


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_json_tree(spark, tmp_path):
    put(f"{tmp_path}/a/1.json", '{"n": 1}')
    put(f"{tmp_path}/a/b/2.json", '{"n":\n 2}')
    put(f"{tmp_path}/a/bad.json", "{nope")
    put(f"{tmp_path}/a/3.error.json", '{"n": 3}')
    assert sorted(r["n"] for r in files.json_tree(spark, str(tmp_path), "n int").collect()) == [1, 2]


def test_ndjson_and_manifest(spark, tmp_path):
    put(f"{tmp_path}/s1.json", '{"n": 1, "tag": "x"}\n{"n": 2}\n')
    assert [r["n"] for r in files.ndjson(spark, f"{tmp_path}/s1.json", "n int, tag string", '"tag"').collect()] == [1]
    put(f"{tmp_path}/m.json", json.dumps({"shards": [{"path": "s1.json", "count": 2}, {"path": "gone.json", "count": 1}]}))
    with pytest.raises(FileNotFoundError):
        files.manifest(spark, f"{tmp_path}/m.json", str(tmp_path), "n int")
    assert files.manifest(spark, f"{tmp_path}/m.json", str(tmp_path), "n int", strict=False).count() == 2
    put(f"{tmp_path}/m2.json", json.dumps({"shards": [{"path": "../s1.json", "count": 2}]}))
    with pytest.raises(ValueError):
        files.manifest(spark, f"{tmp_path}/m2.json", str(tmp_path), "n int")


def test_checked_shard(spark, tmp_path):
    k = hashlib.sha256(b"t").hexdigest()
    body = json.dumps({"sha256": k, "text": "t", "stored_char_count": 1}) + "\n"
    put(f"{tmp_path}/x.ndjson", body)
    keys = spark.createDataFrame([(k,)], "sha256 string")
    digest = hashlib.sha256(body.encode()).hexdigest()
    assert files.checked_shard(spark, f"{tmp_path}/x.ndjson", len(body), digest, keys).count() == 1
    with pytest.raises(ValueError):
        files.checked_shard(spark, f"{tmp_path}/x.ndjson", len(body), "0" * 64, keys)
    with pytest.raises(ValueError):
        files.checked_shard(spark, f"{tmp_path}/x.ndjson", len(body), digest, keys.limit(0))


def test_ranked_shards_and_guards(spark):
    df = spark.createDataFrame([(1, "c"), (2, "c"), (3, "c")], "o int, commit string")
    assert files.ranked_shards(df, "o", "commit", 3) is df
    with pytest.raises(ValueError):
        files.ranked_shards(df.where("o <> 2"), "o", "commit", 2)
    assert checks.require(df, F.col("o") > 0, "bad").count() == 3
    with pytest.raises(Exception, match="bad row"):
        checks.require(df, F.col("o") > 1, "bad row").collect()
    assert [x.count() for x in checks.quarantine(df, F.col("o") > 1)] == [2, 1]
    assert checks.same_keys(df, df, "o") and not checks.same_keys(df, df.where("o=1"), "o")
    assert checks.headline(spark.createDataFrame([(5,)], "n long"), "n") == 5
    with pytest.raises(ValueError):
        checks.headline(spark.createDataFrame([(0,)], "n long"), "n")


def test_bucketed_lookup_and_publish(spark, tmp_path):
    df = spark.createDataFrame([(f"Person {i} 😀", i) for i in range(50)], "name string, i int")
    at = f"{tmp_path}/lookup"
    sinks.bucketed(df, at, "people", "name", 16)
    got = sinks.lookup(spark, at, "people", "Person 7 😀", "name", 16)
    assert [r["i"] for r in got.collect()] == [7]
    sinks.bucketed(df.where("i < 5"), at, "people", "name", 16)
    assert spark.read.parquet(sinks.current(spark, at)).count() == 5
    assert sinks.lookup_status(spark, at, "people", "Person 3 😀", "name", 16) == "found"
    assert sinks.lookup_status(spark, at, "people", "Person 30 😀", "name", 16) == "not_found"
    assert sinks.lookup_status(spark, f"{at}-none", "people", "x", "name", 16) == "data_state_error"
    sinks.bucketed(df.where("i < 3"), at, "people", "name", 16, salts=3)
    kept = [x for x in os.listdir(at) if x.startswith("data-")]
    assert len(kept) == 2 and spark.read.parquet(sinks.current(spark, at)).count() == 3  # the last two versions
    sinks.csv(df, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(sinks.current(spark, f"{tmp_path}/csv")).count() == 50
    sinks.partitioned(df.withColumn("p", df["i"] % 2), f"{tmp_path}/parts", "p", salts=2)
    sinks.spooled(df.withColumn("p", df["i"] % 2), f"{tmp_path}/spool", "p")
    assert spark.read.json(sinks.current(spark, f"{tmp_path}/spool")).count() == spark.read.parquet(sinks.current(spark, f"{tmp_path}/parts")).count() == 50


def test_ndjson_skips_what_is_no_object(spark, tmp_path):
    (tmp_path / "x.ndjson").write_text('{"a":1}\n{"a":\n[1]\n7\n\n {"a":2}\n')
    assert sorted(r["a"] for r in files.ndjson(spark, str(tmp_path), "a int").collect()) == [1, 2]


def test_stream_equals_batch(spark, tmp_path):
    src, table = f"{tmp_path}/in", f"{tmp_path}/facet"
    df = spark.createDataFrame([(f"k{i % 3}", f"c{i % 7}") for i in range(40)], "k string, c string")
    df.repartition(4).write.parquet(src)
    for _ in range(2):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
        ingest.facet_stream(stream, table, f"{tmp_path}/cp", "k", "c").awaitTermination()
    got = ingest.facet_counts(spark.read.parquet(table), "k", "c")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ingest.facet_counts(df, "k", "c").collect()))
    assert ingest.yearly_counts(spark.readStream.schema("ts timestamp, k string").parquet(src), "ts", "k").isStreaming


def test_one_record_with_root_fallback(spark, tmp_path):
    put(f"{tmp_path}/b/CGC/20/C1.json", '{"n": 1}')
    put(f"{tmp_path}/b/C2.json", '{"n": 2}')
    roots = [f"{tmp_path}/a", f"{tmp_path}/b"]
    assert files.one_record(spark, roots, "CGC/20/C1.json", "C1", "n int").first()["n"] == 1
    assert files.one_record(spark, roots, "CGC/20/C2.json", "C2", "n int").first()["n"] == 2
    assert files.one_record(spark, roots, "CGC/20/C3.json", "C3", "n int") is None


def test_materialize_all_or_nothing(spark, tmp_path):
    def shard(name, texts, total=None):
        body = "".join(json.dumps({"sha256": hashlib.sha256(t.encode()).hexdigest(), "text": t, "truncated": t == "cut"}) + "\n" for t in texts)
        put(f"{tmp_path}/{name}.ndjson", body)
        return {"name": name, "path": f"{tmp_path}/{name}.ndjson", "bytes": total or len(body), "sha256": hashlib.sha256(body.encode()).hexdigest()}

    def index(*rows):
        return spark.createDataFrame([(hashlib.sha256(t.encode()).hexdigest(), s) for t, s in rows], "sha256 string, shard string")

    good = [shard("s1", ["a", "b"]), shard("s2", ["c"])]
    every = index(("a", "s1"), ("b", "s1"), ("c", "s2"))
    assert sorted(r["text"] for r in files.materialize(spark, every, good, f"{tmp_path}/out").collect()) == ["a", "b", "c"]
    for bad_index, shards in [
        (index(("a", "s1"), ("b", "s1"), ("c", "s2"), ("a", "s2")), good), (index(("a", "s9")), good), (index(("a", "s1"), ("c", "s2")), good),
        (every, [shard("s1", ["a", "b"], 1), good[1]]), (index(("cut", "s3")), [shard("s3", ["cut"])]),
    ]:
        with pytest.raises(ValueError):
            files.materialize(spark, bad_index, shards, f"{tmp_path}/never")
    assert not os.path.exists(f"{tmp_path}/never")


def test_observed_rows_and_stream_progress(spark, tmp_path):
    df, seen = ingest.observed(spark.createDataFrame([("ab",), ("c",)], "t string"), "read", "t")
    assert df.count() == 2 and seen.get == {"rows": 2, "bytes": 3}
    src = f"{tmp_path}/in"
    spark.range(30).write.parquet(src)
    progress = ingest.Progress()
    spark.streams.addListener(progress)
    try:
        q = spark.readStream.schema("id long").parquet(src).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        for _ in range(100):
            if progress.rows.get(str(q.id)) == 30:
                break
            __import__("time").sleep(0.1)
        assert progress.rows[str(q.id)] == 30
    finally:
        spark.streams.removeListener(progress)


def test_facet_tables(spark, tmp_path):
    from recordlake.operators import builds

    rows = spark.createDataFrame([("Ann Lake", "c1"), ("ann lake", "c2"), ("Bob", "c3")], "name string, c string")
    t = builds.build_facet(rows, "name", "c", least=2)
    sinks.facet_tables(t["list"], t["search"], t["cases"], f"{tmp_path}/f")
    at = lambda n: sinks.current(spark, f"{tmp_path}/f/{n}")
    assert [r["label"] for r in spark.read.json(at("list")).collect()] == ["Ann Lake"]
    assert spark.read.parquet(at("search")).count() == 3 and spark.read.parquet(at("cases")).count() == 3


def test_index_and_profiles_refuse_bad_rows(spark):
    from recordlake.operators import builds

    rows = spark.createDataFrame([("C1", "t", 5.0, 1), ("c-1", "t", 5.0, 2), ("C2", "t", -1.0, 1), ("C3", "t", 1.0, 0)], "case_number string, case_title string, judgment_amount double, rank int")
    assert {r["fault"]: r["n"] for r in builds.ranking_faults(rows).collect()} == {"amount": 1, "rank": 1, "repeated number": 1}
    with pytest.raises(ValueError):
        builds.judgment_index(rows, 4)
    with pytest.raises(ValueError):
        builds.judgment_index(rows.where("case_number = 'C1'"), 2)
    bad = spark.createDataFrame([(1, 3, 2, 10.0, 4.0), (1, 3, 2, 10.0, 4.0)], "bar int, judgment_count int, case_count int, total_amount double, largest_amount double")
    with pytest.raises(ValueError, match="0 invalid summaries, 1 repeated"):
        builds.attorney_profiles(bad, "bar")
    clash = spark.createDataFrame([("A", "C1"), ("B", "C1")], "label string, cases string")
    categories = spark.createDataFrame([("r", "A", 0), ("r", "B", 1)], "parent_id string, label string, pos int")
    nodes = spark.createDataFrame([("r", None, "R")], "id string, parent_id string, label string")
    with pytest.raises(ValueError, match="several categories"):
        builds.enrich_matters(spark.createDataFrame([("C1",)], "case_number string"), clash, categories, nodes)
