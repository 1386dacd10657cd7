"""Readers: trees of JSON, NDJSON with a substring filter, manifests, ranked shards, hash-checked text."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checks import differences, duplicates
from .shards import read_shards


def json_tree(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All *.json below `path` but *.error.json; a file that does not parse is skipped. Adds file."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    raw = raw.withColumn("file", F.input_file_name()).where(~F.col("file").endswith(".error.json"))
    good = raw.where(F.try_parse_json("value").isNotNull())
    return good.select(F.from_json("value", schema).alias("r"), "file").where("r is not null").select("r.*", "file")


def ndjson(spark: SparkSession, path: str, schema: str, mentions: str | None = None) -> DataFrame:
    """Lines as rows; lines without `mentions` are not parsed, and lines that are no JSON object are skipped."""
    lines = spark.read.text(path)
    if mentions:
        lines = lines.where(F.col("value").contains(mentions))
    lines = lines.where(F.ltrim("value").startswith("{") & F.try_parse_json("value").isNotNull())
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).where("r is not null").select("r.*")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, through Spark's readers."""
    return spark.read.text(path, wholetext=True).first()[0]


def manifest(spark: SparkSession, path: str, base: str, schema: str, strict: bool = True) -> DataFrame:
    """Rows of the shards a manifest lists; `strict` fails on a missing or miscounted shard."""
    listed = json.loads(read_text(spark, path))["shards"]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there, want = [], 0
    for s in listed:
        if not s["path"] or ".." in s["path"].split("/"):
            raise ValueError(f"unsafe path {s['path']!r}")
        p = jvm.org.apache.hadoop.fs.Path(f"{base}/{s['path']}")
        if p.getFileSystem(conf).exists(p):
            there.append(f"{base}/{s['path']}")
            want += s["count"]
        elif strict:
            raise FileNotFoundError(s["path"])
    if not there:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).json(there)
    if strict and rows.count() != want:
        raise ValueError("shards do not hold the rows that the manifest counts")
    return rows


def ranked_shards(rows: DataFrame, ordinal: str, commit: str, expected: int) -> DataFrame:
    """`rows`, if their ordinals are 1..expected and all of one commit."""
    a = rows.agg(F.count(F.lit(1)), F.min(ordinal), F.max(ordinal), F.count_distinct(ordinal), F.count_distinct(commit)).first()
    if tuple(a) != (expected, 1, expected, expected, 1):
        raise ValueError(f"ranked shards are not contiguous: {tuple(a)}")
    return rows


def checked_shard(spark: SparkSession, path: str, size: int, digest: str, keys: DataFrame) -> DataFrame:
    """(sha256, text) of an NDJSON shard whose bytes, digest and keys are as announced."""
    f = spark.read.format("binaryFile").load(path).select("length", F.sha2("content", 256).alias("d")).first()
    if f is None or (f["length"], f["d"]) != (size, digest):
        raise ValueError("shard does not match its size and digest")
    rows = ndjson(spark, path, "sha256 string, text string, truncated boolean, stored_char_count long")
    if duplicates(rows, "sha256").limit(1).count() or differences(keys, rows, "sha256").limit(1).count():
        raise ValueError("shard's keys are not the expected ones")
    return rows.where(valid_sidecar("sha256"))


def valid_sidecar(expected: str):
    """Digest of 64 hex digits as expected, text that is not blank, whole and of the stored length."""
    return (
        F.col("sha256").rlike("^[0-9a-f]{64}$") & (F.col("sha256") == F.col(expected)) & (F.trim("text") != "")
        & ~F.coalesce("truncated", F.lit(False)) & (F.col("stored_char_count").isNull() | (F.col("stored_char_count") == F.length("text")))
    )


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def one_record(spark: SparkSession, roots: list[str], shard: str, name: str, schema: str) -> DataFrame | None:
    """The record of the first place that has it: under every root the shard's path, then the flat one; else None."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for root in roots:
        for at in dict.fromkeys((f"{root}/{shard}", f"{root}/{name}.json")):
            p = jvm.org.apache.hadoop.fs.Path(at)
            if p.getFileSystem(conf).exists(p):
                good = spark.read.text(at, wholetext=True).where(F.try_parse_json("value").isNotNull())
                return good.select(F.from_json("value", schema).alias("r")).select("r.*")
    return None


def materialize(spark: SparkSession, index: DataFrame, shards: list[dict], path: str) -> DataFrame:
    """Checked texts of an index (sha256, shard) from its shards, written under `path` only if all are complete.

    shards: name, path (or http address), bytes, sha256 of each.  The executors fetch and
    check all shards in one job, which writes beside `path`; the keys are compared on what was written, and
    only then the folder is renamed.  A digest in two shards, a shard that does
    not match its announcement or its keys, and a text that is missing or damaged are errors.
    """
    if duplicates(index.distinct(), "sha256").limit(1).count():
        raise ValueError("a text is listed in two shards")
    known = {s["name"] for s in shards}
    unknown = index.select("shard").distinct().where(~F.col("shard").isin(*known)).limit(1).collect()
    if unknown:
        raise ValueError(f"unknown shard {unknown[0][0]!r}")
    jvm = spark.sparkContext._jvm
    staged, final = jvm.org.apache.hadoop.fs.Path(f"{path}.staged-{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(path)
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(final):
        raise FileExistsError(path)
    fields = "sha256 string, text string, truncated boolean, stored_char_count long"
    lines = read_shards(spark, shards).where(F.ltrim("value").startswith("{") & F.try_parse_json("value").isNotNull())
    rows = lines.select("shard", F.from_json("value", fields).alias("r")).select("shard", "r.*")
    try:
        try:
            rows.write.parquet(staged.toString())
        except Exception as e:
            if "does not match its size and digest" in str(e):
                raise ValueError("shard does not match its size and digest") from e
            raise
        got = spark.read.schema(rows.schema).parquet(staged.toString())
        both = index.select("sha256", "shard").distinct().withColumn("wanted", F.lit(1)).join(got.withColumn("there", valid_sidecar("sha256")), ["sha256", "shard"], "full")
        bad = both.groupBy("sha256", "shard").agg(F.count("wanted").alias("w"), F.count_if("there").alias("t"), F.count(F.lit(1)).alias("n")).where("w = 0 or t <> 1 or n <> 1").limit(1).collect()
        if bad:
            raise ValueError(f"some texts are missing, damaged or not expected, such as {bad[0]['sha256']} of shard {bad[0]['shard']}")
        if not fs.rename(staged, final):
            raise OSError(f"{path} could not be written")
    finally:
        fs.delete(staged, True)
    return spark.read.schema(rows.schema).parquet(path).drop("shard")
