"""Writers: bucketed lookups, bounded parts, facets as JSON, CSV; all published by a pointer file."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, SparkRuntimeException as SparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import bucket_name, fnv1a32


POINTER = "CURRENT"
#: What Spark says of a table without files, without schema, without the column, or with unreadable files.
DAMAGED = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "UNRESOLVED_COLUMN", "FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER", "is not a Parquet file", "FileNotFoundException")


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Makes the finished folder `version` below `path` the current one.

    The pointer file is written beside the old one and renamed over it, so
    readers see the old folder or the new one, never none.  Older folders go
    afterwards, but for the one that was current until now (it may be read).
    """
    jvm, base, fs = _hadoop(spark, path)
    before = current(spark, path, missing_ok=True)
    staged = jvm.org.apache.hadoop.fs.Path(base, f".{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(staged)
    out.write(version.encode())
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(staged), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(base, POINTER)), how)
    for s in fs.listStatus(base):
        name = s.getPath().getName()
        if s.isDirectory() and name.startswith("data-") and name != version and (before is None or not before.endswith(f"/{name}")):
            fs.delete(s.getPath(), True)


def current(spark: SparkSession, path: str, missing_ok: bool = False) -> str | None:
    """The folder that the pointer below `path` names; for a table of a set, its folder in the set's current one."""
    jvm, _, fs = _hadoop(spark, path)
    base, _, name = path.rstrip("/").rpartition("/")
    for at, below in ((path, ""), (base, f"/{name}")):
        pointer = jvm.org.apache.hadoop.fs.Path(at or "/", POINTER)
        if fs.exists(pointer):
            return f"{at}/{spark.read.text(pointer.toString(), wholetext=True).first()[0]}{below}"
    if missing_ok:
        return None
    raise FileNotFoundError(f"{path} has not been published")


def _staged(df: DataFrame, path: str, write) -> None:
    version = f"data-{uuid.uuid4().hex}"
    write(f"{path}/{version}")
    publish(df.sparkSession, path, version)


def bucketed(df: DataFrame, path: str, kind: str, key: str, buckets: int = 256, salts: int = 1) -> None:
    """Parquet partitioned by the lookup bucket of the key; `salts` tasks write each bucket."""
    b = df.withColumn("bucket", bucket_name(fnv1a32(F.concat(F.lit(f"{kind}:"), F.col(key))) % buckets, buckets))
    _staged(df, path, lambda at: b.repartition(buckets * salts, "bucket", _salt(b, salts)).write.partitionBy("bucket").parquet(at))


def _salt(df: DataFrame, salts: int):
    """The same for a row whenever its task is run."""
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts))


def lookup(spark: SparkSession, path: str, kind: str, key: str, column: str, buckets: int = 256) -> DataFrame:
    """The rows of one key; only its bucket is read."""
    h = 2166136261
    for unit in memoryview(f"{kind}:{key}".encode("utf-16-le")).cast("H"):
        h = ((h ^ unit) * 16777619) & 0xFFFFFFFF
    name = format(h % buckets, f"0{max(2, len(format(buckets - 1, 'x')))}x")
    at = current(spark, path)
    found = spark.read.parquet(at).schema
    typed = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "bucket" else f for f in found])  # 00 and 0d are no numbers
    return spark.read.schema(typed).parquet(at).where((F.col("bucket") == name) & (F.col(column) == key))


def lookup_status(spark: SparkSession, path: str, kind: str, key: str, column: str, buckets: int = 256) -> str:
    """found, not_found, or data_state_error where the table is absent or damaged; other errors are errors."""
    try:
        return "found" if lookup(spark, path, kind, key, column, buckets).limit(1).count() else "not_found"
    except FileNotFoundError:
        return "data_state_error"
    except (AnalysisException, SparkException, Py4JJavaError) as e:
        if any(x in str(e) for x in DAMAGED):
            return "data_state_error"
        raise


def partitioned(df: DataFrame, path: str, *keys: str, most: int = 25000, salts: int = 1) -> None:
    """Parquet partitioned by the keys; `salts` tasks write a partition, so a hot one is no single task's."""
    _staged(df, path, lambda at: df.repartition(*keys, _salt(df, salts)).write.option("maxRecordsPerFile", most).partitionBy(*keys).parquet(at))


def facet_order(label: str = "label", collation: str | None = None) -> list:
    """Most frequent first, then by label: by code points, or as people sort (collation "UNICODE"), then by code points."""
    own = [F.collate(F.col(label), collation).asc()] if collation else []
    return [F.col("case_count").desc(), *own, F.col(label).asc()]


def facet_json(facet: DataFrame, path: str, collation: str | None = None) -> None:
    """One JSON object a line, most frequent first."""
    _staged(facet, path, lambda at: facet.orderBy(*facet_order(collation=collation)).write.json(at))


def publish_set(spark: SparkSession, path: str, tables: dict) -> dict[str, int]:
    """Writes several tables as one build and makes all of them current by one pointer; returns their rows.

    tables: name -> (DataFrame, write(DataFrame, folder)).  The build's folder also has
    `_manifest` (Parquet: name, path, bytes, sha256 of every file) and `_rows` (name, rows).
    Rows are counted while they are written.  Readers see all tables of one build, or
    of the next one.
    """
    version = f"data-{uuid.uuid4().hex}"
    counts = {}
    for name, (df, write) in tables.items():
        seen = Observation(f"rows of {name}")
        write(df.observe(seen, F.count(F.lit(1)).alias("rows")), f"{path}/{version}/{name}")
        counts[name] = seen.get["rows"]
    _files(spark, f"{path}/{version}", list(tables)).write.parquet(f"{path}/{version}/_manifest")
    spark.createDataFrame([(k, v) for k, v in counts.items()], "name string, rows long").coalesce(1).write.parquet(f"{path}/{version}/_rows")
    publish(spark, path, version)
    return counts


def _files(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(name, path below the folder, bytes, sha256) of the files of a build, read and hashed by Spark."""
    parts = None
    for n in names:
        f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[!._]*").load(f"{folder}/{n}")
        f = f.select(F.lit(n).alias("name"), F.regexp_extract("path", f"/{folder.rpartition('/')[2]}/(.*)$", 1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        parts = f if parts is None else parts.unionByName(f)
    return parts


def set_faults(spark: SparkSession, path: str) -> DataFrame:
    """Files of the current build that are missing, additional or not as its manifest says."""
    at = current(spark, path)
    want = spark.read.parquet(f"{at}/_manifest")
    names = [r["name"] for r in spark.read.parquet(f"{at}/_rows").collect()]  # one row a table
    return want.exceptAll(_files(spark, at, names)).withColumn("fault", F.lit("missing or changed")).union(_files(spark, at, names).exceptAll(want).withColumn("fault", F.lit("not announced")))


def table_rows(spark: SparkSession, path: str) -> dict[str, int]:
    return {r["name"]: r["rows"] for r in spark.read.parquet(f"{current(spark, path)}/_rows").collect()}  # one row a table


def facet_tables(facet: DataFrame, search: DataFrame, cases: DataFrame, path: str, collation: str | None = None) -> dict[str, int]:
    """The three tables of a facet under `path`, published together: list (picker), search (every spelling) and cases (record sets)."""
    bucketed_cases = cases.withColumn("bucket", bucket_name(fnv1a32(F.col("facet_key")) % 256, 256))
    return publish_set(facet.sparkSession, path, {
        "list": (facet.orderBy(*facet_order(collation=collation)), lambda df, at: df.write.json(at)),
        "search": (search, lambda df, at: df.write.parquet(at)),
        "cases": (bucketed_cases, lambda df, at: df.repartition("bucket").write.partitionBy("bucket").parquet(at)),
    })


def spooled(df: DataFrame, path: str, bucket: str) -> None:
    """JSON rows of every bucket, one folder each; Spark's shuffle spills what does not fit."""
    _staged(df, path, lambda at: df.repartition(bucket).sortWithinPartitions(bucket).write.partitionBy(bucket).json(at))


def csv(df: DataFrame, path: str) -> None:
    _staged(df, path, lambda at: df.write.option("header", True).csv(at))
