"""Scratch tables in the folder that all executors share, and Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

_HELD: dict = {}  # of this worker process: what outlives a task, with its stage


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


#: Rows that a Python worker gets at once where the session does not say: texts are long, 10,000 of them are many MB.
BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def make_importable(spark: SparkSession) -> None:
    """Ships this package to the Python workers, once a context: Spark serves a zip from the driver."""
    if spark.conf.get(BATCH_ROWS[0], None) is None:
        spark.conf.set(*BATCH_ROWS)
    sc = spark.sparkContext
    if getattr(sc, "_recordlake_shipped", False):
        return
    package = os.path.join(ROOT, "recordlake")
    at = os.path.join(tempfile.mkdtemp(prefix="recordlake-"), "recordlake.zip")  # read by the driver only
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, files in os.walk(package):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, ROOT))
    sc.addPyFile(at)
    sc._recordlake_shipped = True


def shipped(spark: SparkSession, path: str):
    """A broadcast of a model file of the driver (a few MB, whatever the data)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="recordlake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Scratch:
    """Tables under one new folder of the shared directory.

    A table is written by Spark's committer and read back with its own schema,
    so that its lineage starts at files every executor can read.  The folder goes
    when the driver's JVM ends, or by close() once no DataFrame reads it.
    """

    def __init__(self, spark: SparkSession):
        make_importable(spark)
        self.spark = spark
        self.at = f"{shared_dir(spark)}/recordlake-{uuid.uuid4().hex}"
        fs, path = self._file_system(self.at)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _file_system(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def path(self, name: str) -> str:
        return f"{self.at}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        for name in names:
            fs, path = self._file_system(self.path(name))
            fs.delete(path, True)

    def close(self) -> None:
        fs, path = self._file_system(self.at)
        fs.delete(path, True)


#: A membership filter: BUCKETS bitmaps of BITMAP_BITS bits (the size Spark's function makes), 8 MB in all.
BUCKETS, BITMAP_BITS = 2048, 1 << 15


class Filter:
    """A Bloom filter (one hash) of a column's values, of fixed size, built and read by Spark's bitmap functions.

    It keeps rows without a partner out of a shuffle; what it lets through is
    still joined, so a filter that fills up costs time, not results.
    """

    def __init__(self, scratch: Scratch, values: DataFrame, column: str, name: str):
        at = values.select(self._place(F.col(column)).alias("at"))
        bits = at.groupBy(self._bucket(F.col("at")).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(BITMAP_BITS))).alias("bits"))
        self.bits = scratch.table(bits, name)

    @staticmethod
    def _place(value: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit("member"), value), F.lit(BUCKETS * BITMAP_BITS))

    @staticmethod
    def _bucket(at: Column) -> Column:
        return F.shiftright(at, 15).cast("int")

    def mark(self, rows: DataFrame, value: Column, name: str) -> DataFrame:
        """`rows` with a boolean column: false means that `value` is surely not a member."""
        at = self._place(value)
        bit = F.pmod(at, F.lit(BITMAP_BITS)).cast("int")
        mine = self.bits.select(F.col("bucket").alias(f"{name}_bucket"), F.col("bits").alias(f"{name}_bits"))
        joined = rows.join(F.broadcast(mine), self._bucket(at) == F.col(f"{name}_bucket"), "left")  # at most BUCKETS rows
        byte = F.conv(F.hex(F.substring(F.col(f"{name}_bits"), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8))) == 1, F.lit(False))
        return joined.select(*rows.columns, hit.alias(name))


def carried(names: list[str]) -> Column:
    """A struct of the columns `names`, so that no name of theirs meets one of an operator's."""
    fields = [F.col(quoted(c)) for c in names] or [F.lit(0).alias("none")]
    return F.struct(*fields).alias("carried")


def unpacked(names: list[str]) -> list[Column]:
    """The columns `names` of the struct."""
    return [F.col("carried").getField(c).alias(c) for c in names]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    make_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def null_safe(left: DataFrame, right: DataFrame, names: list[str]):
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the text of each holds about `limit` bytes (or one row)."""
    leave_behind()
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        at, total = 0, 0
        for i in range(n):
            if total and total + sizes[i] > limit:
                yield b.slice(at, i - at)
                at, total = i, 0
            total += int(sizes[i])
        yield b.slice(at, n - at)
    give_back()


def _stage() -> int | None:
    task = TaskContext.get()
    return task and task.stageId()


def held(name, make):
    """make(), kept in this worker process for the tasks of one stage."""
    leave_behind()
    if name not in _HELD:
        _HELD[name] = (_stage(), make())
    return _HELD[name][1]


def leave_behind() -> None:
    """Drops what this worker process holds for another stage, before a task takes memory of its own."""
    old = [k for k, (stage, _) in _HELD.items() if stage != _stage()]
    for k in old:
        del _HELD[k]
    if old:
        give_back()


def give_back() -> None:
    """Returns memory that a Python worker has freed to the system; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
