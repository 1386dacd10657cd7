"""Published shards as Spark data sources: fetched, verified and parsed by the executors.

    spark.dataSource.register(ShardSource)
    spark.read.format("published_shards").option("shards", json).schema(schema).load()
    spark.readStream.format("published_lines").option("manifest", path).schema(...).load()

The batch source has one partition a shard.  A task fetches its shard (a path or an
http address) in blocks, tries again where the answer is worth it, and gives its lines as Arrow
batches; a shard whose bytes or digest are not as announced fails the job, so that a write commits all
or nothing.  The digest is known at a shard's end, when its rows have gone on already: they
only count once the job commits.

The streaming source reads lines of growing shards by byte offsets, at most
`maxBytesPerTrigger` a batch and shard; a batch may end inside a shard and, after a restart, goes on
there.  A line belongs to the batch that its first byte falls in; a last line without its end waits.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .http import RETRYABLE, wait_before

BLOCK = 1 << 20
ROWS = 1000


def _remote(path: str) -> bool:
    return path.startswith(("http://", "https://"))


def _stored(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of an address such as hdfs://.., s3://.. or file:/.."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def opened(path: str, start: int = 0, attempts: int = 6, timeout: float = 120.0, sleep=time.sleep):
    """A file object from byte `start` on, of a path, a store's address or an http one; an answer that is worth another try is tried again."""
    if not _remote(path):
        at = _stored(path) if ":/" in path else None
        f = at[0].open_input_file(at[1]) if at else open(path, "rb")  # noqa: SIM115
        f.seek(start)
        return f
    for k in range(attempts):
        try:
            r = urllib.request.urlopen(urllib.request.Request(path, headers={"Range": f"bytes={start}-"} if start else {}), timeout=timeout)
            if start and r.status != 206:
                r.read(start)  # a server without ranges
            return r
        except urllib.error.HTTPError as e:
            if e.code == 416:
                return open(os.devnull, "rb")
            if e.code not in RETRYABLE or k == attempts - 1:
                raise
            sleep(wait_before(k, e.headers.get("Retry-After") if e.headers else None))
        except (urllib.error.URLError, TimeoutError):
            if k == attempts - 1:
                raise
            sleep(wait_before(k, None))
    raise RuntimeError("unreachable")


def blocks(path: str, attempts: int = 6, sleep=time.sleep) -> Iterator[bytes]:
    """The bytes of a shard; where a transfer breaks off it is taken up at the byte reached."""
    done, k = 0, 0
    while True:
        try:
            with opened(path, done, attempts, sleep=sleep) as f:
                want = f.headers.get("Content-Length") if hasattr(f, "headers") else None
                upto = None if want is None else done + int(want)
                while data := f.read(BLOCK):
                    done += len(data)
                    yield data
            if upto is None or done >= upto:
                return
            raise ConnectionError(f"{path} ended at byte {done} of {upto}")
        except (ConnectionError, TimeoutError):
            k += 1
            if k >= attempts:
                raise
            sleep(wait_before(k, None))


def size_of(path: str) -> int:
    if not _remote(path):
        at = _stored(path) if ":/" in path else None
        return at[0].get_file_info(at[1]).size if at else os.path.getsize(path)
    with urllib.request.urlopen(urllib.request.Request(path, method="HEAD"), timeout=120) as r:
        return int(r.headers["Content-Length"])


def lines(data: Iterator[bytes]) -> Iterator[bytes]:
    rest = b""
    for block in data:
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


def batches_of(rows: Iterator[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    names, values = [], []
    for name, line in rows:
        names.append(name)
        values.append(line.decode("utf-8", "replace"))
        if len(values) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string())], names=["shard", "value"])
            names, values = [], []
    if values:
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string())], names=["shard", "value"])


class Shard(InputPartition):
    def __init__(self, name: str, path: str, size: int | None, digest: str | None):
        super().__init__(name)
        self.name, self.path, self.size, self.digest = name, path, size, digest


class ShardReader(DataSourceReader):
    def __init__(self, shards: list[dict]):
        self.shards = shards

    def partitions(self):
        return [Shard(s["name"], s["path"], s.get("bytes"), s.get("sha256")) for s in self.shards] or [Shard("", os.devnull, None, None)]

    def read(self, partition: Shard):
        seen, size = hashlib.sha256(), 0

        def checked():
            nonlocal size
            for data in blocks(partition.path):
                seen.update(data)
                size += len(data)
                yield data
            if partition.size not in (None, size) or partition.digest not in (None, seen.hexdigest()):
                raise ValueError(f"shard {partition.name!r} does not match its size and digest")

        yield from batches_of((partition.name, x) for x in lines(checked()) if x.strip())


class ShardSource(DataSource):
    """Lines (shard, value) of announced shards; option `shards`: JSON list of name, path, bytes, sha256."""

    @classmethod
    def name(cls):
        return "published_shards"

    def schema(self):
        return "shard string, value string"

    def reader(self, schema):
        return ShardReader(json.loads(self.options["shards"]))


class Span(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def whole_lines(path: str, start: int, end: int) -> Iterator[bytes]:
    """The lines whose first byte is in [start, end)."""
    at = max(0, start - 1)
    with opened(path, at) as f:
        rest, begin = b"", at
        if start:  # a line that began before is another batch's
            while (cut := rest.find(b"\n")) < 0:
                if not (data := f.read(BLOCK)):
                    return
                rest += data
            begin, rest = at + cut + 1, rest[cut + 1 :]
        while begin < end:
            while (cut := rest.find(b"\n")) < 0:
                if not (data := f.read(BLOCK)):
                    return  # without its end it waits
                rest += data
            yield rest[:cut]
            begin, rest = begin + cut + 1, rest[cut + 1 :]


def last_end(path: str, size: int, start: int) -> int:
    """One past the last line end in [start, size), else `start`."""
    at = size
    while at > start:
        lo = max(start, at - BLOCK)
        with opened(path, lo) as f:
            data = f.read(at - lo)
        if (cut := data.rfind(b"\n")) >= 0:
            return lo + cut + 1
        at = lo
    return start


class LineStream(DataSourceStreamReader):
    def __init__(self, manifest: str, most: int):
        self.manifest, self.most, self.reached = manifest, most, None

    def _paths(self) -> list[str]:
        with opened(self.manifest) as f:
            listed = json.loads(f.read())["shards"]
        base = self.manifest.rpartition("/")[0]
        return [s["path"] if ":/" in s["path"] or s["path"].startswith("/") else f"{base}/{s['path']}" for s in listed]

    def initialOffset(self):
        self.reached = {}
        return {}

    def latestOffset(self):
        """The last whole line of every shard, or `most` bytes beyond what has been read of it.

        Spark does not say here where a restarted stream stands, so its first batch has no limit.
        """
        now = dict(self.reached or {})
        for p in self._paths():
            start = now.get(p, 0)
            upto = last_end(p, max(start, size_of(p)), start)
            if upto > start:
                now[p] = upto if self.reached is None else min(upto, start + self.most)
        return now

    def partitions(self, start, end):
        """Spans of at most `most` bytes."""
        self.reached = dict(end)
        cuts = {p: [*range(start.get(p, 0), z, self.most), z] for p, z in end.items()}
        return [Span(p, a, z) for p, c in cuts.items() for a, z in zip(c, c[1:])]

    def read(self, partition: Span):
        yield from batches_of((partition.path, x) for x in whole_lines(partition.path, partition.start, partition.end) if x.strip())

    def commit(self, end):
        pass


class LineSource(DataSource):
    """A stream of lines (shard, value) of the shards that a manifest lists; it is read again before every batch."""

    @classmethod
    def name(cls):
        return "published_lines"

    def schema(self):
        return "shard string, value string"

    def streamReader(self, schema):
        return LineStream(self.options["manifest"], int(self.options.get("maxBytesPerTrigger", 64 << 20)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShardSource)
    spark.dataSource.register(LineSource)


def read_shards(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """(shard, value): the lines of announced shards (name, path, bytes, sha256), fetched by the executors."""
    register(spark)
    return spark.read.format("published_shards").option("shards", json.dumps(shards)).load()


def stream_lines(spark: SparkSession, manifest: str, most: int = 64 << 20) -> DataFrame:
    register(spark)
    return spark.readStream.format("published_lines").option("manifest", manifest).option("maxBytesPerTrigger", str(most)).load()
