"""WARC archives with revisit resolution.

Only headers (key, payload digest, length) are shuffled by digest.  Every record
is a gzip member of its own, as readers of compressed archives expect; a task
packs members into archives of a given size, one row each, and Spark's text
writer writes one row a file, so its commit protocol makes the files safe under
lost executors.  (Behind each row the writer puts a separator; it is an empty
gzip member.)

Defined results: a null payload is an empty one; a null key loses every tie
against a number; rows that repeat the response's key and payload are responses
too, with record ids of their own (revisits refer to the first of them); a
record longer than an archive is an archive; other columns of the input are
ignored, whatever their names.  An empty table gives no record.  The table must
give the same rows in the same partitions when it is read twice, as a scan does.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Filter, Scratch, partitions, quoted, session, slices

SEPARATOR = "\r\n\r\n"
EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_key long, target_uri string, record_type string, payload_digest string, payload_bytes long, refers_to long"


def headers(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """One row per record: rk and place (never null), record_key, target_uri, body, digest, length."""
    body = F.coalesce(F.col(quoted(payload)), F.lit(""))
    return (
        pages.select(F.col(quoted(key)).cast("long").alias("record_key"), F.col(quoted(url)).alias("target_uri"), body.alias("body"), F.monotonically_increasing_id().alias("place"))
        .withColumn("digest", F.sha1(F.col("body").cast("binary")))
        .withColumn("length", F.octet_length("body").cast("long"))
        .withColumn("rk", F.concat(F.coalesce(F.col("record_key").cast("string"), F.lit("none")), F.lit("/"), F.col("digest")))
    )


def resolve_revisits(records: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """(rk, refers_to, refers_place) of the records that repeat an original's payload.

    Headers are dealt by digest and salt.  The original of a digest is found from
    one row per salt and goes back to one row per salt, so a digest that a third
    of all rows share is spread over as many tasks as there are salts.
    """
    salts = partitions(session(records))
    heads = records.where(F.col("length") >= min_bytes).select("rk", "record_key", "digest", "place")
    heads = heads.withColumn("salt", F.pmod(F.xxhash64("rk"), F.lit(salts)))
    top = F.max(F.struct("record_key", (-F.col("place")).alias("place"))).alias("top")
    part = heads.groupBy("digest", "salt").agg(top, F.count(F.lit(1)).alias("n"))
    whole = part.groupBy("digest").agg(F.max("top").alias("top"), F.sum("n").alias("n")).where("n > 1 and top.record_key is not null")
    spread = part.select("digest", "salt").join(whole.select("digest", F.col("top.record_key").alias("refers_to"), (-F.col("top.place")).alias("refers_place")), "digest")
    later = heads.join(spread, ["digest", "salt"]).where("record_key is null or record_key < refers_to")
    return later.select("rk", "refers_to", "refers_place").distinct()


def _record_text() -> F.Column:
    def line(name: str, value) -> F.Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.col("length").cast("string")),
        F.lit("\r\n"),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("body")))
    size = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("length"))
    key = F.coalesce(F.col("record_key").cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:record:"), key, F.lit(":"), F.col("digest"), F.lit(":"), F.col("place").cast("string"), F.lit(">"))),
        line("WARC-Date", F.col("warc_date")),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(F.col("target_uri"), F.lit("")), r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Record-Key", key),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit(PROFILE)),
                line("WARC-Refers-To", F.concat(F.lit("<urn:record:"), F.col("refers_to").cast("string"), F.lit(":"), F.col("digest"), F.lit(":"), F.col("refers_place").cast("string"), F.lit(">"))),
            ),
        ).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", size.cast("string")),
        F.lit("\r\n"),
        block,
        F.lit(SEPARATOR),
    )


def write_archives(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    min_bytes: int = 1000,
    archive_bytes: int = 16 << 20,
    date: str | None = None,
) -> None:
    """Writes every row of `pages` as a record of compressed archives of about `archive_bytes` under `path`.

    Only records that may be revisits are joined with their originals; a fixed-size
    filter keeps the other payloads out of that shuffle.  `date` is the time of
    writing unless given.
    """
    scratch = Scratch(session(pages))
    records = headers(pages, key, url, payload)
    revisits = scratch.table(resolve_revisits(records.select("rk", "record_key", "digest", "length", "place"), min_bytes), "revisits")
    marked = Filter(scratch, revisits, "rk", "filter").mark(records, F.col("rk"), "maybe")
    joined = marked.where("maybe").join(revisits, "rk", "left")
    none = F.lit(None).cast("long")
    alone = marked.where("not maybe").withColumns({"refers_to": none, "refers_place": none})
    when = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    both = joined.unionByName(alone).withColumn("warc_date", F.lit(when))

    def members(batches):
        held, size = [], 0
        for b in slices(batches, 0):
            for v in b.column(0):
                c = zlib.compressobj(6, zlib.DEFLATED, 31)
                z = c.compress(v.as_buffer()) + c.flush()
                if held and size + len(z) > archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])
                    held, size = [], 0
                held.append(z)
                size += len(z)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])

    archives = both.select(_record_text().alias("value")).mapInArrow(members, "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)
    scratch.close()


_HEAD = re.compile(rb"WARC/1\.[01]\r\n")


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed archive."""
    at, n = 0, len(data)
    while at < n:
        m = _HEAD.match(data, at)
        if not m:
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        fields = {}
        for raw in data[m.end() : end].split(b"\r\n"):
            name, _, value = raw.decode().partition(":")
            fields[name.lower()] = value.strip()
        size = int(fields["content-length"])
        start = end + 4
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} has no end")
        yield fields, data[start : start + size]
        at = start + size + 4


def members(data: bytes) -> Iterator[bytes]:
    """The content of each gzip member of a file, one at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        d, out = zlib.decompressobj(31), []
        while not d.eof:
            piece = view[at : at + (1 << 16)]
            if not len(piece):
                raise ValueError("the last gzip member has no end")
            out.append(d.decompress(piece))
            at += len(piece)
        at -= len(d.unused_data)
        yield b"".join(out)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of all archives under `path`; payload digests of responses are verified.

    A task holds one compressed archive and about 4 MB of records at a time.
    `payloads` adds a column payload (null for revisits).
    """
    schema = RECORDS + (", payload binary" if payloads else "")
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = ["record_key", "target_uri", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    k = 7 if payloads else 6

    def record(f: dict[str, str], block: bytes) -> tuple:
        head, _, body = block.partition(b"\r\n\r\n")
        kind, digest = f["warc-type"], f["warc-payload-digest"].partition(":")[2]
        if kind == "response":
            if hashlib.sha1(body).hexdigest() != digest:
                raise ValueError(f"payload of {f['warc-record-id']} does not match its digest")
            size = len(body)
        else:
            size = int(re.search(rb"(?i)content-length: *(\d+)", head)[1])
        refers = f.get("warc-refers-to", "").removeprefix("<urn:record:").partition(":")[0]
        key = f.get("x-record-key", "")
        return int(key) if key else None, f["warc-target-uri"], kind, digest, size, int(refers) if refers else None, body if kind == "response" else None

    def parse(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for member in members(content.as_py()):
                    for f, block in parse_archive(member):
                        rows.append(record(f, block)[:k])
                        size += len(block) if payloads else 256
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names[:k])
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names[:k])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, schema)
