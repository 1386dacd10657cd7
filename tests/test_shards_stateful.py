"""Data sources over shards, restarts in the middle of one, and stateful streams against their batch results."""

import hashlib
import json
import random
import threading
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from recordlake.sources import files, shards
from recordlake.streaming import stateful


@pytest.fixture
def server():
    """A local server of bytes by path; `flaws` holds answers to give first."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.server.asked.append((self.path, self.headers.get("Range")))
            flaw = self.server.flaws.get(self.path, [])
            if flaw and (code := flaw.pop(0)) != "cut":
                self.send_response(code)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            elif flaw is not None and self.server.cut.pop(self.path, None):
                body = self.server.files[self.path]
                self.send_response(200)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body[: len(body) // 2])  # the transfer breaks off
                return
            body = self.server.files[self.path]
            start = int((self.headers.get("Range") or "bytes=0-")[6:].split("-")[0])
            self.send_response(206 if start else 200)
            self.send_header("Content-Length", str(len(body) - start))
            self.end_headers()
            self.wfile.write(body[start:])

        def do_HEAD(self):
            self.send_response(200)
            self.send_header("Content-Length", str(len(self.server.files[self.path])))
            self.end_headers()

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    s.files, s.flaws, s.cut, s.asked = {}, {}, {}, []
    s.url = f"http://127.0.0.1:{s.server_port}"
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def put_shard(server, name, texts):
    body = "".join(json.dumps({"sha256": hashlib.sha256(t.encode()).hexdigest(), "text": t}) + "\n" for t in texts).encode()
    server.files[f"/{name}"] = body
    return {"name": name, "path": f"{server.url}/{name}", "bytes": len(body), "sha256": hashlib.sha256(body).hexdigest()}


def test_executors_fetch_verify_and_retry(spark, server, tmp_path):
    listed = [put_shard(server, f"s{i}", [f"text {i} {k} " + "é" * 50 for k in range(200)]) for i in range(5)]
    server.flaws["/s1"] = [503, 429]
    server.cut["/s2"] = True
    df = shards.read_shards(spark, listed)
    assert df.rdd.getNumPartitions() == 5
    got = df.groupBy("shard").count().collect()
    assert {r["shard"]: r["count"] for r in got} == {f"s{i}": 200 for i in range(5)}
    assert any(path == "/s2" and span for path, span in server.asked)  # taken up at the byte reached
    index = spark.createDataFrame([(hashlib.sha256(f"text {i} {k} {'é' * 50}".encode()).hexdigest(), f"s{i}") for i in range(5) for k in range(200)], "sha256 string, shard string")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("materialize", "")
    assert files.materialize(spark, index, listed, f"{tmp_path}/out").count() == 1000
    assert sum(1 for p, _ in server.asked if p == "/s4") == 2 and len(jobs.getJobIdsForGroup("materialize")) < 15  # one fetch a shard, whatever their number
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_changed_shard_leaves_nothing(spark, server, tmp_path):
    listed = [put_shard(server, "a", ["x"]), put_shard(server, "b", ["y"])]
    server.files["/b"] = server.files["/b"].replace(b"y", b"z")
    index = spark.createDataFrame([(hashlib.sha256(t.encode()).hexdigest(), s) for t, s in (("x", "a"), ("y", "b"))], "sha256 string, shard string")
    with pytest.raises(ValueError, match="size and digest"):
        files.materialize(spark, index, listed, f"{tmp_path}/out")
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(ValueError, match="not expected"):
        files.materialize(spark, index.where("shard = 'a'"), [listed[0], put_shard(server, "b", ["y"])], f"{tmp_path}/out")
    assert list(tmp_path.iterdir()) == []


def test_spans_share_out_all_lines(tmp_path):
    r = random.Random(3)
    for _ in range(30):
        body = b"".join(b"x" * r.randrange(40) + b"\n" for _ in range(r.randrange(1, 40)))
        path = tmp_path / "f"
        path.write_bytes(body + b"open end")
        assert shards.last_end(str(path), len(body) + 8, 0) == len(body) == shards.size_of(f"file:{path}") - 8
        cuts = sorted({0, len(body), *(r.randrange(len(body) + 1) for _ in range(6))})
        got = [x for a, z in zip(cuts, cuts[1:]) for x in shards.whole_lines(random.choice([str(path), f"file:{path}"]), a, z)]
        assert got == body.split(b"\n")[:-1]


def test_stream_goes_on_inside_a_shard(spark, tmp_path):
    lines = [f"line {i} {'y' * (i % 60)}" for i in range(500)]
    (tmp_path / "a.ndjson").write_text("\n".join(lines[:300]) + "\n")
    (tmp_path / "b.ndjson").write_text("\n".join(lines[300:400]) + "\nline 4")  # not yet whole
    manifest = tmp_path / "manifest.json"
    manifest.write_text(json.dumps({"shards": [{"path": "a.ndjson"}, {"path": "b.ndjson"}]}))
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/cp"

    def start():
        return shards.stream_lines(spark, str(manifest), 3000).writeStream.format("parquet").option("checkpointLocation", checkpoint).start(out)

    q = start()
    while not q.recentProgress or q.lastProgress["batchId"] < 1:
        q.awaitTermination(1)
    q.stop()  # after a few batches of 3,000 bytes a shard
    first = spark.read.parquet(out).count()
    assert 0 < first
    with open(tmp_path / "b.ndjson", "a") as f:
        f.write("00 " + "y" * (400 % 60) + "\n" + "\n".join(lines[401:]) + "\n")
    q = start()
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(out)
    assert sorted(r["value"] for r in got.collect()) == sorted(lines)
    assert got.select(F.input_file_name()).distinct().count() > 2  # several batches


T0 = datetime(2024, 1, 1)


def events(seed=1, n=300):
    """(ts, key, id) out of order within a day, some repeated."""
    r = random.Random(seed)
    rows = [(T0 + timedelta(hours=i, minutes=r.randrange(-600, 600)), f"k{r.randrange(5)}", i) for i in range(n)]
    return rows + r.sample(rows, 20)


def stream_of(spark, rows, schema, path, files=4):
    """The rows as a stream of several files, and a far later row that closes every window."""
    df = spark.createDataFrame(rows, schema)
    size = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
        __import__("time").sleep(0.05)
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}-cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


END = (T0 + timedelta(days=60), "end", -1)


def test_sliding_and_session_windows_equal_batch(spark, tmp_path):
    rows = sorted(events(), key=lambda r: r[2]) + [END]
    df, stream = stream_of(spark, rows, "ts timestamp, k string, id long", f"{tmp_path}/e")
    for name, fn in (("sliding", lambda x: stateful.sliding_counts(x, "ts", "k", "12 hours", "4 hours")), ("session", lambda x: stateful.session_counts(x, "ts", "k", "3 hours"))):
        want = sorted(map(tuple, fn(df).where("k <> 'end'").collect()))
        assert sorted(map(tuple, run(fn(stream), tmp_path, name).where("k <> 'end'").collect())) == want and len(want) > 50


def test_two_streams_meet_as_in_batch(spark, tmp_path):
    a = sorted(events(2, 150), key=lambda r: r[2])
    b = [(ts + timedelta(hours=random.Random(i).randrange(-5, 30)), k, i) for i, (ts, k, _) in enumerate(a)]
    left, lstream = stream_of(spark, [*a, END], "ts timestamp, k string, id long", f"{tmp_path}/a")
    right, rstream = stream_of(spark, [*b, END], "rts timestamp, k string, rid long", f"{tmp_path}/b")
    for how in ("inner", "left"):
        # a stream may only lose what is later than the watermark: here nothing is
        want = sorted(map(str, stateful.joined(left, right, "k", "ts", "rts", "6 hours", "3 days", how).where("k <> 'end'").collect()))
        got = run(stateful.joined(lstream, rstream, "k", "ts", "rts", "6 hours", "3 days", how), tmp_path, f"join_{how}").where("k <> 'end'")
        assert sorted(map(str, got.collect())) == want and len(want) > 100


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_first_routes_equal_batch(spark, tmp_path, rocksdb):
    r = random.Random(4)
    rows = [(f"r{r.randrange(30)}", f"rec{r.randrange(9)}", r.randrange(1000)) for _ in range(200)]
    rows += rows[:30] + [(None, "x", 1), ("r1", "x", None)]
    df, stream = stream_of(spark, rows, "route string, record string, pos long", f"{tmp_path}/r")
    got = run(stateful.first_routes(stream, "route", "record", "pos"), tmp_path, "routes", "update")
    last = got.groupBy("route").agg(F.max_by(F.struct("record", "pos", "duplicates"), "duplicates").alias("x")).select("route", "x.*")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, stateful.first_routes(df, "route", "record", "pos").collect()))


def test_retracted_facets_equal_batch(spark, tmp_path, rocksdb):
    r = random.Random(5)
    rows = [(f"c{r.randrange(40)}", r.randrange(6), r.choice(["A b", "a B", "c", "d", None])) for _ in range(250)]
    rows += rows[:40] + [(None, 1, "a"), ("c1", None, "zz")]
    df, stream = stream_of(spark, rows, "record string, version long, label string", f"{tmp_path}/f")
    key = F.lower("label")
    changes = run(stateful.facet_changes(stream, "record", "version", key), tmp_path, "changes")
    assert changes.where("delta = -1").count() > 10
    want = sorted(map(tuple, stateful.counts(stateful.facet_changes(df, "record", "version", key)).collect()))
    assert sorted(map(tuple, stateful.counts(changes).collect())) == want and len(want) == 3
