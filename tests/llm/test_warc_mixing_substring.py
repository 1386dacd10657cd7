import hashlib
import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from recordlake.llm import mixing, substring, warc
from recordlake.llm.shared import Scratch

from .fixtures import corpus, frame, with_extra, words


def test_warc_round_trip(spark):
    big = "x" * 1500
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (5, "u5", big), (3, None, "small"), (4, "u4", "small"), (6, "u6", None), (None, "un", big), (7, "u7", "é" * 500), (8, "u8", "é" * 500), (9, "u9", "a\r\n\r\nWARC/1.1\r\n" * 100), (5, "u5", big), (10, "u\r\n10", "é" * 499)]
    pages = with_extra(spark.createDataFrame(rows, "page_id long, url string, html string"))
    path = Scratch(spark).path("w")
    warc.write_archives(pages, path, archive_bytes=3000)
    got = [tuple(r) for r in warc.read_archives(spark, path, payloads=True).collect()]
    assert len(got) == len(rows)
    expect = Counter()
    best = defaultdict(lambda: -1)
    for k, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 1000 and k is not None:
            best[p] = max(best[p], k)
    for k, u, h in rows:
        p = (h or "").encode()
        n = sum(1 for _, _, x in rows if (x or "") == (h or ""))
        original = best[p] if len(p) >= 1000 and n > 1 and (k is None or k < best[p]) else None
        expect[(k, (u or "").replace("\r", "").replace("\n", ""), "revisit" if original else "response", hashlib.sha1(p).hexdigest(), len(p), original, None if original else p)] += 1
    assert Counter((*r[:6], bytes(r[6]) if r[6] is not None else None) for r in got) == expect


def test_warc_empty_table(spark):
    path = Scratch(spark).path("w")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def goals(rows, weights=(3, 1, 2), share=1.5, limit=2.0):
    size = defaultdict(int)
    for _, t, _, s, _ in rows:
        size[s] += len(words(t))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, full = share * sum(size.values()), set()
    while True:
        unit = left / sum(w[s] for s in order if s not in full)
        over = [s for s in order if s not in full and unit * w[s] >= limit * size[s]]
        if not over:
            return size, {s: limit * size[s] if s in full else unit * w[s] for s in order}
        full.update(over)
        left = share * sum(size.values()) - sum(limit * size[s] for s in full)


def test_mixing_meets_targets(spark):
    rows = corpus(3, 400)
    df = frame(spark, rows)
    got = mixing.mix_sources(df).collect()
    again = mixing.mix_sources(frame(spark, rows, 7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    size, want = goals(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == size[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + want[r["source"]])
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in size:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_mixing_thresholds_are_nested(spark):
    df = frame(spark, corpus(4, 200))
    small = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.mix_sources(df, share=0.4).collect()}
    large = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.mix_sources(df, share=0.7).collect()}
    assert all(large[k] >= v for k, v in small.items())


def test_mixing_empty_and_clashing_columns(spark):
    df = frame(spark, corpus(5, 30))
    assert mixing.mix_sources(df.limit(0)).count() == 0
    assert mixing.mix_sources(with_extra(df)).count() == df.count()


def brute_removed(rows, width):
    seen = Counter()
    for _, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - width + 1):
            seen[tuple(w[i : i + width])] += 1
    out = []
    for k, t, *_ in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), kept))
    return Counter(out)


@pytest.mark.parametrize("seed,width", [(1, 35), (2, 35), (7, 8)])
def test_substring_against_brute_force(spark, seed, width):
    rows = corpus(seed, 150)
    got = substring.remove_repeats(with_extra(frame(spark, rows)), width=width)
    found = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"] or "") for r in got.collect())
    assert found == brute_removed(rows, width)


@pytest.mark.parametrize("fan_bits", [12, 2, 1])  # one level, and several
def test_substring_many_chunks_and_buckets(spark, monkeypatch, fan_bits):
    rows = corpus(9, 150)
    slices = substring.slices
    monkeypatch.setattr(substring, "slices", lambda b, c: slices(b, c, 300))
    monkeypatch.setattr(substring, "FAN_BITS", fan_bits)
    monkeypatch.setattr(substring, "FAN", 1 << fan_bits)
    monkeypatch.setattr(substring, "CHUNK", 300)
    df = frame(spark, rows, 2)
    key = df.withColumn("k", F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.hex(F.xxhash64("text"))))
    spans = {r["span_key"]: r["spans"] for r in substring.repeated_spans(key, "k", "text", 35, bucket_bytes=500 if fan_bits > 2 else 3000).collect()}
    removed = Counter()
    for r in key.collect():
        sp = spans.get(r["k"], [])
        removed[(r["doc_id"], sum(sp[1::2]) - sum(sp[::2]))] += 1
    assert removed == Counter((k, n) for (k, _, n, _), c in brute_removed(rows, 35).items() for _ in range(c))


def test_substring_cut_bytes_keeps_untouched_texts(spark):
    rows = [(1, "  keep \n this  as it is ", None, None, 0), (2, None, None, None, 0), (3, "x y " * 40 + "tail\nend", None, None, 0)]
    got = {r["doc_id"]: r["text"] for r in substring.remove_repeats(frame(spark, rows), cut="bytes").collect()}
    assert got[1] == rows[0][1] and got[2] is None and got[3] == "tail\nend"


def test_substring_empty_table(spark):
    assert substring.remove_repeats(frame(spark, corpus(1, 5)).limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "repeats"])
def test_op1_warc_equals_its_sql(spark, sf, tmp_path):
    from recordlake.llm import queries

    at = str(tmp_path) if sf == "repeats" else f"/root/testdata/{sf}"
    if sf == "repeats":  # the tables have no revisit
        big = "é" * 500
        pages = [(1, "u1", big), (2, "u2", big), (5, "u5", big), (None, "un", big), (5, "u5", big), (3, "u3", "small"), (4, None, "small"), (6, "u6", None), (7, "u7", "é" * 499), (8, "u8", "é" * 499)]
        spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{at}/pages.parquet")
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(at):
        pytest.skip("no test tables")
    got = queries.QUERIES["op1_warc"](spark, at)
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{at}/pages.parquet{"/*.parquet" if sf == "repeats" else ""}'")
    cur = c.execute(queries.SQL["op1_warc"])
    assert [x[0] for x in cur.description] == got.columns
    rows = Counter(tuple(r) for r in got.collect())
    assert rows == Counter(cur.fetchall()) and any(r[3] == "revisit" for r in rows) == (sf == "repeats")
