"""Cases that every operator must survive: structured texts, clashing names, long texts, repeated rows, hot keys."""

import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import recordlake.llm
from recordlake.llm import components, huffman, iblt, langid, mixing, neardup, pieces, queries, rules, stages, substring, textkit, toxicity, warc
from recordlake.llm.shared import Filter, Scratch
from recordlake.llm.textkit import Batch

from .fixtures import corpus, frame, words
from .test_neardup import brute
from .test_vectors import VECS, some_vectors
from .test_warc_mixing_substring import brute_removed

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES, WORDS = (public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "word_bpe_49k.json"))


def thue_morse(n, other=False):
    return "".join("ab"[(bin(i).count("1") + other) % 2] for i in range(n))


PATTERNS = [thue_morse(n, other) for n in (1024, 2048, 4096) for other in (False, True)]


def pattern_rows():
    rows = [(i, p, "en", "s", len(p)) for i, p in enumerate(PATTERNS, 1)]
    lead = " ".join(f"w{i}" for i in range(34))
    return rows + [(10 + i, f"{lead} {p}", "en", "s", 0) for i, p in enumerate(PATTERNS)]


def test_window_hash_is_the_polynomial():
    tok = np.random.default_rng(1).integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2)
    for width in (1, 2, 5, 8, 35, 64):
        got = textkit.window_hash(tok, width)
        for i in (0, 7, 400 - width):
            want = 0
            for x in tok[i : i + width].tolist():
                want = (want * textkit.WORD_BASE + x) % textkit.PRIME
            assert got[i] == textkit.mix(np.array([want], np.uint64))[0]


def test_span_hash_tells_spans_apart():
    r = random.Random(4)
    spans = ["".join(r.choice("ab\0é") for _ in range(r.randint(1, 40))) for _ in range(5000)] + PATTERNS + ["x" * 200_000, "x" * 200_001]
    t = Batch(pa.array([" ".join(spans)]))
    got = {}
    for w, h in zip(spans, t.word_hash().tolist()):
        assert got.setdefault(w, h) == h
    assert len(set(got.values())) == len(got)


def test_equal_hashes_do_not_mix_words_up(monkeypatch):
    """With a first hash that never tells words apart, the second one does."""
    real = textkit.span_hash
    monkeypatch.setattr(textkit, "span_hash", lambda d, s, e, salt=0: real(d, s, e, salt) if salt else np.zeros(len(s), np.uint64))
    texts = ["one two three one", "four five six", "two six"]
    enc = huffman.WordEncoder(open(WORDS, "rb").read())
    tok = tokenizers.Tokenizer.from_file(WORDS)
    for t in (texts, texts[::-1], ["seven one"]):
        ids, at = enc.encode(Batch(pa.array(t)), None)
        assert [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:])] == [tok.encode(x, add_special_tokens=False).ids for x in t]


def test_patterns_near_duplicates(spark):
    rows = pattern_rows()
    got = {tuple(r) for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == set(brute(rows))


def test_patterns_substring(spark):
    rows = pattern_rows()
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in substring.remove_repeats(frame(spark, rows)).collect())
    assert got == brute_removed(rows, 35) and all(k[2] == 0 for k in got)


def test_patterns_ids_and_fingerprints(spark):
    rows = pattern_rows()
    sp, tok = sentencepiece.SentencePieceProcessor(model_file=PIECES), tokenizers.Tokenizer.from_file(WORDS)
    t = Batch(pa.array([r[1] for r in rows]))
    ids, at, _, _ = pieces.encoder(open(PIECES, "rb").read()).encode(t)
    assert [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:])] == [sp.encode(r[1]) for r in rows]
    ids, at = huffman.encoder(open(WORDS, "rb").read()).encode(t, None)
    assert [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:])] == [tok.encode(r[1], add_special_tokens=False).ids for r in rows]
    got = iblt.fingerprint_versions(frame(spark, rows)).collect()
    assert len({r["fingerprint"] for r in got}) == len(rows)


def inner_names():
    """Every name in quotes in the operators' code."""
    at = os.path.dirname(recordlake.llm.__file__)
    code = "\n".join(open(os.path.join(at, f)).read() for f in sorted(os.listdir(at)) if f.endswith(".py"))
    found = re.findall(r"[\"']([A-Za-z_]\w*)[\"']", code)
    return sorted({x.lower() for x in found} - {"doc_id", "text", "lang", "source", "n_chars", "page_id", "url", "html"})


def clash(df):
    names = [*inner_names(), "copies", "copy", "pick_id", "pick_source", "n_words", "n_removed", "removed_spans", "__key", "__z", "__found", "__s", "kept", "kept_id", "a.b", "x`y"]
    names = list(dict.fromkeys(names))
    return df.select("*", *[F.lit(f"kept {n}").alias(n) for n in names]), names


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rows = [(i, *r[1:3], ["a", "b", None][i % 3], r[4]) for i, r in enumerate(corpus(2, 60))]
    at = str(tmp_path)
    spark.createDataFrame([(r[0], int(r[0] % 4 > 0), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    plain = frame(spark, rows)
    plain.write.parquet(f"{at}/plain.parquet")
    wide, names = clash(plain)
    wide.write.parquet(f"{at}/wide.parquet")
    assert len(names) > 150
    for name, stage in stages.STAGES:
        few, many = (stage(spark, spark.read.parquet(f"{at}/{x}.parquet"), at) for x in ("plain", "wide"))
        if stage is stages.sentencepiece:
            assert Counter(map(tuple, few.collect())) == Counter(map(tuple, many.collect()))
            continue
        assert few.columns == plain.columns and many.columns == wide.columns, name
        got = many.collect()
        assert Counter(tuple(r)[:5] for r in got) == Counter(map(tuple, few.collect())), name
        assert all(r[5 + i] == f"kept {n}" for r in got for i, n in enumerate(names)), name


def test_operators_take_columns_of_any_name(spark):
    rows = corpus(6, 50)
    plain = frame(spark, rows)
    wide, _ = clash(plain)
    same = lambda f: Counter(map(repr, f(plain).collect())) == Counter(map(repr, f(wide).collect()))
    assert same(lambda d: neardup.near_duplicates(d).orderBy("doc_id"))
    assert same(lambda d: substring.remove_repeats(d).select("doc_id", "text", *substring.RESULTS))
    assert same(lambda d: rules.with_statistics(d).select("doc_id", *rules.BASE, *rules.MORE))
    assert same(lambda d: mixing.mix_sources(d))
    assert same(lambda d: iblt.fingerprint_versions(d))
    assert same(lambda d: langid.identify(d, langid.fit(d)))
    labels = spark.createDataFrame([(r[0], 1, r[0] % 2) for r in rows], "doc_id long, quality int, toxic int")
    assert same(lambda d: toxicity.severities(d, toxicity.fit(d, clash(labels)[0].drop("toxic").withColumn("toxic", (F.col("doc_id") % 2).cast("int")) if len(d.columns) > 9 else labels)))

    def tokens(d):
        path = Scratch(spark).path("ids")
        huffman.encode_corpus(d, WORDS, path)
        return huffman.read_files(spark, path)

    assert same(tokens)

    def archives(d):
        path = Scratch(spark).path("w")
        warc.write_archives(d, path, "doc_id", "lang", "text", date="2000-01-01T00:00:00Z")
        return warc.read_archives(spark, path)

    assert same(archives)


def test_very_long_texts(spark):
    """A text of 12 MB, one word of 1 MB, and two short ones, through every operator."""
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    long = " ".join(r.choice(vocab) for _ in range(2_200_000))
    rows = [(1, long, "en", "a", 0), (2, "q" * (1 << 20), "en", "a", 0), (3, "short text", "de", "b", 0), (4, None, None, None, 0)]
    docs = frame(spark, rows)
    assert len(long) > 12_000_000
    by = lambda df: {x["doc_id"]: x for x in df.collect()}
    n = len(words(long))
    assert by(neardup.near_duplicates(docs))[1]["n_shingles"] > 2_000_000
    got = by(substring.remove_repeats(docs))
    assert got[1]["n_words"] == n and got[1]["n_removed"] == 0 and got[1]["text"] == long and got[2]["n_words"] == 1
    assert by(mixing.mix_sources(docs))[1]["size"] == n
    got = by(iblt.fingerprint_versions(docs))
    assert got[1]["n_chars"] == len(long) and 0.2 < got[1]["near_edited"] < 0.6
    assert by(langid.identify(docs, langid.fit(docs)))[1]["lang_pred"] in ("en", "de")
    labels = spark.createDataFrame([(1, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(by(toxicity.severities(docs, toxicity.fit(docs, labels)))) == 4
    got = by(pieces.encode_decode(docs, PIECES))
    assert all(got[k]["round_trip"] for k in got) and got[1]["n_tokens"] > n
    path = Scratch(spark).path("ids")
    huffman.encode_corpus(docs, WORDS, path)
    got = by(huffman.read_files(spark, path))
    assert got[1]["n_tokens"] > n and got[4]["n_tokens"] == 1
    path = Scratch(spark).path("w")
    warc.write_archives(docs, path, "doc_id", "lang", "text", archive_bytes=1 << 20)
    assert {x["record_key"]: x["payload_bytes"] for x in warc.read_archives(spark, path).collect()} == {1: len(long), 2: 1 << 20, 3: 10, 4: 0}
    got = by(rules.with_statistics(docs))
    assert got[1]["n_words"] == n and got[2]["word_chars"] == 1 << 20


def test_repeated_rows(spark):
    rows = corpus(3, 30)
    docs = frame(spark, rows + rows)
    mixed = Counter((x["doc_id"], x["source"], x["size"], x["copies"]) for x in mixing.mix_sources(docs).collect())
    assert all(v % 2 == 0 for v in mixed.values()) and sum(mixed.values()) == 2 * len(rows)
    ids = Counter((x["doc_id"], bytes(x["ids"])) for x in pieces.encode_decode(docs, PIECES).collect())
    assert all(v % 2 == 0 for v in ids.values())
    path = Scratch(spark).path("ids")
    huffman.encode_corpus(docs, WORDS, path)
    got = sorted(huffman.read_files(spark, path).collect(), key=lambda x: x["start"])
    assert [x["start"] for x in got] == np.concatenate([[0], np.cumsum([x["n_tokens"] for x in got])[:-1]]).tolist()
    assert all(v % 2 == 0 for v in Counter((x["doc_id"], x["ids_crc32"]) for x in got).values())


def test_record_ids_are_unique_and_members_stand_alone(spark):
    import gzip

    rows = [(1, "u", "x" * 2000), (2, "u", "x" * 2000), (2, "u", "x" * 2000), (2, "u", "x" * 2000), (3, "v", "small"), (3, "v", "small")]
    path = Scratch(spark).path("w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path, archive_bytes=700)
    files = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect()]
    heads = []
    for f in files:
        assert gzip.decompress(f) == b"".join(warc.members(f))  # a plain reader takes the file as it is
        for m in filter(None, warc.members(f)):
            own = list(warc.parse_archive(m))
            assert len(own) == 1  # one record a member
            heads.append(own[0][0])
    ids = [h["warc-record-id"] for h in heads]
    assert len(set(ids)) == len(rows) and all(h["warc-date"] > "2020" for h in heads)
    refers = [h["warc-refers-to"] for h in heads if h["warc-type"] == "revisit"]
    assert len(refers) == 1 and refers[0] in ids


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(components, "FEW", 10)
    monkeypatch.setattr(components, "SHARES", 8)
    r = random.Random(2)
    rows = [(0 if i % 2 else r.randrange(40), i) for i in range(400)]
    n = Counter(k for k, _ in rows)
    table = spark.createDataFrame([(k, k * 10, v) for k, v in n.items() if k != 5], "k int, value int, n long")
    left = spark.createDataFrame(rows, "k int, i int")
    for how in ("inner", "left"):
        got = Counter(map(tuple, components.join_by_share(left, table, "k", how=how).select("k", "i", "value").collect()))
        assert got == Counter((k, i, None if k == 5 else k * 10) for k, i in rows if how == "left" or k != 5)


def test_components_with_a_hub(spark, monkeypatch):
    for few in (0, 4096):  # counted, and not
        monkeypatch.setattr(components, "FEW", few)
        edges = [(1, k) for k in range(2, 60)] + [(k, k + 1) for k in range(100, 130)] + [(200, 201), (201, 200), (7, 7)]
        got = {x["node"]: x["label"] for x in components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark), "t").collect()}
        assert got == {**{k: 1 for k in range(1, 60)}, **{k: 100 for k in range(100, 131)}, 200: 200, 201: 200}


def test_filter_has_no_false_negatives(spark):
    scratch = Scratch(spark)
    members = spark.range(0, 3000, 3).withColumnRenamed("id", "v").union(spark.createDataFrame([(None,)], "v long"))
    marked = Filter(scratch, members, "v", "f").mark(spark.range(3000).select("id").union(spark.createDataFrame([(None,)], "id long")), F.col("id"), "maybe").collect()
    assert all(x["maybe"] for x in marked if x["id"] is None or x["id"] % 3 == 0)
    assert sum(x["maybe"] for x in marked) < 1100


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [(i * 7 % 997, *r[1:3], ["s1", "S2", None, "é"][i % 4], r[4]) for i, r in enumerate(corpus(12, 90))]
    frame(spark, rows).write.parquet(f"{at}/documents.parquet")
    big = "é" * 500
    pages = [(1, "u1", big), (2, "u2", big), (5, "u5", big), (None, "un", big), (5, "u5", big), (3, "u3", "small"), (6, "u6", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(r[0], int(i % 4 > 0), int(i % 5 == 0)) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    vectors = [r for r in some_vectors(60) if r[1] is None or len(r[1]) == 64]  # repeated, null and non-finite ones among them
    spark.createDataFrame(vectors, VECS).write.parquet(f"{at}/embeddings.parquet")
    return at, rows


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_registered_query_equals_its_sql(spark, tables, name):
    duckdb = pytest.importorskip("duckdb")
    at, _ = tables
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        c.execute(f"create view {t} as select * from '{at}/{t}.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, at)
    cur = c.execute(queries.SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    tidy = lambda v: round(v, 9) if isinstance(v, float) else v
    want = Counter(tuple(tidy(r[names.index(k)]) for k in df.columns) for r in cur.fetchall())
    assert Counter(tuple(tidy(v) for v in r) for r in df.collect()) == want


def test_registered_queries_without_sql(spark, tables):
    """op3, op4, op5, op6, op7, op8, op12, op13: the contract's columns against plain Python."""
    import zlib

    from .test_iblt import brute as brute_fingerprints
    from .test_rules_huffman import statistics

    at, rows = tables
    run = lambda name: queries.QUERIES[name](spark, at).collect()
    got = run("op3_quality")
    base = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got)
    assert base == Counter((r[0], *statistics(r[1])) for r in rows)
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)
    got = run("op4_language")
    assert Counter((r["doc_id"], r["held_out"]) for r in got) == Counter((r[0], zlib.crc32(str(r[0]).encode()) % 3 == 1) for r in rows)
    assert {r["lang_pred"] for r in got} <= {"en", "de", "und"} and all(0 <= r["score"] <= 1 for r in got)
    text = Counter(r[0] for r in rows if not any(ch.isalpha() for ch in r[1] or ""))
    assert Counter(r["doc_id"] for r in got if r["lang_pred"] == "und") == text
    got = run("op5_toxicity")
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows) and all(0 <= r["severity"] <= 3 for r in got)
    got = run("op12_quality_score")
    assert Counter((r["doc_id"], r["held_out"]) for r in got) == Counter((r[0], zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    got = run("op13_whitening")
    assert {r["component"] for r in got} == set(range(1, 9)) and len(got) == 8 * got[0]["n"] and all(r["identity_error"] < 1e-4 for r in got)
    got = run("op6_fingerprints")
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == brute_fingerprints(rows)
    sp, tok = sentencepiece.SentencePieceProcessor(model_file=PIECES), tokenizers.Tokenizer.from_file(WORDS)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    got = run("op7_pieces")
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"], r["round_trip"]) for r in got) == Counter((r[0], len(x), crc(x), True) for r in rows for x in [sp.encode(r[1] or "")])
    got = sorted(run("op8_token_files"), key=lambda r: r["start"])
    want = Counter((r[0], len(x), crc(x)) for r in rows for x in [[*tok.encode(r[1] or "", add_special_tokens=False).ids, 2]])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["doc_id"] for r in got] == sorted(r[0] for r in rows)
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
