import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from recordlake.llm import huffman, rules
from recordlake.llm.shared import Scratch

from .fixtures import corpus, frame, with_extra, words

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def statistics(text):
    t = text or ""
    w = words(t)
    where = {}
    for i in range(len(w) - 7):
        where.setdefault(tuple(w[i : i + 8]), []).append(i)
    again = {i + k for p in where.values() if len(p) > 1 for i in p for k in range(8)}
    lines = [x for x in t.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))


def junk(seed):
    r = random.Random(seed)
    rows = corpus(seed, 60)
    line = "one two three four five six seven eight nine"
    for i in range(60):
        w = [r.choice("abcdefghij") * r.randint(1, 5) for _ in range(r.randint(10, 60))]
        bad = i % 3 == 0
        rows.append((5000 + i, " ".join(x + "%%%" if bad else x for x in w) + ("\n" + line) * r.randint(0, 3), None, None, 0))
    return rows


def test_statistics_and_list(spark):
    rows = junk(2)
    df = rules.with_statistics(with_extra(frame(spark, rows)))
    got = Counter((r["doc_id"], *(r[c] for c in rules.BASE)) for r in df.collect())
    assert got == Counter((r[0], *statistics(r[1])) for r in rows)
    labels = spark.createDataFrame([(r[0], int("%%%" not in (r[1] or "")), 0) for r in rows if r[0] >= 5000] + [(5001, None, 0)], "doc_id long, quality int, toxic int")
    learned = rules.learn(rules.labelled_statistics(df, labels), least=3)
    assert learned.rules
    for r in rules.judge(df, learned).collect():
        n, _, _, _, rep = statistics(r["text"])
        assert r["base_failed"] == (n < 20 or 100 * rep > 30 * n)
        if r["doc_id"] >= 5000 and not r["base_failed"]:
            assert r["kept"] == ("%%%" not in r["text"])
        assert r["kept"] == (not r["base_failed"] and r["rejected_by"] is None)


def test_rules_without_labels(spark):
    df = rules.with_statistics(frame(spark, corpus(1, 10)))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rules.learn(rules.labelled_statistics(df, labels)).rules == []
    assert rules.judge(df.limit(0), rules.DecisionList()).count() == 0


def huffman_cost(w):
    import heapq

    h = list(w)
    heapq.heapify(h)
    cost = 0
    while len(h) > 1:
        x = heapq.heappop(h) + heapq.heappop(h)
        cost += x
        heapq.heappush(h, x)
    return cost


def test_package_merge():
    r = random.Random(1)
    for n in (1, 2, 3, 17, 300):
        w = np.array([int(r.paretovariate(0.7)) + 1 for _ in range(n)], np.int64)
        size = huffman.code_lengths(w, 40)
        if n > 1:
            assert (w * size).sum() == huffman_cost(w.tolist())
        for limit in (9, 12):
            short = huffman.code_lengths(w, limit)
            assert short.max() <= limit and sum(2.0 ** -int(x) for x in short) <= 1
    fib = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    assert huffman.code_lengths(fib, 4).max() == 4


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_code_round_trip(n):
    r = np.random.default_rng(n)
    ids = (r.pareto(0.8, n) * 7).astype(np.int64) % 40000
    symbols, counts = np.unique(np.append(ids, 3), return_counts=True)
    code = huffman.Code(symbols, huffman.code_lengths(counts))
    bits, offsets, total = code.encode(ids)
    assert len(bits) == (total + 7) // 8
    if n:
        assert (code.decode(bits, offsets, n) == ids).all()


def test_files_against_library(spark, monkeypatch):
    rows = corpus(11, 150) + [(77777, "İstanbul ΑΣ <|endoftext|>x can't ﬁ é\u0085z q \U0001f600's", None, None, 0), (None, "no id", None, None, 0)]
    path = Scratch(spark).path("ids")
    huffman.encode_corpus(with_extra(frame(spark, rows)), TOKENIZER, path)
    got = huffman.read_files(spark, path, with_ids=True).orderBy("start").collect()
    tok = tokenizers.Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for k, t, *_ in rows:
        want[(k, tuple(tok.encode(t or "", add_special_tokens=False).ids) + (2,))] += 1
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda k: (k is not None, k or 0))


def test_files_of_many_parts(spark, monkeypatch):
    rows = corpus(12, 200)
    tokens = Scratch(spark).table(huffman.token_table(frame(spark, rows), TOKENIZER), "tokens")
    monkeypatch.setattr(huffman, "FILE_TOKENS", 400)
    path = Scratch(spark).path("ids")
    huffman.write_files(tokens, path, huffman.id_type(TOKENIZER, 2))
    got = huffman.read_files(spark, path).orderBy("start").collect()
    assert len(got) == len(rows) and [r["doc_id"] for r in got] == sorted(r[0] for r in rows)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))


def test_empty_table(spark):
    path = Scratch(spark).path("ids")
    huffman.encode_corpus(frame(spark, corpus(1, 5)).limit(0), TOKENIZER, path)
    assert huffman.read_files(spark, path).count() == 0
