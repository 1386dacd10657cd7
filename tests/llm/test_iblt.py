import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from recordlake.llm import iblt
from recordlake.llm.textkit import Batch, span_hash

from .fixtures import corpus, frame, with_extra


def paragraphs(text):
    """Lines, cut behind every word whose hash says so."""
    out = []
    for line in text.split("\n"):
        at = 0
        for m in re.finditer(r"[^\x20\x09-\x0D]+", line):
            raw = m[0].encode()
            h = int(span_hash(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), iblt.CUT)[0])
            if (h >> 32) % iblt.CUT_WORDS == 0 and m.end() < len(line):
                out.append(line[at : m.end()])
                at = m.end()
        out.append(line[at:])
    return out


def likeness(a, b):
    x, y = Counter(paragraphs(a)), Counter(paragraphs(b))
    same, every = sum((x & y).values()), sum((x | y).values())
    return same / every


def brute(rows):
    docs = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: -r[0])
    out = Counter()
    for i, (k, t) in enumerate(docs):
        nxt = docs[(i + 1) % len(docs)][1]
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        out[(k, len(t), hashlib.sha256(e.encode()).hexdigest(), round(likeness(t, e), 9), round(likeness(t, nxt), 9))] += 1
    return out


def test_differences_recover_digests():
    r = random.Random(5)
    texts, others = [], []
    for i in range(60):
        lines = [f"line {r.randrange(50)}" for _ in range(r.choice([0, 1, 5, 60, 400]))]
        texts.append("\n".join(lines))
        for _ in range(r.randrange(6)):
            lines.insert(r.randrange(len(lines) + 1), f"new {r.randrange(9)}")
        others.append("\n".join(lines))
    a, b = (iblt.paragraph_keys(Batch(pa.array(x))) for x in (texts, others))
    for i, (x, y) in enumerate(iblt.differences(a, b)):
        p, q = (set(k[0][k[1][i] : k[1][i + 1]].tolist()) for k in (a, b))
        assert set(x.tolist()) == p - q and set(y.tolist()) == q - p
    want = [likeness(s, t) for s, t in zip(texts, others)]
    assert np.allclose(iblt.likeness(a, b), want)


@pytest.mark.parametrize("n", [1, 2, 150])
def test_against_brute_force(spark, n):
    rows = [(i * 7 - 3, *r[1:]) for i, r in enumerate(corpus(3, 200)[-n:])]
    got = iblt.fingerprint_versions(with_extra(frame(spark, rows))).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == brute(rows)
    text = {r[0]: r[1] or "" for r in rows}
    by = {}
    for r in got:
        assert by.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    assert len(set(by.values())) == len(by)


def test_nulls_ties_and_empty(spark):
    rows = [(1, None, None, None, 0), (1, "", None, None, 0), (None, "x\ny", None, None, 0), (1, "x\ny", None, None, 0)]
    got = iblt.fingerprint_versions(frame(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter([1, 1, 1, None])
    assert len({r["fingerprint"] for r in got}) == 2
    assert iblt.fingerprint_versions(frame(spark, rows).limit(0)).count() == 0


def test_one_long_line_is_like_its_edit(spark):
    r = random.Random(3)
    line = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(3000))
    rows = [(1, line(), None, None, 0), (2, line(), None, None, 0)]
    for x in iblt.fingerprint_versions(frame(spark, rows)).collect():
        assert 0.2 < x["near_edited"] < 0.5 and x["near_next"] < 0.1


def test_likeness_is_that_of_the_emitted_fingerprints(spark):
    got = iblt.fingerprint_versions(frame(spark, [(i * 7 - 3, *r[1:]) for i, r in enumerate(corpus(3, 200))])).collect()
    got.sort(key=lambda r: -r["doc_id"])
    own, edited = ([r[c] for r in got] for c in ("fingerprint", "edited_fingerprint"))
    assert iblt.likeness_of(own, edited).tolist() == [r["near_edited"] for r in got]
    assert iblt.likeness_of(own, own[1:] + own[:1]).tolist() == [r["near_next"] for r in got]
    assert len({r["near_edited"] for r in got}) > 20
    (keys, bounds), table = iblt.parsed(own)
    again = iblt.sketch(keys, np.repeat(np.arange(len(own)), np.diff(bounds)), len(own), iblt.CELLS)
    assert all((x == y).all() for x, y in zip(table, again))
