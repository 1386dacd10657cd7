"""Whole fits against slow versions: the rule learner, both regressions, and the chained pipeline."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordlake.llm import langid, mixing, pieces, rules, stages, toxicity
from recordlake.llm.textkit import Batch, span_hash

from .fixtures import corpus, frame
from .test_learned_and_pieces import MODEL, speech
from .test_neardup import near_copies
from .test_rules_huffman import junk


def gain(p, n, p0, n0):
    return -math.inf if p <= 0 else p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def slow_covering(rows, names, bins=32, max_rules=8, max_conditions=3, precision=0.95, least=5):
    """Sequential covering by counting every row for every threshold; rows are (bad, prune, features)."""
    levels = [(i + 1) / (bins + 1) for i in range(bins)]

    def quantiles(v):
        v = sorted(v)
        return [v[max(0, math.ceil(q * len(v)) - 1)] for q in levels]

    cuts = {n: sorted({*quantiles([f[n] for _, _, f in rows]), *quantiles([f[n] for b, _, f in rows if b])}) for n in names}
    holds = lambda c, f: (f[c[0]] >= c[2]) if c[1] else (f[c[0]] < c[2])
    count = lambda some, rule: (sum(b and all(holds(c, f) for c in rule) for b, _, f in some), sum(not b and all(holds(c, f) for c in rule) for b, _, f in some))
    out, left = [], rows
    while len(out) < max_rules:
        grown, inside = [], [r for r in left if not r[1]]
        while len(grown) < max_conditions:
            p0, g0 = count(inside, [])
            if not p0 or not g0:
                break
            best = (0.0, None)
            for n in names:
                for t in cuts[n]:
                    for at_least in (False, True):
                        p, g = count(inside, [(n, at_least, t)])
                        best = max(best, (gain(p, g, p0, g0), (n, at_least, t)), key=lambda x: x[0])
            if best[1] is None:
                break
            grown.append(best[1])
            inside = [r for r in inside if holds(best[1], r[2])]
        if not grown:
            break
        pruned = [r for r in left if r[1]]

        def worth(k):
            p, g = count(pruned, grown[: k + 1])
            return (p - g) / (p + g) if p + g else -1.0

        for upto in (max(range(len(grown)), key=lambda k: (worth(k), -k)), len(grown) - 1):
            p, g = count(left, grown[: upto + 1])
            if p >= least and p >= precision * (p + g):
                break
        else:
            break
        rule = grown[: upto + 1]
        out.append(rule)
        left = [r for r in left if not all(holds(c, r[2]) for c in rule)]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rules_equal_slow_covering(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(260):
        n = r.randint(20, 400)
        x = {"n_words": n, "word_chars": n * r.randint(3, 8), "n_symbols": r.choice([0, 0, r.randint(0, n)]), "n_dup_lines": r.choice([0, 0, 1, 5]), "n_repeat_words": r.randint(0, n // 4), "n_upper": r.randint(0, n), "n_marks": r.randint(0, 9)}
        bad = (x["n_symbols"] > n // 2) or (x["n_dup_lines"] == 5 and x["n_upper"] > n // 2) or r.random() < 0.03
        rows.append((i, int(not bad), *x.values()))
    schema = "doc_id long, quality int, " + ", ".join(f"{c} long" for c in (*rules.BASE, *rules.MORE))
    df = spark.createDataFrame([(a, b, *v) for a, b, *v in rows], schema)
    seen = df.select("doc_id", (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(3)) == 0).alias("p"), "quality", *[f().alias(n) for n, f in rules.FEATURES.items()]).collect()
    plain = [(x["quality"] == 0, x["p"], {n: x[n] for n in rules.FEATURES}) for x in seen]
    got = rules.learn(df).rules
    assert got == slow_covering(plain, list(rules.FEATURES)) and got


def dense_ftrl(x, y, classes, alpha, l1, l2, epochs, batch=32, seed=1):
    n, f = x.shape
    z, s, order = np.zeros((f + 1, classes)), np.zeros((f + 1, classes)), np.random.default_rng(seed)
    weights = lambda: np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((1 + np.sqrt(s)) / alpha + l2), 0.0)
    for _ in range(epochs):
        perm = order.permutation(n)
        for lo in range(0, n, batch):
            part = perm[lo : lo + batch]
            m, w = np.concatenate([x[part], np.ones((len(part), 1))], 1), weights()
            e = np.exp((m @ w) - (m @ w).max(1, keepdims=True))
            g = m.T @ (e / e.sum(1, keepdims=True) - np.eye(classes)[y[part]]) / len(part)
            z += g - (np.sqrt(s + g * g) - np.sqrt(s)) / alpha * w
            s += g * g
    return weights()


def test_language_fit_equals_a_dense_one(spark):
    rows = speech(11, 150)
    train = [r for r in rows if r[2] is not None and __import__("zlib").crc32(str(r[0]).encode()) % 3 != 1]
    counts = np.zeros((len(train), langid.DIMS))
    packed = []
    for i, r in enumerate(train):
        x, _ = langid.ngram_counts([r[1]])
        counts[i, x.index] = x.value
        packed.append((r[2], x.index.astype(np.int32).tobytes(), x.value.astype(np.int32).tobytes()))
    order = sorted(range(len(train)), key=lambda i: packed[i])
    counts, langs = counts[order], sorted({r[2] for r in train})
    y = np.array([langs.index(packed[i][0]) for i in order])
    idf = np.log((1 + len(train)) / (1 + (counts > 0).sum(0))) + 1
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    tune = np.arange(len(y)) % 5 == 4
    w = dense_ftrl(x[~tune], y[~tune], len(langs), 1.0, 1e-3, 1e-4, 8)
    model = langid.fit(frame(spark, rows))
    assert model.langs == langs and np.allclose(model.idf, idf) and np.allclose(model.weights, w, atol=1e-8)
    scores = x[tune] @ w[:-1] + w[-1]
    loss = lambda t: -np.log(np.maximum((e := np.exp(scores / t - (scores / t).max(1, keepdims=True))) / e.sum(1, keepdims=True), 1e-300)[np.arange(tune.sum()), y[tune]]).mean()
    assert loss(model.heat) <= min(loss(t) for t in np.exp(np.linspace(np.log(0.02), np.log(50), 300))) + 1e-6


def dense_ordinal(x, grade, grades, alpha, l1, l2, epochs, batch=32, seed=1):
    """Thresholds and weights by central formulas, every feature in every step."""
    n, f = x.shape
    z, s, order = np.zeros(f), np.zeros(f), np.random.default_rng(seed)
    share = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:-1] / n, 0.01, 0.99)
    start = np.log(share / (1 - share))
    free, speed = np.concatenate([start[:1], np.log(np.maximum(0.1, np.diff(start)))]), np.full(grades - 1, 1e-8)
    weights = lambda: np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((1 + np.sqrt(s)) / alpha + l2), 0.0)
    for _ in range(epochs):
        perm = order.permutation(n)
        for lo in range(0, n, batch):
            part = perm[lo : lo + batch]
            w, m, g = weights(), x[part], grade[part]
            cut = free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])
            grad, dcut = np.zeros(f), np.zeros(grades - 1)
            for row, k in zip(m, g):
                sig = lambda t: 1 / (1 + np.exp(-np.clip(t - row @ w, -30, 30)))  # noqa: B023, E731
                hi, low = (sig(cut[k]) if k < grades - 1 else 1.0), (sig(cut[k - 1]) if k else 0.0)
                p = max(hi - low, 1e-9)
                grad += row * (hi * (1 - hi) - low * (1 - low)) / p / len(part)
                if k < grades - 1:
                    dcut[k] -= hi * (1 - hi) / p / len(part)
                if k:
                    dcut[k - 1] += low * (1 - low) / p / len(part)
            z += grad - (np.sqrt(s + grad**2) - np.sqrt(s)) / alpha * w
            s += grad**2
            gaps = np.exp(free[1:])
            dfree = np.array([dcut.sum(), *[dcut[c:].sum() * gaps[c - 1] for c in range(1, grades - 1)]])
            speed += dfree**2
            free = free - 0.3 * dfree / np.sqrt(speed)
    return weights(), free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def test_toxicity_fit_equals_a_dense_one(spark):
    r = random.Random(12)
    rows, labels = [], []
    for i in range(120):
        bad = i % 3 == 0
        w = [f"w{r.randrange(40)}" for _ in range(r.randint(4, 25))] + [r.choice(["Idiot", "moron,"]) for _ in range(r.randint(1, 5) if bad else 0)]
        rows.append((i, " ".join(w), None, None, 0))
        labels.append((i, 1, int(bad)))
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    hash_of = lambda x: int(span_hash(np.frombuffer(x.encode(), np.uint8), np.array([0]), np.array([len(x)]))[0])
    texts = [Counter(hash_of(t) for t in re.findall(r"[a-z0-9]+", x[1].lower())) for x in rows]
    order = sorted(range(len(rows)), key=lambda i: (labels[i][2], np.array(sorted(texts[i]), np.uint64).tobytes(), np.array([texts[i][k] for k in sorted(texts[i])], np.int32).tobytes()))
    toxic, texts = np.array([labels[i][2] for i in order]), [texts[i] for i in order]
    terms = sorted({k for t in texts for k in t})
    counts = np.array([[t[k] for k in terms] for t in texts], float)
    t_rows, c_rows = (counts[toxic == 1] > 0).sum(0), (counts[toxic == 0] > 0).sum(0)
    marks = (t_rows >= toxicity.TERM_ROWS) & ((t_rows + 0.5) / (toxic.sum() + 1) >= toxicity.TERM_RATIO * (c_rows + 0.5) / ((toxic == 0).sum() + 1))
    uses = counts @ marks
    low, high = np.quantile(uses[toxic == 1], [1 / 3, 2 / 3])
    grade = np.where(toxic == 1, 1 + (uses > low) + (uses > high), 0).astype(int)
    common = (counts > 0).sum(0) >= toxicity.TERM_ROWS
    w, cut = dense_ordinal((counts[:, common] > 0).astype(float), grade, toxicity.GRADES, 0.3, 0.3, 0.01, max(10, 24000 // len(rows)))
    want = {k: v for k, v in zip(np.array(terms, np.uint64)[common].tolist(), w) if v != 0}
    got = dict(zip(model.terms.tolist(), model.weights))
    assert got.keys() == want.keys() and len(got) > 3 and np.allclose([got[k] for k in want], list(want.values()), atol=1e-6) and np.allclose(model.cut, cut, atol=1e-6)
    said = Batch(pa.array(["Idiot w1", "w1", ""]))
    assert model.severity(said)[0] > 0.5 > model.severity(said)[1]


def test_mixing_stage_repeats_rows_as_the_mix_says(spark):
    rows = corpus(8, 200)
    rows += rows[:40]  # repeated rows are mixed alike
    copies = Counter()
    for r in mixing.mix_sources(frame(spark, rows), keep=["text", "lang"]).collect():
        copies[(r["doc_id"], r["text"], r["lang"], r["source"])] += r["copies"]
    got = Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in stages.source_mixing(spark, frame(spark, rows), "").collect())
    assert got == +copies and max(got.values()) > 1


def test_run_is_its_stages_one_after_the_other(spark, tmp_path):
    rows = [(i, *r[1:3], ["a", "b", None][i % 3], r[4]) for i, r in enumerate(junk(4) + near_copies(6, 8) + corpus(9, 60))]
    at = str(tmp_path)
    frame(spark, rows).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], int("%%%" not in (r[1] or "")), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in stages.STAGES[:-1]:
        out = stage(spark, docs, at)
        docs = spark.createDataFrame(out.collect(), out.schema)
    enc = pieces.PieceEncoder(pieces.Model.load(open(MODEL, "rb").read()))
    want = Counter()
    for r in docs.collect():
        ids, *_ = enc.encode(Batch(pa.array([r["text"]])))
        want[(r["doc_id"], len(ids), ids.astype("<i4").tobytes())] += 1
    got = Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in corpus_pipeline.run(spark, at).collect())
    assert got == want and len(got) > 10
