import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from recordlake.llm import langid, linear, pieces, toxicity
from recordlake.llm.textkit import Batch

from .fixtures import corpus, frame, with_extra

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    r = random.Random(1)
    chars = list("abcdeéñ日本語 \n\t<>0x▁ﬁＡ́😀  xyz.,!?'\"-_/\\(){}[]=+*&^%$#@")
    out = ["".join(r.choice(chars) for _ in range(r.randint(0, 150))) for _ in range(200)]
    return out + ["", " ", "  ", "<s> </s> <unk> <0x0A>", "a" * 300, " " * 50, "hello   world    x", "international internationally interns"]


def test_pieces_equal_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    t = texts()
    enc = pieces.PieceEncoder(pieces.Model.load(open(MODEL, "rb").read()))
    for _ in range(2):  # the second time from memory
        ids, at, _, _ = enc.encode(Batch(pa.array(t)))
        got = [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:])]
        assert got == [sp.encode(x) for x in t]
        assert [x.decode() for x in enc.decode(ids, at)] == [sp.decode(x) for x in got]


def test_carriage_returns_equal_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(7)
    parts = ["\r", "\r\n", "\r\r", "\n", "\t", "\x0b", "\x00", " ", "  ", ";", ".", ")", "'", '"', "}", "*/", "end", "é", "日", "▁"]
    t = ["a;\r\nb", "end. \r\nnext", "\r", "\r\n" * 40, "\r" * 500, "if (x) {\r\n    y();\r\n}\r\n"]
    t += ["".join(r.choice(parts) for _ in range(r.randint(1, 60))) for _ in range(500)]
    rows = [(i, x, None, None, len(x)) for i, x in enumerate(t)]
    got = {x["doc_id"]: x for x in pieces.encode_decode(frame(spark, rows), MODEL).collect()}
    for i, x in enumerate(t):
        want = sp.encode(x)
        assert np.frombuffer(got[i]["ids"], "<i4").tolist() == want and got[i]["n_tokens"] == len(want)
        assert got[i]["round_trip"] == ("▁" not in x)


def test_unigram_search_finds_the_best_path():
    r = random.Random(2)
    vocab = {"".join(r.choice("ab") for _ in range(r.randint(1, 4))) for _ in range(14)} | {"a", "b"}
    scored = {p: (i, -r.random() * 5) for i, p in enumerate(sorted(vocab))}
    model = pieces.Model(scored, {}, 99, "unigram", [])

    def best(w):
        return 0.0 if not w else max(scored[w[:k]][1] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in scored)

    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(60)})
    score = {i: s for i, s in scored.values()}
    for w, (ids, top, parts) in zip(words, model.encode_sorted(words)):
        assert sum(score[i] for i in ids) == pytest.approx(best(w)) == pytest.approx(top)
        assert len(ids) == parts


def test_viterbi_columns_are_the_maximum_over_all_splits(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}

    def best(w):
        top = [0.0]
        for d in range(1, len(w) + 1):
            top.append(max([top[k] + score[w[k:d]] for k in range(d) if w[k:d] in score] + [top[d - 1] - 1e6]))
        return top[-1]

    rows = [(i, t, None, None, 0) for i, t in enumerate(["hello world, hello", "internationally 日本 x", "a", "", None])]
    for r in pieces.encode_decode(frame(spark, rows), MODEL).collect():
        t = rows[r["doc_id"]][1] or ""
        words = ["▁" + x for x in t.split(" ")] if t else []
        assert r["viterbi_score"] == pytest.approx(sum(best(w) for w in words))
        assert len(words) <= r["viterbi_pieces"] <= len(t) + len(words)


def test_encode_decode_rows(spark):
    rows = corpus(4, 60)
    got = pieces.encode_decode(with_extra(frame(spark, rows)), MODEL).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = Counter((r[0], tuple(sp.encode(r[1] or ""))) for r in rows)
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<i4").tolist())) for r in got) == want
    assert all(r["round_trip"] for r in got)
    assert pieces.encode_decode(frame(spark, rows).limit(0), MODEL).count() == 0


def speech(seed, n):
    r = random.Random(seed)
    parts = {"en": ["the", "ing", "tion", "and", "sh"], "de": ["der", "sch", "ung", "ein", "ü"], "fr": ["eau", "oui", "é", "le", "ment"]}
    rows = []
    for i in range(n):
        lang = r.choice(list(parts))
        w = ["".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 60))]
        rows.append((i, " ".join(w), lang if r.random() < 0.9 else None, lang, 0))
    return rows


def test_language_on_held_out_documents(spark):
    rows = speech(3, 400) + [(900, None, "en", None, 0), (901, "12 34 !", "en", None, 0), (None, "the the", "en", None, 0)]
    df = with_extra(frame(spark, rows))
    model = langid.fit(df)
    got = langid.identify(df, model).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[3] for r in rows}
    by = {r["doc_id"]: r for r in got}
    assert by[900]["lang_pred"] == by[901]["lang_pred"] == "und" and by[900]["score"] == 0
    held = [r for r in got if r["held_out"] and truth[r["doc_id"]]]
    assert held and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    # texts of held-out documents play no part
    import zlib

    other = [(k, t if zlib.crc32(str(k).encode()) % 3 != 1 else "zzz", la, s, n) for k, t, la, s, n in rows if k is not None]
    assert np.array_equal(langid.fit(frame(spark, other + [(None, "the the", "en", None, 0)], 2)).weights, model.weights)


def test_language_without_training_rows(spark):
    df = frame(spark, [(1, "hello", None, None, 0)])
    assert [r["lang_pred"] for r in langid.identify(df, langid.fit(df)).collect()] == ["und"]
    assert langid.identify(df.limit(0), langid.fit(df.limit(0))).count() == 0


def test_ngram_counts_against_plain_counting():
    t = ["Ab  c1d", "", None, "ÉÉ"]
    x, has = langid.ngram_counts(t, 1 << 20)
    assert has.tolist() == [True, False, False, True]
    assert np.diff(x.indptr).tolist()[1:3] == [0, 0]
    # "ab c d": letters and separators; 6 + 5 + 4 n-grams
    assert x.value[: x.indptr[1]].sum() == 6 + 5 + 4


def test_ordinal_regression_recovers_order():
    r = np.random.default_rng(4)
    n, f = 1500, 30
    hit = r.random((n, f)) < 0.1
    w = np.zeros(f)
    w[:4] = [4.0, 3.0, -3.0, 5.0]
    grade = np.digitize(hit @ w + r.logistic(size=n) * 0.5, [1.5, 3.5, 6.0])
    rows = [np.flatnonzero(h) for h in hit]
    x = linear.Sparse(np.concatenate([[0], np.cumsum([len(i) for i in rows])]), np.concatenate(rows), np.ones(sum(map(len, rows))))
    got, cut = linear.train_ordinal(x, grade, 4, f, 0.5, 0.1, 0.001, 20)
    assert (np.diff(cut) > 0).all()
    e = linear.expected_grade(x.dot(got[:, None])[:, 0], cut)
    means = [e[grade == k].mean() for k in range(4)]
    assert means == sorted(means) and np.corrcoef(e, grade)[0, 1] > 0.8


def test_toxicity(spark):
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(vocab) for _ in range(r.randint(5, 60))]
        bad = i % 5 == 0
        for _ in range(r.randint(1, 6) if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(["Idiot,", "moron", "SCUM!"]))
        rows.append((i, " ".join(w), None, None, int(bad)))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    rows.append((9999, None, None, None, 0))
    df, lab = with_extra(frame(spark, rows)), spark.createDataFrame(labels + [(0, 1, None)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in toxicity.severities(df, toxicity.fit(df, lab)).collect()}
    assert len(got) == len(rows) and got[9999]["severity"] < 0.5
    right = [got[x[0]]["toxic"] == bool(x[4]) for x in rows]
    assert np.mean(right) > 0.98
    none = toxicity.fit(df, lab.limit(0))
    assert all(x["severity"] == 0 for x in toxicity.severities(df.limit(5), none).collect())


def test_ftrl_equals_a_dense_one():
    r = np.random.default_rng(3)
    n, f, c = 90, 12, 3
    dense = (r.random((n, f)) < 0.3) * r.random((n, f))
    y = r.integers(0, c, n)
    rows = [np.flatnonzero(d) for d in dense]
    x = linear.Sparse(np.concatenate([[0], np.cumsum([len(i) for i in rows])]), np.concatenate(rows), np.concatenate([d[i] for d, i in zip(dense, rows)]))
    got = linear.train_multinomial(x, y, c, f, alpha=0.7, l1=0.02, l2=0.1, epochs=3, batch=8, seed=5)
    z, s, order = np.zeros((f + 1, c)), np.zeros((f + 1, c)), np.random.default_rng(5)
    for _ in range(3):
        perm = order.permutation(n)
        for lo in range(0, n, 8):
            part = perm[lo : lo + 8]
            m = np.concatenate([dense[part], np.ones((len(part), 1))], 1)
            w = np.zeros((f + 1, c))
            for i in range(f + 1):
                for k in range(c):
                    if abs(z[i, k]) > 0.02:
                        w[i, k] = -(z[i, k] - np.sign(z[i, k]) * 0.02) / ((1 + np.sqrt(s[i, k])) / 0.7 + 0.1)
            e = np.exp(m @ w)
            g = m.T @ (e / e.sum(1, keepdims=True) - np.eye(c)[y[part]]) / len(part)
            z += g - (np.sqrt(s + g * g) - np.sqrt(s)) / 0.7 * w
            s += g * g
    want = np.where(np.abs(z) > 0.02, -(z - np.sign(z) * 0.02) / ((1 + np.sqrt(s)) / 0.7 + 0.1), 0.0)
    assert np.allclose(got, want) and (got == 0).any() and (got != 0).any()


def test_temperature_is_the_least_loss():
    r = np.random.default_rng(6)
    scores, y = r.normal(size=(200, 4)) * 3, r.integers(0, 4, 200)
    loss = lambda t: -np.log(linear.softmax(scores / t)[np.arange(200), y]).mean()
    best = linear.temperature(scores, y)
    assert loss(best) <= min(loss(t) for t in np.exp(np.linspace(np.log(0.02), np.log(50), 400))) + 1e-6


def test_ordinal_step_follows_the_gradient():
    """One batch: the first step of the weights is the numerical gradient of -log p, scaled by FTRL."""
    r = np.random.default_rng(8)
    n, f, grades = 40, 6, 4
    dense = (r.random((n, f)) < 0.5).astype(float)
    y = np.concatenate([np.arange(grades), r.integers(0, grades, n - grades)])
    rows = [np.flatnonzero(d) for d in dense]
    x = linear.Sparse(np.concatenate([[0], np.cumsum([len(i) for i in rows])]), np.concatenate(rows), np.ones(sum(map(len, rows))))
    share = np.clip(np.cumsum(np.bincount(y, minlength=grades))[:-1] / n, 0.01, 0.99)
    start = np.log(share / (1 - share))
    cut = start[0] + np.concatenate([[0.0], np.cumsum(np.maximum(0.1, np.diff(start)))])

    def loss(w):
        below = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(-(cut[None] - (dense @ w)[:, None]))), np.ones((n, 1))], 1)
        return -np.log(below[np.arange(n), y + 1] - below[np.arange(n), y]).mean()

    g = np.array([(loss(1e-5 * e) - loss(-1e-5 * e)) / 2e-5 for e in np.eye(f)])
    got, _ = linear.train_ordinal(x, y, grades, f, alpha=0.5, l1=0.0, l2=0.0, epochs=1, batch=n)
    assert np.allclose(got, -g / ((1 + np.abs(g)) / 0.5), atol=1e-6)


def test_document_frequencies_and_tfidf_against_plain_counting(spark):
    rows = speech(5, 80)
    n, df = langid.document_frequencies(frame(spark, rows).select("text"))
    plain = np.zeros(langid.DIMS, np.int64)
    for _, t, *_ in rows:
        x, _ = langid.ngram_counts([t])
        plain[x.index] += 1
    assert n == len(rows) and np.array_equal(df, plain)
    x, _ = langid.ngram_counts([r[1] for r in rows])
    norm = np.bincount(np.repeat(np.arange(len(x)), np.diff(x.indptr)), weights=langid.tfidf(x, np.ones(langid.DIMS)).value ** 2)
    assert np.allclose(norm, 1)


def test_learned_operators_on_repeated_rows_and_budgets(spark, monkeypatch):
    rows = speech(9, 60)
    twice = langid.identify(frame(spark, rows + rows), langid.fit(frame(spark, rows + rows))).collect()
    assert all(v == 2 for v in Counter((r["doc_id"], r["lang_pred"], r["score"]) for r in twice).values())
    monkeypatch.setattr(langid, "ENTRIES", 300)  # a few documents of each language
    assert set(langid.fit(frame(spark, rows)).langs) == {"en", "de", "fr"}
    docs = [(i, "bad word here " * 3 if i % 2 else "fine text there", None, None, 0) for i in range(40)]
    lab = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] * 2, "doc_id long, quality int, toxic int")
    got = toxicity.severities(frame(spark, docs + docs), toxicity.fit(frame(spark, docs + docs), lab)).collect()
    assert len(got) == 80 and all(r["toxic"] == bool(r["doc_id"] % 2) for r in got)
    assert toxicity.severities(frame(spark, docs).limit(0), toxicity.fit(frame(spark, docs).limit(0), lab)).count() == 0
