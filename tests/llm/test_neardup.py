import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from recordlake.llm import components, neardup
from recordlake.llm.shared import Scratch
from recordlake.llm.textkit import Batch

from .fixtures import corpus, frame, with_extra, words


def lower(w):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in w)


def shingle_set(text):
    w = [lower(x) for x in words(text)]
    if not w:
        return frozenset()
    return frozenset({tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})


def brute(rows):
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), low[find(i)], low[find(i)] == r[0]) for i, r in enumerate(rows))


def near_copies(seed, n):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(500)]
    rows = []
    for g in range(4):
        base = [r.choice(vocab) for _ in range(r.choice([30, 120]))]
        for _ in range(n):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocab).upper()
            rows.append((len(rows) + 1, " ".join(w), None, None, 0))
    return rows


def test_shingle_sets_and_keys():
    texts = [r[1] for r in corpus(6, 200)]
    v, b = neardup.shingles(Batch(pa.array(texts)))
    keys = neardup.set_keys(v, b)
    sets = [shingle_set(t) for t in texts]
    assert [len(s) for s in sets] == np.diff(b).tolist()
    by = {}
    for s, k in zip(sets, keys):
        assert by.setdefault(s, k) == k and (k is None) == (not s)
    assert len(set(by.values())) == len(by)


def test_signature_estimates_jaccard():
    base = [f"w{i}" for i in range(400)]
    other = base[:340] + [f"x{i}" for i in range(60)]
    a, b = " ".join(base), " ".join(other)
    v, at = neardup.shingles(Batch(pa.array([a, b])))
    s = neardup.signatures(v, at)
    x, y = shingle_set(a), shingle_set(b)
    assert abs((s[0] == s[1]).mean() - len(x & y) / len(x | y)) < 0.16


@pytest.mark.parametrize("block", [512, 7])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = near_copies(block, 25) + [(1000 + r[0] + i, *r[1:]) for i, r in enumerate(corpus(8, 100))]
    rows = list({r[0]: r for r in rows}.values())
    got = neardup.near_duplicates(with_extra(frame(spark, rows)))
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_repeated_rows_null_ids_and_empty(spark):
    t = "one two three four five six seven"
    rows = [(1, t, None, None, 0), (1, t, None, None, 0), (None, t, None, None, 0), (2, t + " ", None, None, 0), (3, None, None, None, 0), (4, "", None, None, 0), (5, " \n", None, None, 0)]
    got = Counter(tuple(r) for r in neardup.near_duplicates(frame(spark, rows)).collect())
    assert got == Counter({(1, 3, 1, True): 2, (None, 3, 1, False): 1, (2, 3, 1, False): 1, (3, 0, 3, True): 1, (4, 0, 4, True): 1, (5, 0, 5, True): 1})
    assert neardup.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark), "t").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def boilerplate(n, unique):
    """Pages that share one long passage and have words of their own, with some true copies among them."""
    r = random.Random(11)
    shared = ["b%d" % i for i in range(100)]
    rows = []
    for i in range(n):
        own = ["u%d_%d" % (i, k) for k in range(unique)]
        rows.append((i + 1, " ".join(shared + own), None, None, 0))
        if i % 9 == 0:
            own[r.randrange(unique)] = "changed"
            rows.append((5000 + i, " ".join(shared + own), None, None, 0))
    return rows


@pytest.mark.parametrize("rows", [near_copies(4, 40), boilerplate(120, 40), boilerplate(120, 20), near_copies(5, 25) + boilerplate(60, 30), corpus(4, 150)])
def test_large_groups_lose_no_link(spark, monkeypatch, rows):
    """With tiny limits every bucket and group is a large one."""
    monkeypatch.setattr(neardup, "BIG", 3)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(components, "FEW", 8)
    rows = [(10 * i, *r[1:]) for i, r in enumerate(rows)]
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == brute(rows)


def test_pairs_of_large_groups_grow_with_the_rows(spark, monkeypatch):
    """Boilerplate pages of which none is like another: rows that meet in cells stay linear."""
    monkeypatch.setattr(neardup, "BIG", 16)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    cells = []
    dealt = neardup._with_rest
    monkeypatch.setattr(neardup, "_with_rest", lambda rows: cells.append(dealt(rows)) or cells[-1])
    for n in (100, 200):
        rows = [r for r in boilerplate(n, 40) if r[0] < 5000]
        got = neardup.near_duplicates(frame(spark, rows)).collect()
        assert all(r["kept"] for r in got)
    assert [c.count() for c in cells] == [0, 0]  # they share no rare shingle
