"""Clusters, whitening and the kernel classifier against plain versions."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from recordlake.llm import kdtree, kernel, states, vectors, whitening
from recordlake.llm.shared import Scratch
from recordlake.llm.textkit import Batch

from .fixtures import corpus, frame, with_extra

VECS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def table(spark, rows, partitions=3):
    return spark.createDataFrame(rows, VECS).repartition(partitions)


def some_vectors(n=400, dims=64, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dims)) / 8
    x = centres[r.integers(0, 6, n)] + r.normal(size=(n, dims)) / 40
    rows = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    rows += [(7, rows[7][1]), (n + 1, rows[7][1])] * 5  # repeated rows and equal vectors
    return rows + [(None, rows[3][1]), (n + 2, None), (n + 3, []), (n + 4, [0.5] * 63), (n + 5, [None] * 64), (n + 6, [0.5] * 63 + [math.nan]), (n + 7, [math.inf] * 64)]


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    own = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(own(v), []).append(v)
        c = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c[j] for j in range(len(c))]
    found = [(i, own(v), far(v, c[own(v)])) for i, v in kept]
    total = {j: sum(d for _, o, d in found if o == j) for j in range(len(c))}
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, o, d, total[o], sum(total.values()), digest[o]) for i, o, d in found), key=str)


@pytest.mark.parametrize("n", [400, 5])
def test_clusters_equal_the_plain_version(spark, n):
    rows = some_vectors(n=max(n, 8))[:n] if n < 10 else some_vectors(n)
    got = kdtree.cluster(table(spark, rows))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(rows)


def test_clusters_ties_and_empty_clusters(spark):
    rows = [(i, [float(i % 2)] + [0.0] * 63) for i in range(20)]  # two places, eight centroids
    assert sorted(map(tuple, kdtree.cluster(table(spark, rows)).collect()), key=str) == plain_clusters(rows)


def test_clusters_of_nothing_other_columns_and_large_numbers(spark):
    assert kdtree.cluster(table(spark, [])).collect() == []
    assert kdtree.cluster(table(spark, [(1, None)])).collect() == []
    rows = some_vectors(60)
    clash = with_extra(table(spark, rows)).withColumnRenamed("embedding", "v").withColumnRenamed("vec_id", "cluster id")
    assert sorted(map(tuple, kdtree.cluster(clash, "cluster id", "v").collect()), key=str) == plain_clusters(rows)
    big = [(i, [1000.0 * ((i * 7 + j) % 50) + 0.25 for j in range(64)]) for i in range(60)]
    assert sorted(map(tuple, kdtree.cluster(table(spark, big)).collect()), key=str) == plain_clusters(big)
    with pytest.raises(Exception, match="need not fit in a long"):
        kdtree.cluster(table(spark, [(1, [70000.0] * 64)])).collect()


def test_trees_prune_and_stay_exact():
    r = np.random.default_rng(3)
    for dims in (1, 2, 64):
        c = r.integers(-900, 900, (8, dims))
        c[5] = c[2]  # equal centroids: the smaller number wins
        x = np.concatenate([c[r.integers(0, 8, 1500)] + r.integers(-9, 10, (1500, dims)), np.repeat(c[:1], 700, 0), r.integers(-900, 900, (300, dims))])
        tree, order = kdtree.Tree.build(x)
        assert (tree.points == x[order]).all()
        d = ((tree.points[:, None, :] - c) ** 2).sum(2)
        assert (tree.owners(c) == d.argmin(1)).all()
        counts, sums = tree.totals(c)
        assert counts.tolist() == np.bincount(d.argmin(1), minlength=8).tolist()
        assert all((sums[k] == tree.points[d.argmin(1) == k].sum(0)).all() for k in range(8))
        whole = sum(z - a for a, z, *_ in (f for f in tree.visit(c) if len(f) == 4))
        assert whole > 500  # at least the repeated vectors go by whole nodes
        with_ties = np.array([[0] * dims, [2] + [0] * (dims - 1)])
        middle, _ = kdtree.Tree.build(np.array([[1] + [0] * (dims - 1)] * 200))
        assert (middle.owners(with_ties) == 0).all()


def plain_whitening(rows):
    kept = [(i, [math.floor(1024 * x) + 100000 for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    n, s = len(kept), [sum(col) for col in zip(*[v for _, v in kept])]
    x = np.array([[(n * a - b) / n for a, b in zip(v, s)] for _, v in kept])
    e, q = np.linalg.eigh(x.T @ x / n)
    e, q = e[::-1], q[:, ::-1]
    return kept, n, s, x, e, q


@pytest.mark.parametrize("partitions", [3, 70])
def test_whitening_equals_the_plain_version(spark, partitions):
    rows = some_vectors()
    kept, n, s, x, e, q = plain_whitening(rows)
    got = whitening.whiten(with_extra(table(spark, rows, partitions))).collect()
    assert len(got) == 8 * len(kept)
    deviation = sorted((i, sum((n * a - b) ** 2 for a, b in zip(v, s))) for i, v in kept if i is not None)
    assert sorted((r["vec_id"], int(r["deviation"])) for r in got if r["component"] == 1 and r["vec_id"] is not None) == deviation
    for k in range(8):
        rows_k = [r for r in got if r["component"] == k + 1]
        assert all(r["n"] == n and r["explained"] == pytest.approx(e[k] / e.sum(), rel=1e-9) and r["identity_error"] < 1e-9 for r in rows_k)
        z = x @ q[:, k] / math.sqrt(e[k])
        want = {i: v for (i, _), v in zip(kept, z) if i is not None}
        mine = {r["vec_id"]: r["whitened"] for r in rows_k if r["vec_id"] is not None}
        top = max(want, key=lambda i: abs(want[i]))
        sign = math.copysign(1, want[top] * mine[top])
        assert all(mine[i] == pytest.approx(sign * want[i], abs=1e-7) for i in want)


def test_whitening_of_nothing_constants_and_lengths(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    same = whitening.whiten(table(spark, [(i, [0.5, 0.25]) for i in range(4)])).collect()
    assert {(r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(1, 4, 0, 0.0, 0.0, 0.0), (2, 4, 0, 0.0, 0.0, 0.0)}
    mixed = whitening.whiten(table(spark, [(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0]), (4, [0.0, 0.0, 1.0]), (5, [0.0, 1.0])])).collect()
    assert sorted({r["vec_id"] for r in mixed}) == [1, 2, 5]
    line = [r for r in mixed if r["component"] == 2]
    assert all(r["whitened"] == 0.0 and r["explained"] == pytest.approx(0, abs=1e-12) for r in line)  # all on one line


def test_eigen_solve_equals_the_library():
    r = np.random.default_rng(0)
    for n in (1, 2, 3, 8, 64):
        for a in (r.normal(size=(n, n)), np.zeros((n, n)), np.eye(n), np.ones((n, n)), np.diag(np.arange(n)) * 1e5):
            a = a @ a.T
            v, q = whitening.eigen(a)
            size = max(1.0, np.abs(a).max())
            assert np.allclose(v, np.linalg.eigvalsh(a)[::-1], atol=1e-10 * size)
            assert np.allclose(q @ np.diag(v) @ q.T, a, atol=1e-9 * size) and np.allclose(q.T @ q, np.eye(n), atol=1e-12)


def test_merged_updates_equal_one_stream():
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 5)) + 1e5
    whole = whitening.Welford(5)
    whole.add(x)
    parts = whitening.Welford(5)
    for lo, hi in ((0, 1), (1, 1), (1, 120), (120, 300)):
        w = whitening.Welford(5)
        w.add(x[lo:hi])
        parts.merge(w.n, w.mean, w.m)
    assert parts.n == whole.n == 300 and np.allclose(parts.mean, x.mean(0), rtol=1e-14)
    assert np.allclose(parts.covariance(), np.cov(x.T, bias=True), atol=1e-9) and np.allclose(whole.covariance(), parts.covariance(), atol=1e-9)


def test_states_are_merged_a_few_at_a_time(spark):
    rows = spark.createDataFrame([(i, 2 * i) for i in range(0, 100, 3)], "part long, x long")
    sizes = spark.sparkContext.accumulator(0)

    def fold(found):
        assert len(found) <= 4
        sizes.add(1)
        return {"x": sum(r["x"] for r in found)}

    assert states.fold_states(Scratch(spark), rows, fold, 4, "sums") == {"x": sum(2 * i for i in range(0, 100, 3))}
    assert sizes.value > 9
    assert states.fold_states(Scratch(spark), rows.where("part < 0"), fold, 4, "none") is None


def plain_statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not w:
        return [0.0] * len(kernel.STATISTICS)
    size = [len(x.encode()) for x in w]
    n, total = len(w), sum(size)
    mean = total / n
    runs = [tuple(w[i : i + 4]) for i in range(n - 3)]
    lines = [x.strip(" \t\x0b\x0c\r") for x in text.split("\n")]
    lines = [x for x in lines if x]
    body = text.encode()
    share = lambda chars: sum(body.count(bytes([c])) for c in chars) / total
    letter = re.compile(r"[A-Za-z\x80-\U0010ffff]")
    return [
        math.log1p(n), mean, math.sqrt(max(sum(s * s for s in size) / n - mean**2, 0)), math.log1p(max(size)), len(set(w)) / math.sqrt(n),
        1 - len(set(runs)) / len(runs) if runs else 1.0, math.log1p(len(lines)) - math.log1p(n), 1 - len(set(lines)) / len(lines),
        *[share(kernel._KINDS[k]) for k in ("symbols", "upper", "digits", "marks", "stops", "commas")],
        sum(c >= 192 for c in body) / total, sum(not letter.search(x) for x in w) / n,
    ]


def test_statistics_equal_the_plain_version():
    r = random.Random(5)
    texts = [t for _, t, *_ in corpus()] + ["", None, "\n\n", "a", "x\ny\nx\n", "a b c d a b c d a b c d", "HALLO!! 12 | *** é,\r\nz"]
    texts += ["".join(r.choice("aB é\n\t.!#1,") for _ in range(r.randint(0, 60))) for _ in range(200)]
    got = kernel.statistics(Batch(pa.array(texts)))
    for t, row in zip(texts, got):
        want = plain_statistics(t)
        if len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) in (1, 2, 3):
            want[5] = 1.0  # no run at all
        assert row == pytest.approx(want, abs=1e-9), repr(t)


def test_isotonic_is_the_least_squares_fit():
    r = random.Random(2)
    for _ in range(30):
        n = r.randint(1, 9)
        every = np.array([r.randint(1, 5) for _ in range(n)])
        good = np.array([r.randint(0, k) for k in every])
        got = kernel.isotonic(good, every)
        # the min-max formula: max over starts of the min over ends of the mean
        mean = lambda a, z: good[a : z + 1].sum() / every[a : z + 1].sum()  # noqa: B023, E731
        want = [max(min(mean(a, z) for z in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert got == pytest.approx(want)


def test_fit_equals_a_dense_one(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, len(kernel.STATISTICS)))
    y = (np.sin(x[:, 0]) + x[:, 1] > 0).astype(int)
    rows = [(i, [float(v) for v in x[i]], int(2 * y[i]), int(1 - y[i]), i % kernel.FOLDS) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x array<double>, good long, bad long, fold int").repartition(40)
    model = kernel.fit(df, features=256)
    w = 1 + y
    mean = (x * w[:, None]).sum(0) / w.sum()
    f = kernel.Fourier(mean, np.sqrt((x**2 * w[:, None]).sum(0) / w.sum() - mean**2), 256, kernel.WIDTH)
    z = f(x)
    penalty = np.diag([kernel.RIDGE * w.sum()] * 256 + [1e-9])
    want = np.linalg.solve(z.T @ (z * w[:, None]) + penalty, z.T @ (w * y))
    assert np.allclose(model.weights, want, atol=1e-8)
    assert (np.diff(model.curve) >= 0).all() and model.curve.min() >= 0 and model.curve.max() <= 1
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9


def test_features_approximate_the_kernel():
    r = np.random.default_rng(6)
    x = r.normal(size=(20, 16))
    f = kernel.Fourier(np.zeros(16), np.ones(16), 20000, kernel.WIDTH)
    z = f(x)[:, :-1]
    want = np.exp(-((x[:, None] - x) ** 2).sum(2) / (2 * kernel.WIDTH**2))
    assert np.abs(z @ z.T - want).max() < 0.05


def scored(spark, docs, labels):
    scratch = Scratch(spark)
    stats = scratch.table(kernel.with_statistics(docs), "s")
    return kernel.scores(stats, kernel.fit(scratch.table(kernel.labelled(stats, labels), "l")))


def test_quality_of_hard_cases(spark):
    docs = with_extra(frame(spark, corpus() + [(None, None, None, None, 0), (None, "a b", None, None, 3)] + corpus()[:5]))
    for rows in ([], [(3, 1)], [(3, 1), (3, 1), (6, 0), (9, 1), (None, 1), (12, None), (15, 5), (21, 0), (24, 1), (27, 0), (999999, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        got = scored(spark, docs, labels).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
        if len(rows) < 2:
            assert {r["score"] for r in got} == {1.0 if rows else 0.5}
    assert scored(spark, frame(spark, []), labels).collect() == []


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    got = scored(spark, spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    both = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    right = sum(r["predicted"] == r["quality"] for r in both) / len(both)
    assert len(both) > 500 and right > 0.98


def test_usable_vectors(spark):
    rows = some_vectors(10)
    assert vectors.kept(table(spark, rows), "vec_id", "embedding", 64).count() == 10 + 10 + 1
