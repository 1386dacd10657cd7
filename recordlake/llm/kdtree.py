"""Exact k-means over kd-trees (the filtering algorithm), one tree for every run of rows of a partition.

Every node holds the number of its vectors, their integer sum and their box.  A
round walks each tree from the root with the list of centroids still possible: the
one nearest the middle of the box stays, and every other that is farther from
all points of the box (strictly, so no tie is lost) is pruned.  A node with one
centroid left is assigned whole, by its count and sum; leaves that keep several
are resolved point by point.  What a task sends is one sum for each centroid.

Trees are written once and read by every round.  Sums are integers, so neither
the order of rows nor the way they are dealt changes a result, and a task that
runs again gives the same rows.

Defined results: vectors that are null, have another number of components, or
hold nulls or non-finite numbers give no row; a component of 65,536 or more in size is an
error (distances would not fit in a long); rows that repeat count as often
as they stand; null ids come last among the starting centroids, equal ids by their
vectors; with fewer than `k` vectors there are as many centroids; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, session
from .vectors import SCALE, kept, matrices

TREE_ROWS = 4096  # vectors of one tree, half a MB of small integers
LEAF_ROWS = 64
EXACT = 1 << 22  # below this in size, products of 64 components are exact as doubles
_TREE = "n int, width int, points binary, low binary, high binary, sums binary"


def bounds(n: int) -> list[np.ndarray]:
    """Edges of the nodes of each level: halves of halves until a node has at most LEAF_ROWS points."""
    out = [np.array([0, n])]
    while np.diff(out[-1]).max() > LEAF_ROWS:
        e = out[-1]
        half = np.empty(2 * len(e) - 1, np.int64)
        half[::2], half[1::2] = e, (e[:-1] + e[1:]) // 2
        out.append(half)
    return out


class Tree:
    """A balanced kd-tree; arrays of nodes go level by level."""

    def __init__(self, points: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.points, self.low, self.high, self.sums = points, low, high, sums
        self.levels = bounds(len(points))

    @classmethod
    def build(cls, x: np.ndarray) -> tuple[Tree, np.ndarray]:
        """(tree, order): every node is cut at the median of the widest side of its box."""
        order, levels = np.arange(len(x)), bounds(len(x))
        low, high, sums = [], [], []
        for k, edges in enumerate(levels):
            own = x[order]
            low.append(np.minimum.reduceat(own, edges[:-1]))
            high.append(np.maximum.reduceat(own, edges[:-1]))
            sums.append(np.add.reduceat(own, edges[:-1]))
            if k + 1 < len(levels):
                widest, middle = (high[-1] - low[-1]).argmax(1), levels[k + 1][1::2]
                for a, m, z, d in zip(edges[:-1], middle, edges[1:], widest):
                    order[a:z] = order[a:z][np.argpartition(own[a:z, d], m - a)]
        return cls(x[order], np.concatenate(low), np.concatenate(high), np.concatenate(sums)), order

    def visit(self, c: np.ndarray):
        """Yields (first point, one past the last, centroid, sum of the points) of whole nodes
        and (points, their centroids) of leaves with several possible centroids."""
        nodes, alive, begin = np.array([0]), np.ones((1, len(c)), bool), 0
        for level, edges in enumerate(self.levels):
            low, high = self.low[begin + nodes], self.high[begin + nodes]
            middle = ((low + high)[:, None, :] - 2 * c) ** 2
            best = np.where(alive, middle.sum(2), np.iinfo(np.int64).max).argmin(1)
            away = c - c[best][:, None, :]
            corner = np.where(away > 0, high[:, None, :], low[:, None, :])  # where a centroid does best against the best one
            alive &= (away * (c + c[best][:, None, :] - 2 * corner)).sum(2) <= 0
            one = alive.sum(1) == 1
            for i, owner in zip(nodes[one], best[one]):
                yield edges[i], edges[i + 1], int(owner), self.sums[begin + i]
            if level + 1 < len(self.levels):
                begin += len(edges) - 1
                nodes, alive = np.stack([2 * nodes[~one], 2 * nodes[~one] + 1], 1).ravel(), alive[~one].repeat(2, axis=0)
                if not len(nodes):
                    return
            else:
                left = nodes[~one]
                sizes = edges[left + 1] - edges[left]
                at = np.repeat(edges[left] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                if len(at):
                    yield at, nearest(self.points[at], c, alive[~one].repeat(sizes, axis=0))

    def totals(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, sums) of the centroids' points."""
        counts, sums = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for found in self.visit(c):
            if len(found) == 4:
                a, z, owner, total = found
                counts[owner] += z - a
                sums[owner] += total
            else:
                at, owners = found
                counts += np.bincount(owners, minlength=len(c))
                for k in range(len(c)):
                    sums[k] += self.points[at[owners == k]].sum(0)
        return counts, sums

    def owners(self, c: np.ndarray) -> np.ndarray:
        """The centroid of every point."""
        out = np.empty(len(self.points), np.int32)
        for found in self.visit(c):
            if len(found) == 4:
                out[found[0] : found[1]] = found[2]
            else:
                out[found[0]] = found[1]
        return out


def nearest(x: np.ndarray, c: np.ndarray, possible: np.ndarray) -> np.ndarray:
    """The nearest possible centroid of every point, exactly; the smaller number among equals."""
    if max(np.abs(x).max(), np.abs(c).max()) < EXACT and x.shape[1] <= 64:
        d = (c.astype(float) ** 2).sum(1) - 2 * (x.astype(float) @ c.T.astype(float))
        return np.where(possible, d, np.inf).argmin(1)
    d = (c**2).sum(1) - 2 * (x @ c.T)
    return np.where(possible, d, np.iinfo(np.int64).max).argmin(1)


def plant(batches, dims: int):
    """Rows of _TREE and the ids in tree order, from batches of (id, vector)."""
    ids, rows, n = [], [], 0

    def tree():
        x, own = np.concatenate(rows), pa.concat_arrays(ids)
        t, order = Tree.build(x)
        width = 2 if np.abs(x).max() < 1 << 15 else 4
        pack = lambda a, w: pa.array([a.astype(f"<i{w}").tobytes()], pa.binary())
        listed = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), own.take(pa.array(order)))
        cols = [pa.array([len(x)], pa.int32()), pa.array([width], pa.int32()), pack(t.points, width), pack(t.low, width), pack(t.high, width), pack(t.sums, 8), listed]
        return pa.RecordBatch.from_arrays(cols, names=["n", "width", "points", "low", "high", "sums", "ids"])

    for own, x in matrices(batches, dims):
        for lo in range(0, len(x), TREE_ROWS):
            part = x[lo : lo + TREE_ROWS]
            if n + len(part) > TREE_ROWS:
                yield tree()
                ids, rows, n = [], [], 0
            ids.append(own.slice(lo, len(part)))
            rows.append(part)
            n += len(part)
    if n:
        yield tree()


def trees(b: pa.RecordBatch, dims: int):
    """The trees of a batch, one at a time."""
    for i in range(b.num_rows):
        width = b.column("width")[i].as_py()
        read = lambda name, w: np.frombuffer(b.column(name)[i].as_buffer(), f"<i{w}").reshape(-1, dims).astype(np.int64)  # noqa: B023, E731
        yield i, Tree(read("points", width), read("low", width), read("high", width), read("sums", 8))


def cluster(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, seed: str = "3:") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector."""
    spark, rows = session(table), kept(table, id_col, vector, dims)
    id_type = rows.schema["id"].dataType.simpleString()
    scratch = Scratch(spark)
    name = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    first = rows.select(name.alias("name"), "v").orderBy(F.col("name").asc_nulls_last(), "v").limit(k).collect()
    c = np.floor(SCALE * np.array([r["v"] for r in first], np.float64)).astype(np.int64).reshape(-1, dims)
    planted = scratch.table(rows.mapInArrow(lambda batches: plant(batches, dims), f"{_TREE}, ids array<{id_type}>"), "trees")

    def add(batches):
        counts, sums = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for b in batches:
            for _, t in trees(b, dims):
                n, s = t.totals(c)
                counts += n
                sums += s
        every = np.concatenate([counts[:, None], sums], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c), dtype=np.int32)), pa.array(every.tolist(), pa.list_(pa.int64()))], names=["cluster", "sums"])

    for _ in range(rounds if len(first) else 0):
        sent = planted.select("n", "width", "points", "low", "high", "sums").mapInArrow(add, "cluster int, sums array<long>")
        each = sent.select("cluster", F.posexplode("sums").alias("d", "x")).groupBy("cluster", "d").agg(F.sum("x").alias("x"))
        got = {(r["cluster"], r["d"]): r["x"] for r in each.collect()}  # k * (dims + 1) numbers
        c = np.array([[got[i, d + 1] // got[i, 0] for d in range(dims)] if got[i, 0] else c[i].tolist() for i in range(len(c))], np.int64)

    def assign(batches):
        for b in batches:
            for i, t in trees(b, dims):
                own = t.owners(c)
                d = ((t.points - c[own]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([b.column("ids").slice(i, 1).flatten(), pa.array(own), pa.array(d)], names=["id", "cluster", "distance"])

    out = scratch.table(planted.mapInArrow(assign, f"id {id_type}, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: r["d"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.tolist()]
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values] or [F.lit(None).cast(kind)]), F.col("cluster") + 1)
    return out.select(
        F.col("id").alias(id_col),
        "cluster",
        "distance",
        pick([inertia.get(i, 0) for i in range(len(c))], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        pick(digests, "string").alias("centroid_sha256"),
    )
