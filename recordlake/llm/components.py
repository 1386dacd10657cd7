"""Connected components, block pairs and joins with hot keys on DataFrames; nothing is collected.

Nodes and keys are not null; an edge from a node to itself, and edges that
repeat, change nothing; no edges give no components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


#: A key with more than one row in SHARES (and more than FEW rows) is hot; there are less than SHARES of them.
SHARES, FEW = 1 << 16, 4096


def join_by_share(rows: DataFrame, table: DataFrame, key: str, count: str = "n", how: str = "inner") -> DataFrame:
    """Join (inner or left) of `rows` with a stored `table` of one row per key that says how many rows have it.

    Hot keys are joined by a broadcast of less than SHARES rows, whatever the
    data; of the others none has more than its share, so no task gets a long key.
    """
    total, most = table.agg(F.sum(count), F.max(count)).first()
    if (most or 0) <= FEW:
        return rows.join(table.drop(count), key, how)
    limit = max(FEW, total // SHARES)
    hot = F.broadcast(table.where(F.col(count) > limit).drop(count))
    cold = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col(count) <= limit).drop(count), key, how)
    return cold.unionByName(rows.join(hot, key))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) of every node in `edges` (a, b), longs without nulls; label is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014): minima are
    pre-aggregated, every step keeps at most as many edges as it got, and the
    number of rounds grows with the logarithm of the components' size.
    """
    def least(e: DataFrame, to: str) -> DataFrame:
        low = e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        return low if few else scratch.table(low, to)

    def neighbours(e: DataFrame, low: DataFrame) -> DataFrame:
        return e.join(low.drop("n"), "u") if few else join_by_share(e, low, "u")

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.table(e, f"{name}_0")
    few = 2 * e.count() <= FEW  # no key can be hot, so nothing need be counted first
    seen, k = None, 0
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours move to the least of the neighbourhood
        low = least(both, f"{name}_large_{k}")
        big = neighbours(both, low).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        big = big.where("u <> v").distinct()
        big = big if few else scratch.table(big, f"{name}_big_{k}")
        # small star: smaller neighbours and the node itself move to the least
        low2 = least(big, f"{name}_small_{k}")
        small = neighbours(big, low2).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e2 = scratch.table(small.union(low2.select("u", F.col("m").alias("v"))).distinct(), f"{name}_{k + 1}")
        state = tuple(e2.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        scratch.drop(f"{name}_{k}", f"{name}_large_{k}", f"{name}_big_{k}", f"{name}_small_{k}")
        e, k = e2, k + 1
        if state == seen:
            break
        seen = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select(F.col("v"), F.col("v"))).distinct()


def block_pairs(rows: DataFrame, group: str, member: str, size: int) -> DataFrame:
    """`rows` with column n (the group's rows) dealt to pairs of blocks of about `size` members.

    Every two members of a group meet in a block pair (bi <= bj); a row goes to
    ceil(n / size) pairs, so no task gets more than about twice `size` rows.
    """
    nb = F.ceil(F.col("n") / F.lit(size)).cast("int")
    out = rows.withColumn("nb", nb).withColumn("blk", F.pmod(F.xxhash64(member), F.col("nb")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return out.withColumn("bi", F.least("blk", "other")).withColumn("bj", F.greatest("blk", "other")).drop("nb", "blk", "other")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by `keys` (each table may hold many groups)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        change = boundaries(b, keys)
        if held and not _same(held[-1], held[-1].num_rows - 1, b, 0, keys):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        last = int(change[-1])
        if last == 0:
            held.append(b)
            continue
        yield pa.Table.from_batches([*held, b.slice(0, last)]).combine_chunks()
        held = [b.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _codes(col) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_binary(col.type) or pa.types.is_string(col.type):
        return col.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return col.to_numpy(zero_copy_only=False)


def boundaries(b, keys: list[str]) -> np.ndarray:
    """First rows of the groups."""
    new = np.zeros(b.num_rows, bool)
    new[:1] = True
    for k in keys:
        c = _codes(b.column(k))
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _same(a, i, b, j, keys) -> bool:
    return all(a.column(k)[i].as_py() == b.column(k)[j].as_py() for k in keys)


def forest(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the components of a symmetric boolean matrix."""
    n = len(adjacent)
    todo = np.ones(n, bool)
    out = []
    for root in range(n):
        if not todo[root]:
            continue
        todo[root] = False
        stack = [root]
        while stack:
            u = stack.pop()
            found = np.flatnonzero(adjacent[u] & todo)
            todo[found] = False
            for v in found.tolist():
                out.append((u, v))
                stack.append(v)
    return out
