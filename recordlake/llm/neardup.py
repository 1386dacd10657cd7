"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make the whole signature (C-MinHash): sigma scatters the
shingles over 0..2**32-1, and coordinate k is the minimum of
pi(sigma(x) + k modulo 2**32), the same pi circularly shifted by k.

Documents with equal shingle sets form a class; only classes are compared.
Bands of the signature make buckets; in a bucket (split into block pairs when
it is large) the signatures are compared, and a spanning forest of the pairs
with an estimate not clearly below the threshold leads to candidate groups.
Within a group every pair of classes is verified on full shingle sets, again in
block pairs; only a spanning forest of confirmed links leaves a task, so rows
stay linear in the classes while no link that changes a component is lost.

Large buckets and groups (over BIG classes) are not paired.  Such a bucket is one
candidate group as it stands.  Such a group is first verified inside blocks
alone, which unites what is alike, and its largest part needs no further pair of its
own.  The others meet by prefixes: two sets as similar as asked share one of the
rarest quarter of their shingles, in any common order, so shingles that are rare in the group
make buckets of a second level, exactly, and only buckets with a class outside the
largest part are verified.  Boilerplate pages, which share only frequent shingles,
never meet; copies are united before.
A link at exactly the threshold escapes the 32 bands of 4 with probability
5e-6, and the signature filter with 3e-6.

Defined results: null and empty texts, and texts without words, have no
shingles and stay alone; a null id is an id like others; rows with one id and
different texts are classes of their own and may have different components;
rows that repeat id and text are judged alike; texts of any length are taken
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import block_pairs, boundaries, components, forest, groups, join_by_share
from .shared import Filter, Scratch, partitions, quoted, session, slices
from .textkit import U64, Batch, mix, window_hash, window_starts

BANDS, ROWS = 32, 4
COORDS = BANDS * ROWS
FLOOR = 74  # of 128 coordinates: 4.5 standard deviations below the threshold of 0.75
BLOCK = 512
BIG = 8 * BLOCK  # classes of a bucket or group whose pairs are still compared block by block
SIGMA = 0x5851F42D4C957F2D


def shingles(t: Batch, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds): sorted distinct shingle hashes of each row.

    Words are lower-cased (A-Z); fewer than `width` words are one shingle.
    """
    h, b = t.word_hash(lower=True), t.word_bounds
    n = np.diff(b)
    per = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(per)])
    v = np.empty(at[-1], np.uint64)
    long = np.repeat(n >= width, per)
    v[long] = window_hash(h, width)[window_starts(b, width)]
    for k in range(1, width):
        rows = np.flatnonzero(n == k)
        if len(rows):
            s = mix(h[b[rows]], k)
            for j in range(1, k):
                s = mix(s ^ h[b[rows] + j], k)
            v[at[rows]] = s
    keep = np.ones(len(v), bool)
    for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
        if z - a > 1:
            v[a:z].sort()
    keep[1:] = v[1:] != v[:-1]
    keep[at[:-1][per > 0]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return v[keep], total[at]


def set_keys(v: np.ndarray, b: np.ndarray) -> list[bytes | None]:
    """128-bit key of each set (order plays no part); None for an empty set."""
    out = []
    for salt in (0x1234567, 0x89ABCDEF01):
        acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(v, salt), dtype=np.uint64)])
        out.append(acc[b[1:]] - acc[b[:-1]])
    both = np.stack(out, 1).tobytes()
    n = np.diff(b)
    return [both[16 * i : 16 * i + 16] if n[i] else None for i in range(len(n))]


def signatures(v: np.ndarray, b: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """Low 16 bits of every coordinate, one row per non-empty set."""
    rows = np.flatnonzero(np.diff(b) > 0)
    out = np.empty((len(rows), coords), np.uint16)
    x = (mix(v, SIGMA) >> U64(32)).astype(np.uint32)
    at = 0
    while at < len(rows):
        lo = b[rows[at]]
        upto = max(at + 1, int(np.searchsorted(b[rows], lo + 65536)))
        hi = b[rows[upto - 1] + 1]
        own, starts = x[lo:hi], b[rows[at:upto]] - lo
        y, z = np.empty_like(own), np.empty_like(own)
        for k in range(coords):
            np.add(own, np.uint32(k), out=y)
            np.right_shift(y, 16, out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, np.uint32(0x7FEB352D), out=y)
            np.right_shift(y, 15, out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, np.uint32(0x846CA68B), out=y)
            np.right_shift(y, 16, out=z)
            np.bitwise_xor(y, z, out=y)
            out[at:upto, k] = np.minimum.reduceat(y, starts)
        at = upto
    return out


def _features(batches):
    for b in slices(batches, 1):
        v, at = shingles(Batch(b.column(1)))
        keys = set_keys(v, at)
        sig = iter(signatures(v, at))
        sigs = [None if k is None else next(sig).tobytes() for k in keys]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), *b.columns[2:]],
            names=["doc_id", "n_shingles", "set_key", "sig", *b.schema.names[2:]],
        )


def _similar(batches):
    """Block pairs of buckets to a forest of pairs with similar signatures."""
    for t in groups(batches, ["key", "bi", "bj"]):
        starts = np.append(boundaries(t, ["key", "bi", "bj"]), t.num_rows)
        ids = t.column("cid").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(t.num_rows, COORDS)
        left, right = [], []
        n = np.diff(starts)
        two = starts[:-1][n == 2]
        if len(two):
            two = two[(sig[two] == sig[two + 1]).sum(1) >= FLOOR]
            left.extend(ids[two].tolist())
            right.extend(ids[two + 1].tolist())
        for a, z in zip(starts[:-1][n > 2].tolist(), starts[1:][n > 2].tolist()):
            s = sig[a:z]
            near = np.stack([(s == s[i]).sum(1) >= FLOOR for i in range(z - a)])
            for i, j in forest(near):
                left.append(int(ids[a + i]))
                right.append(int(ids[a + j]))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _sets(batches):
    """Class members' texts to their shingle sets."""
    for b in slices(batches, 0):
        v, at = shingles(Batch(b.column(0)))
        keys = set_keys(v, at)
        want = b.column(1).to_pylist()
        ok = [i for i in range(b.num_rows) if keys[i] == want[i]]
        blobs = [v[at[i] : at[i + 1]].tobytes() for i in ok]
        take = pa.array(ok, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column(2).take(take), b.column(3).take(take), b.column(4).take(take), pa.array(blobs, pa.binary())],
            names=["cid", "grp", "n", "shingle_set"],
        )


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix of 100 * intersection >= percent * union over all pairs."""
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    v = np.concatenate(sets)
    owner = np.repeat(np.arange(m), n)
    order = np.argsort(v, kind="stable")
    v, owner = v[order], owner[order]
    first = np.ones(len(v), bool)
    first[1:] = v[1:] != v[:-1]
    code = np.cumsum(first) - 1
    shared = np.bincount(code)[code] > 1
    code, owner = code[shared], owner[shared]
    common = np.zeros((m, m), np.float64)
    if len(code):
        _, code = np.unique(code, return_inverse=True)
        width = 4096
        cut = np.searchsorted(code, np.arange(0, code[-1] + 1 + width, width))
        for k in range(len(cut) - 1):
            part = slice(cut[k], cut[k + 1])
            x = np.zeros((m, width), np.float32)
            x[owner[part], code[part] - k * width] = 1
            common += x @ x.T
    union = n[:, None] + n[None, :] - common
    out = 100 * common >= percent * union
    np.fill_diagonal(out, False)
    return out


def _confirm(percent: int):
    def run(batches):
        for t in groups(batches, ["grp", "bi", "bj"]):
            starts = np.append(boundaries(t, ["grp", "bi", "bj"]), t.num_rows)
            ids, blobs = t.column("cid").to_pylist(), t.column("shingle_set")
            left, right = [], []
            for a, z in zip(starts[:-1].tolist(), starts[1:].tolist()):
                own = {}
                for i in range(a, z):
                    own.setdefault(ids[i], i)  # repeated rows carry the same set
                if len(own) < 2:
                    continue
                keys = list(own)
                sets = [np.frombuffer(blobs[i].as_py(), np.uint64) for i in own.values()]
                for i, j in forest(linked(sets, percent)):
                    left.append(keys[i])
                    right.append(keys[j])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _prefix_rows(batches):
    """(grp, cid, rest, shingle_set) to one row a shingle: (key of the group and shingle, cid, size, rest)."""
    for b in batches:
        for lo in range(0, b.num_rows, 64):
            part = b.slice(lo, 64)
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("shingle_set")]
            n = np.array([len(x) for x in sets], np.int64)
            group = np.repeat(mix(part.column("grp").to_numpy().astype(np.uint64), 5), n)
            key = mix(np.concatenate(sets) ^ group).view(np.int64)
            own = pa.array(np.repeat(np.arange(part.num_rows), n))
            yield pa.RecordBatch.from_arrays([pa.array(key), part.column("cid").take(own), pa.array(np.repeat(n, n)), part.column("rest").take(own)], names=["key", "cid", "size", "rest"])


def _with_rest(rows: DataFrame) -> DataFrame:
    """Rows (key, cid, rest, n, r), r of the key's n classes being in the rest, dealt to cells
    (bi, bj) so that every class of the rest meets every class of its key."""
    blocks = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("int")
    at = lambda salt, c: F.pmod(F.xxhash64(F.lit(salt), "cid"), blocks(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    right = rows.select("key", "cid", every("r").alias("bi"), at("all", "n").alias("bj"))
    left = rows.where("rest").select("key", "cid", at("rest", "r").alias("bi"), every("n").alias("bj"))
    return right.union(left).distinct()


def _verified(rows: DataFrame, p: int, percent: int) -> DataFrame:
    """Links (a, b), a spanning forest for each (grp, bi, bj) of rows with cid and shingle_set."""
    dealt = rows.repartition(p, "grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj")
    return dealt.select("grp", "bi", "bj", "cid", "shingle_set").mapInArrow(_confirm(percent), "a long, b long")


def _big_links(sets: DataFrame, scratch: Scratch, p: int, percent: int) -> DataFrame:
    """Links of groups too large for all their block pairs; no link between different parts is lost."""
    own = F.pmod(F.xxhash64("cid"), F.ceil(F.col("n") / F.lit(BLOCK))).cast("int")
    first = scratch.table(_verified(sets.withColumns({"bi": own, "bj": own}), p, percent), "first_links")
    part = components(first, scratch, "first").withColumnRenamed("label", "part")
    sets = sets.dropDuplicates(["cid"]).join(part, F.col("cid") == F.col("node"), "left").drop("node")
    sets = scratch.table(sets.withColumn("part", F.coalesce("part", "cid")), "big_sets")
    sizes = sets.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("k"))
    most = sizes.groupBy("grp").agg(F.max_by("part", F.struct("k", "part")).alias("most")).withColumnRenamed("grp", "g")
    sets = sets.join(most, F.col("grp") == F.col("g")).withColumn("rest", F.col("part") != F.col("most")).select("grp", "cid", "rest", "shingle_set")
    sets = scratch.table(sets, "marked")
    rows = scratch.table(sets.select("grp", "cid", "rest", "shingle_set").mapInArrow(_prefix_rows, "key long, cid long, size long, rest boolean"), "shingles")
    seen = rows.groupBy("key").agg(F.count(F.lit(1)).alias("often"), F.count_if("rest").alias("r")).where("often > 1 and r > 0")
    seen = scratch.table(seen.select("key", "often", F.col("often").alias("rows")), "seen")
    mine = join_by_share(rows, seen, "key", "rows").groupBy("cid", "size", "rest").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("s"))  # one set a row
    # shingles that can meet nobody come first in the order
    length = F.col("size") - F.floor((percent * F.col("size") + 99) / 100) + 1 - (F.col("size") - F.size("s"))
    keys = mine.select("cid", "rest", F.explode(F.slice("s", F.lit(1), F.greatest(length, F.lit(0)).cast("int"))).alias("x")).select("cid", "rest", "x.key")
    keys = scratch.table(keys, "prefixes")
    h = F.xxhash64("cid")
    count = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("rest").alias("r"), F.min(h).alias("lo"), F.max(h).alias("hi"), F.bit_xor(h).alias("mixed"))
    buckets = count.where("n > 1 and r > 0").groupBy("n", "r", "lo", "hi", "mixed").agg(F.min("key").alias("key")).select("key", "n", "r", F.col("n").alias("rows"))
    members = join_by_share(keys, scratch.table(buckets, "prefix_buckets"), "key", "rows")
    cells = _with_rest(members).withColumnRenamed("key", "grp").withColumnRenamed("cid", "own")
    met = cells.join(sets.select("cid", "shingle_set"), F.col("own") == F.col("cid"))
    return first.union(_verified(met, p, percent))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of `docs`."""
    out = _judged(docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text)).alias("text")), percent)
    return out.withColumnRenamed("doc_id", id_col)


def kept_rows(docs: DataFrame, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """Tables (doc_id, text_key, n) of what each component keeps, and (row_key) of all rows that are not simply kept.

    text_key is the text's hash and n how many rows have both; of several texts
    of the least id in one component, the one of least hash is kept.  Texts
    without words are all kept.  row_key is xxhash64 of the two.
    """
    scratch = Scratch(session(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    judged = scratch.table(_judged(rows, percent, ["text_key"], ["label"]).select("doc_id", "text_key", "label", "kept"), "judged")
    per = judged.where("kept").groupBy("label", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.col("label").isNull(), F.struct("doc_id", "text_key"))
    kept = scratch.table(per.groupBy("label", own.alias("own")).agg(F.min(F.struct("doc_id", "text_key", "n")).alias("x")).select("x.*"), "kept")
    key = F.xxhash64("doc_id", "text_key").alias("row_key")
    others = judged.select(key).join(kept.where("n = 1").select(key), "row_key", "left_anti")
    return kept, scratch.table(others.union(kept.where("n > 1").select(key)).distinct(), "others")


def _judged(docs: DataFrame, percent: int, extra: list[str] | None = None, labels: list[str] | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row, with its long columns `extra`, and with
    the component's own name where `labels` asks for it (one id may be the least of two components)."""
    extra, labels = extra or [], labels or []
    spark = session(docs)
    scratch, p = Scratch(spark), partitions(session(docs))
    more = "".join(f", {k} long" for k in extra)
    feats = scratch.table(docs.mapInArrow(_features, f"doc_id long, n_shingles long, set_key binary, sig binary{more}"), "features")
    # a class has one shingle set; longs name the classes from here on
    classes = feats.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("n"))
    classes = scratch.table(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.col("sig").substr(k * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    keys = classes.select(F.explode(band).alias("key"), "cid")
    h = F.xxhash64("cid")
    count = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(h).alias("lo"), F.max(h).alias("hi"), F.bit_xor(h).alias("mixed"))
    # bands that bring the same classes together are one bucket
    buckets = count.where("n > 1").groupBy("n", "lo", "hi", "mixed").agg(F.min("key").alias("key")).select("key", "n", F.col("n").alias("rows"))
    buckets = scratch.table(buckets, "buckets")
    members = scratch.table(join_by_share(keys, buckets, "key", "rows"), "members")
    signed = members.where(F.col("n") <= BIG).join(classes.select("cid", "sig"), "cid")
    dealt = block_pairs(signed, "key", "cid", BLOCK)
    dealt = dealt.repartition(p, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    near = dealt.select("key", "bi", "bj", "cid", "sig").mapInArrow(_similar, "a long, b long")
    bucket = -1 - F.col("key").bitwiseAND(F.lit((1 << 63) - 1))  # a large bucket is a node of its own, below all classes
    near = near.union(members.where(F.col("n") > BIG).select(F.col("cid").alias("a"), bucket.alias("b")))
    group = components(scratch.table(near, "near"), scratch, "groups")
    group = scratch.table(group.where("node >= 0"), "group")
    sizes = group.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("rows"))
    sized = join_by_share(group, scratch.table(sizes, "sizes"), "label", "rows")
    want = classes.select("set_key", "cid", F.col("doc_id").alias("rep")).join(sized, F.col("cid") == F.col("node"))
    want = scratch.table(want.select("set_key", "cid", "rep", F.col("label").alias("grp"), "n"), "wanted")
    # only the texts of classes in a group are read again for their full sets; few others pass the filter
    few = Filter(scratch, want, "rep", "filter").mark(docs.select("doc_id", "text"), F.col("doc_id"), "maybe").where("maybe")
    texts = few.join(want.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("rep"))).select("text", "set_key", "cid", "grp", "n")
    sets = scratch.table(texts.mapInArrow(_sets, "cid long, grp long, n long, shingle_set binary"), "sets")
    links = _verified(block_pairs(sets.where(F.col("n") <= BIG), "grp", "cid", BLOCK), p, percent)
    large = sets.where(F.col("n") > BIG)
    if not large.isEmpty():
        links = links.union(_big_links(large, scratch, p, percent))
    links = scratch.table(links, "links")
    label = scratch.table(components(links, scratch, "linked"), "label")

    named = classes.select("cid", "doc_id").join(label, F.col("cid") == F.col("node")).select("cid", "doc_id", "label")
    least = scratch.table(named.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    linked_to = join_by_share(named, least, "label").select(F.col("cid").alias("c"), "component_id", "label")
    of = classes.join(linked_to, F.col("cid") == F.col("c"), "left")
    of = of.select("set_key", "n", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("label", "cid").alias("label"))
    of = scratch.table(of, "of")
    scratch.drop("members", "buckets", "near", "group", "sizes", "wanted", "filter", "sets", "links", "label", "least", "classes")
    rows = feats.select("doc_id", "n_shingles", "set_key", *extra)
    none = F.lit(None).cast("long")
    alone = rows.where("set_key is null").withColumns({"component_id": F.col("doc_id"), "label": none})
    out = join_by_share(rows.where("set_key is not null"), of, "set_key").unionByName(alone)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *extra, *labels)
