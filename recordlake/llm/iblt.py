"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A paragraph ends at a line end (\\n) or behind a word whose hash says so, about
one in CUT_WORDS, so a long line is many paragraphs and an edit moves few of
them; the k-th copy of a paragraph in a text is a key of its own, so a text is a
set of 64-bit keys.  A sketch has three equal
parts; a key goes to one cell of each, and a cell holds a count, the sum of its
keys and the sum of their check values.  Sketches of two versions subtract;
cells with one key left are peeled until nothing remains, which recovers the
differing paragraph digests.  Where peeling gets stuck, both versions are
sketched again in twice as many cells.  A fingerprint is a text's sketch and, for the
larger ones, its digests, so two fingerprints are all that their likeness needs.

Neighbours are found by one range partitioning of the (compressed) texts by id;
the first and last row of each partition meet in a second small step.

Defined results: a null text is an empty one, which has one empty paragraph; a
null id comes last in descending order; rows of one id follow each other by
their texts' hash; a single row is its own next document; an empty table gives
no rows; rows that repeat id and text are documents of their own; texts of any
length are taken whole; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, partitions, quoted, session
from .textkit import U64, Batch, mix, span_hash

CELLS, PARTS = 24, 3
SALTS = (0x11, 0x2222, 0x333333)
CHECK = 0x5EED5EED
CUT, CUT_WORDS = 0xC07, 32  # a word in 32 ends a paragraph


def paragraph_keys(t: Batch) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row bounds): one key per paragraph of each text."""
    lines = np.flatnonzero(t.data == 10)
    s, e, owner = t.words
    cut = (span_hash(t.data, s, e, CUT) >> U64(32)) % U64(CUT_WORDS) == 0
    cut[cut] = e[cut] < t.offsets[owner[cut] + 1]  # the text goes on
    cut[cut] = t.data[e[cut]] != 10  # and the line does
    ends = np.concatenate([lines, e[cut], t.offsets[1:]])
    rows = np.concatenate([np.searchsorted(t.offsets, lines, side="right") - 1, owner[cut], np.arange(t.n)])
    skip = np.concatenate([np.ones(len(lines), np.int64), np.zeros(int(cut.sum()) + t.n, np.int64)])  # the line end itself
    order = np.lexsort((ends, rows))
    ends, rows, skip = ends[order], rows[order], skip[order]
    first = np.ones(len(rows), bool)
    first[1:] = rows[1:] != rows[:-1]
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1] + skip[:-1]
    starts[first] = t.offsets[:-1]
    h = span_hash(t.data, starts, ends)
    order = np.lexsort((h, rows))
    r, v = rows[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    copy = np.arange(len(r)) - np.repeat(at, np.diff(np.append(at, len(r))))
    keys = mix(v + copy.astype(np.uint64) * U64(0x9E3779B97F4A7C15), 7)
    return keys, np.searchsorted(r, np.arange(t.n + 1))


def _cells(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    part = cells // PARTS
    return [((mix(keys, s) >> U64(32)) * U64(part) >> U64(32)).astype(np.int64) + i * part for i, s in enumerate(SALTS)]


def sketch(keys: np.ndarray, row: np.ndarray, rows: int, cells: int, into=None, sign: int = 1):
    """(count, key sum, check sum) arrays of rows x cells; adds or subtracts."""
    if into is None:
        into = (np.zeros(rows * cells, np.int64), np.zeros(rows * cells, np.uint64), np.zeros(rows * cells, np.uint64))
    k, c = keys, mix(keys, CHECK)
    if sign < 0:
        k, c = U64(0) - k, U64(0) - c
    for cell in _cells(keys, cells):
        at = row * cells + cell
        np.add.at(into[0], at, sign)
        np.add.at(into[1], at, k)
        np.add.at(into[2], at, c)
    return into


def peel(table, rows: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, sign) of all recovered keys and, per row, whether nothing remains."""
    count, total, check = (x.copy() for x in table)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = np.flatnonzero(np.abs(count) == 1)
    while len(at):
        sign = count[at]
        key = np.where(sign > 0, total[at], U64(0) - total[at])
        good = mix(key, CHECK) == np.where(sign > 0, check[at], U64(0) - check[at])
        row, key, sign = at[good] // cells, key[good], sign[good]
        order = np.lexsort((key, row))
        row, key, sign = row[order], key[order], sign[order]
        if not len(row):
            break
        once = np.ones(len(row), bool)
        once[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        row, key, sign = row[once], key[once], sign[once]
        found.append((row, key, sign))
        c = mix(key, CHECK)
        touched = []
        for cell in _cells(key, cells):
            to = row * cells + cell
            np.add.at(count, to, -sign)
            np.add.at(total, to, np.where(sign > 0, U64(0) - key, key))
            np.add.at(check, to, np.where(sign > 0, U64(0) - c, c))
            touched.append(to)
        touched = np.unique(np.concatenate(touched))
        at = touched[np.abs(count[touched]) == 1]
    left = (count != 0) | (total != 0) | (check != 0)
    done = ~left.reshape(rows, cells).any(1)
    if found:
        row, key, sign = (np.concatenate(x) for x in zip(*found))
    else:
        row, key, sign = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return row, key, sign, done


def differences(a, b, cells: int = CELLS, first=None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per row (digests only in a, digests only in b); a and b are (keys, bounds).

    Rows whose peeling fails are sketched again with twice the cells; `first` may
    give the subtracted sketches of the first round.
    """
    rows = len(a[1]) - 1
    out: list = [None] * rows
    todo = np.arange(rows)
    while len(todo):
        table, first = first, None
        if table is None:
            for (keys, bounds), sign in ((a, 1), (b, -1)):
                n = np.diff(bounds)[todo]
                own = np.repeat(np.arange(len(todo)), n)
                at = np.repeat(bounds[todo] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                table = sketch(keys[at], own, len(todo), cells, table, sign)
        row, key, sign, done = peel(table, len(todo), cells)
        order = np.argsort(row, kind="stable")
        row, key, sign = row[order], key[order], sign[order]
        cut = np.searchsorted(row, np.arange(len(todo) + 1))
        for i in np.flatnonzero(done).tolist():
            k, s = key[cut[i] : cut[i + 1]], sign[cut[i] : cut[i + 1]]
            out[todo[i]] = (k[s > 0], k[s < 0])
        todo, cells = todo[~done], cells * 2
    return out


def likeness(a, b, first=None) -> np.ndarray:
    """Shared share of the paragraphs of both (Jaccard), from the recovered differences."""
    delta = np.array([len(x) + len(y) for x, y in differences(a, b, first=first)], np.float64)
    both = (np.diff(a[1]) + np.diff(b[1])).astype(np.float64)
    return (both - delta) / np.maximum(1, both + delta)


_SKETCH = CELLS * (4 + 8 + 8)


def fingerprints(keys: np.ndarray, bounds: np.ndarray) -> list[str]:
    """Base64 of each text's sketch in CELLS cells (counts, key sums, check sums) and, for larger ones, its sorted keys."""
    rows = len(bounds) - 1
    row = np.repeat(np.arange(rows), np.diff(bounds))
    own = keys[bounds[0] : bounds[-1]]
    count, total, check = (x.reshape(rows, CELLS) for x in sketch(own, row, rows, CELLS))
    raw = np.concatenate([count.astype("<i4").view(np.uint8), total.astype("<u8").view(np.uint8), check.astype("<u8").view(np.uint8)], axis=1)
    own = own[np.lexsort((own, row))].astype("<u8")
    at = bounds - bounds[0]
    return [base64.b64encode(raw[i].tobytes() + own[at[i] : at[i + 1]].tobytes()).decode() for i in range(rows)]


def parsed(prints: list[str]):
    """((keys, bounds), sketches) of fingerprints."""
    raw = [base64.b64decode(p) for p in prints]
    keys = [np.frombuffer(r[_SKETCH:], "<u8") for r in raw]
    cell = lambda at, kind: np.concatenate([np.frombuffer(r, kind, CELLS, at) for r in raw])
    table = cell(0, "<i4").astype(np.int64), cell(4 * CELLS, "<u8"), cell(12 * CELLS, "<u8")
    return (np.concatenate(keys), np.concatenate([[0], np.cumsum([len(k) for k in keys])])), table


def likeness_of(a: list[str], b: list[str]) -> np.ndarray:
    """Likeness of pairs of fingerprints: their sketches subtract and are peeled; where that
    fails, sketches of twice the cells are made of the keys that the fingerprints carry."""
    if not len(a):
        return np.zeros(0)
    (x, p), (y, q) = parsed(a), parsed(b)
    return likeness(x, y, [u - v for u, v in zip(p, q)])


RESULT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(ids: list, texts: list[str]) -> list[pa.Array]:
    """Result columns of texts[:-1], each followed by its next document."""
    n = [len(t) for t in texts[:-1]]
    edited = [t[: k - k // 2] + nxt[: k // 2] for t, nxt, k in zip(texts, texts[1:], n)]
    own = fingerprints(*paragraph_keys(Batch(pa.array(texts, pa.large_string()))))
    new = fingerprints(*paragraph_keys(Batch(pa.array(edited, pa.large_string()))))
    digests = [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    values = [ids, n, digests, own[:-1], new, likeness_of(own[:-1], new), likeness_of(own[:-1], own[1:])]
    return [pa.array(v, t) for v, (_, t) in zip(values, RESULT)]


def _squeeze(batches):
    codec = pa.Codec("zstd")
    for b in batches:
        z = [(v.as_buffer().size).to_bytes(8, "little") + codec.compress(v.as_buffer(), asbytes=True) for v in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z, pa.binary()), b.column(2)], names=["doc_id", "z", "tie"])


def _open(z: bytes) -> str:
    return pa.decompress(z[8:], int.from_bytes(z[:8], "little"), codec="zstd", asbytes=True).decode()


def _chain(batches):
    """Rows in order: results of all but the last, and the edges with their texts."""
    part = TaskContext.get().partitionId()
    names = ["kind", "part", *[n for n, _ in RESULT], "z"]

    def edge(kind, d, z):
        cols = [pa.array([kind], pa.int32()), pa.array([part], pa.int64()), pa.array([d], pa.int64())]
        cols += [pa.nulls(1, t) for _, t in RESULT[1:]] + [pa.array([z], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=names)

    held = None  # (id, z) that waits for its next document
    for b in batches:
        ids, zs = b.column("doc_id").to_pylist(), b.column("z")
        at = 0
        while at < len(ids):
            run, size = [], 0
            while at < len(ids) and (not run or size < 4 << 20):
                z = zs[at].as_py()
                run.append((ids[at], z))
                size += int.from_bytes(z[:8], "little")
                at += 1
            if held is None:
                yield edge(1, *run[0])
            else:
                run.insert(0, held)
            held = run[-1]
            if len(run) > 1:
                k = len(run) - 1
                cols = compare([d for d, _ in run[:-1]], [_open(z) for _, z in run])
                yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), pa.array([part] * k, pa.int64()), *cols, pa.nulls(k, pa.binary())], names=names)
    if held is not None:
        yield edge(2, *held)


def _last(batches):
    for b in batches:
        for d, z, nz in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            cols = compare([d], [_open(z.as_py()), _open(nz.as_py())])
            yield pa.RecordBatch.from_arrays(cols, names=[n for n, _ in RESULT])


def fingerprint_versions(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness."""
    spark = session(docs)
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), body.alias("body"), F.xxhash64(body).alias("tie"))
    rows = rows.mapInArrow(_squeeze, "doc_id long, z binary, tie long")
    down = F.col("doc_id").desc_nulls_last()
    dealt = rows.repartitionByRange(partitions(spark), down).sortWithinPartitions(down, "tie")
    chained = Scratch(spark).table(dealt.mapInArrow(_chain, f"kind int, part long, {SCHEMA}, z binary"), "chained")
    heads = chained.where("kind = 1").select("part", F.col("z").alias("nz"))
    parts = heads.select("part")  # one row per partition
    following = Window.orderBy("part")
    first = F.min("part").over(Window.partitionBy())
    parts = parts.select("part", F.coalesce(F.lead("part").over(following), first).alias("next_part"))
    tails = chained.where("kind = 2").select("part", "doc_id", "z").join(parts, "part")
    pairs = tails.join(heads.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "z", "nz")
    done = chained.where("kind = 0").select(*[n for n, _ in RESULT])
    return done.union(pairs.mapInArrow(_last, SCHEMA)).withColumnRenamed("doc_id", id_col)
