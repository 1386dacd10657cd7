"""Removal of repeated passages by Rabin-Karp hashes of fixed-length windows.

Every window of every document is hashed (modulo 2**61 - 1) and counted.  Hashes
travel packed: a task cuts its documents into chunks and sends each hash bucket
one row per chunk; a bucket counts its hashes and answers each chunk with one
bit per hash, in the order sent.  What a chunk holds of a hash more than once is
known to repeat and is sent once, so a window that fills a third of the corpus
costs a bucket one entry per chunk.  The chunk's layout (the bucket of every
window) turns the answers into word intervals.  Only documents that may have an
interval are shuffled with their texts to meet them.

A chunk sends at most FAN rows.  Where FAN buckets would be too large, the rows
of a bucket are merged into chunks of their own and split again by further bits
of the hash, level by level, and the answers go back the same way; so rows grow
in proportion to the input and a bucket's size does not grow at all.

Windows are compared by 61-bit hashes: among n windows the expected number of
false matches is n*n / 2**62.

The documents must come from a table scan (or anything else that gives the same
rows in the same partitions when a task is run again); the query and the
pipeline read Parquet.

Defined results: null text has no words; a null id is an id like others; rows
that repeat id and text repeat all their windows; texts shorter than a window
keep all words; a text of any length is taken whole, as one chunk; an empty
table gives no rows; other columns are kept, but for those with the name of a
result, which give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .components import join_by_share
from .shared import Filter, Scratch, carried, partitions, quoted, session, slices, unpacked
from .textkit import U64, Batch, window_hash, window_starts

KNOWN = 0xFFFF  # in a layout: repeats within its chunk
FAN_BITS = 12
FAN = 1 << FAN_BITS  # buckets that a chunk is split to at most
CHUNK = 1 << 19  # hashes in a chunk of the second and further levels, about
PARTITIONS = 64  # tasks that count buckets, for each shuffle partition of the session, at most
RESULTS = ["n_words", "n_removed", "removed_spans"]
MOVED = "kind int, at long, chunk long, data binary, more binary, ids binary, counts binary"
ANSWER = "kind int, chunk long, bucket long, data binary, ids binary, counts binary"


def pack(a: np.ndarray) -> bytes:
    raw = a.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True), dtype)


def _rows(schema_types, columns) -> pa.RecordBatch:
    names = [n for n, _ in schema_types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema_types)], names=names)


_MOVED = [("kind", pa.int32()), ("at", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary()), ("more", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())]
_ANSWER = [("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())]
_SPANS = [("span_key", pa.string()), ("spans", pa.list_(pa.int32()))]


def _split(h: np.ndarray, many: np.ndarray, of: np.ndarray, buckets: int) -> tuple[np.ndarray, list]:
    """(layout, rows) of hashes with their buckets `of`(hashes); `many` are hashes known to repeat.

    A row is (bucket, hashes sent, hashes known to repeat).
    """
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(h), bool)
    new[1:] = s[1:] != s[:-1]
    single = new.copy()
    single[:-1] &= new[1:]
    if len(many) and len(s):
        k = np.minimum(np.searchsorted(many, s), len(many) - 1)
        single &= many[k] != s
    many = np.union1d(s[new & ~single], many)
    layout = of(h).astype(np.uint16)
    layout[order[~single]] = KNOWN
    own = layout != KNOWN
    g = np.argsort(layout[own], kind="stable")
    sent, at = h[own][g], np.searchsorted(layout[own][g], np.arange(buckets + 1))
    where = of(many)
    by = np.argsort(where, kind="stable")
    many, mat = many[by], np.searchsorted(where[by], np.arange(buckets + 1).astype(where.dtype))
    use = np.flatnonzero((np.diff(at) > 0) | (np.diff(mat) > 0))
    return layout, [(int(k), sent[at[k] : at[k + 1]].tobytes(), many[mat[k] : mat[k + 1]].tobytes()) for k in use]


def _sent(rows: list, first: int, chunk: int) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(rows), 256):
        r = rows[lo : lo + 256]
        n = len(r)
        yield _rows(_MOVED, [[1] * n, [first + k for k, _, _ in r], [chunk] * n, [d for _, d, _ in r], [m for _, _, m in r], [None] * n, [None] * n])


def _send(width: int, buckets: int):
    """Texts to hash rows (kind 1, by bucket) and layout rows (kind 0, by chunk)."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for b in slices(batches, 1):
            t = Batch(b.column(1))
            bounds = t.word_bounds
            chunk = (part << 32) | seq
            seq += 1
            h = window_hash(t.word_hash(), width)[window_starts(bounds, width)]
            of = lambda x: (x >> U64(32)) * U64(buckets) >> U64(32)
            layout, rows = _split(h, np.zeros(0, np.uint64), of, buckets)
            ids = "\n".join(b.column(0).to_pylist()).encode()
            yield _rows(_MOVED, [[0], [chunk], [chunk], [pack(layout)], [None], [pack(np.frombuffer(ids, np.uint8))], [np.diff(bounds).astype(np.int32).tobytes()]])
            yield from _sent(rows, 0, chunk)

    return run


def _split_again(level: int):
    """Rows sorted by (kind, at, chunk): layouts pass; a bucket's rows are merged into chunks of their own and sent on."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        bucket, held, size = None, [], 0

        def flush():
            nonlocal seq
            chunk = (level << 60) | (part << 32) | seq
            seq += 1
            h = np.frombuffer(b"".join(d for _, d, _ in held), np.uint64)
            many = np.unique(np.frombuffer(b"".join(m for _, _, m in held), np.uint64))
            of = lambda x: (x >> U64(32 - FAN_BITS * level)) & U64(FAN - 1)
            layout, rows = _split(h, many, of, FAN)
            chunks = np.array([c for c, _, _ in held], np.int64)
            counts = np.array([len(d) // 8 for _, d, _ in held], np.int32)
            yield _rows(_MOVED, [[0], [chunk], [chunk], [pack(layout)], [np.int64(bucket).tobytes()], [pack(chunks)], [counts.tobytes()]])
            yield from _sent(rows, bucket * FAN, chunk)

        for b in batches:
            kinds, ats, chunks = (b.column(k).to_pylist() for k in ("kind", "at", "chunk"))
            passing = [i for i in range(b.num_rows) if kinds[i] == 0]
            if passing:
                yield b.select([n for n, _ in _MOVED]).take(pa.array(passing, pa.int64()))
            for i in range(b.num_rows):
                if kinds[i] == 0:
                    continue
                if held and (ats[i] != bucket or size >= 8 * CHUNK):
                    yield from flush()
                    held, size = [], 0
                bucket = ats[i]
                held.append((chunks[i], b.column("data")[i].as_py(), b.column("more")[i].as_py()))
                size += len(held[-1][1]) + len(held[-1][2] or b"")
        if held:
            yield from flush()

    return run


def _answers(rows: list, bucket: int) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(rows), 2000):
        r = rows[lo : lo + 2000]
        k = len(r)
        yield _rows(_ANSWER, [[1] * k, [c for c, _ in r], [bucket] * k, [d for _, d in r], [None] * k, [None] * k])


def _count(batches):
    """Rows sorted by (kind, at): layouts pass, each bucket answers its chunks."""
    bucket, held = None, []

    def answer() -> Iterator[pa.RecordBatch]:
        sizes = [len(x) // 8 for _, x, _ in held]
        h = np.frombuffer(b"".join(x for _, x, _ in held), np.uint64)
        many = np.unique(np.frombuffer(b"".join(y for _, _, y in held if y), np.uint64))
        order = np.argsort(h)
        s = h[order]
        same = s[1:] == s[:-1] if len(s) else np.zeros(0, bool)
        rep = np.zeros(len(s), bool)
        rep[1:] |= same
        rep[:-1] |= same
        if len(many) and len(s):
            k = np.minimum(np.searchsorted(many, s), len(many) - 1)
            rep |= many[k] == s
        bits = np.empty(len(s), bool)
        bits[order] = rep
        at = np.concatenate([[0], np.cumsum(sizes)])
        out = [(c, np.packbits(bits[at[i] : at[i + 1]]).tobytes()) for i, (c, _, _) in enumerate(held) if bits[at[i] : at[i + 1]].any()]
        yield from _answers(out, bucket)

    for b in batches:
        kinds, ats = b.column("kind").to_pylist(), b.column("at").to_pylist()
        chunks = b.column("chunk").to_pylist()
        for i in range(b.num_rows):
            if kinds[i] == 0:
                parent = b.column("more")[i].as_py()  # of a chunk of a further level
                parent = -1 if parent is None else int(np.frombuffer(parent, np.int64)[0])
                yield _rows(_ANSWER, [[0], [chunks[i]], [parent], [b.column("data")[i].as_py()], [b.column("ids")[i].as_py()], [b.column("counts")[i].as_py()]])
                continue
            if bucket is not None and ats[i] != bucket:
                yield from answer()
                held = []
            bucket = ats[i]
            held.append((chunks[i], b.column("data")[i].as_py(), b.column("more")[i].as_py()))
    if held:
        yield from answer()


class _Flags:
    """Which hashes of a chunk repeat: its layout, then the answers of its buckets."""

    def __init__(self, layout: np.ndarray):
        self.flags = layout == KNOWN
        self.by = np.argsort(layout, kind="stable")
        self.at = np.searchsorted(layout[self.by], np.arange(KNOWN + 1))

    def add(self, bucket: int, bits: bytes):
        where = self.by[self.at[bucket] : self.at[bucket + 1]]
        self.flags[where] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(where)).astype(bool)


def _answer_back(level: int):
    """Rows sorted by (chunk, kind): chunks of this level answer the chunks they were merged from; others pass."""

    def run(batches):
        now, seen, chunks, counts, parent = None, None, None, None, -1

        def answer():
            at = np.concatenate([[0], np.cumsum(counts)])
            out = [(int(c), np.packbits(seen.flags[a:z]).tobytes()) for c, a, z in zip(chunks, at[:-1], at[1:]) if seen.flags[a:z].any()]
            yield from _answers(out, parent)

        for b in batches:
            own = [c >> 60 == level for c in b.column("chunk").to_pylist()]
            if not all(own):
                yield b.select([n for n, _ in _ANSWER]).take(pa.array([i for i, x in enumerate(own) if not x], pa.int64()))
            cols = [b.column(n) for n, _ in _ANSWER]
            for i in range(b.num_rows):
                if not own[i]:
                    continue
                kind, chunk, bucket, data, raw, cnt = (c[i].as_py() for c in cols)
                if kind == 0:
                    if now is not None:
                        yield from answer()
                    now, seen, parent = chunk, _Flags(unpack(data, np.uint16)), bucket
                    chunks, counts = unpack(raw, np.int64), np.frombuffer(cnt, np.int32)
                else:
                    assert chunk == now, "an answer without its layout"
                    seen.add(bucket & (FAN - 1), data)
        if now is not None:
            yield from answer()

    return run


def _merge(width: int):
    """Rows sorted by (chunk, kind): a layout, then its answers; gives spans per document."""

    def spans(flags, ids, counts) -> pa.RecordBatch | None:
        if not flags.any():
            return None
        n = counts.astype(np.int64)
        first = np.concatenate([[0], np.cumsum(n)])
        per = np.maximum(0, n - width + 1)
        wfirst = np.concatenate([[0], np.cumsum(per)])
        hit = np.flatnonzero(flags)
        doc = np.searchsorted(wfirst, hit, side="right") - 1
        word = first[doc] + (hit - wfirst[doc])
        edge = np.zeros(first[-1] + 1, np.int32)
        np.add.at(edge, word, 1)
        np.add.at(edge, word + width, -1)
        cover = np.cumsum(edge[:-1]) > 0
        start = cover.copy()
        start[1:] &= ~cover[:-1]
        end = cover.copy()
        end[:-1] &= ~cover[1:]
        inner = first[1:-1]
        inner = inner[(inner > 0) & (inner < len(cover))]
        start[inner] |= cover[inner]
        end[inner - 1] |= cover[inner - 1]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        d = np.searchsorted(first, s, side="right") - 1
        pairs = np.stack([s - first[d], e - first[d]], 1).astype(np.int32).ravel()
        docs, k = np.unique(d, return_counts=True)
        off = np.concatenate([[0], np.cumsum(2 * k)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(off), pa.array(pairs))
        return pa.RecordBatch.from_arrays([pa.array([ids[x] for x in docs], pa.string()), lists], names=["span_key", "spans"])

    def run(batches):
        now, seen, ids, counts = None, None, None, None
        for b in batches:
            cols = [b.column(n) for n, _ in _ANSWER]
            for i in range(b.num_rows):
                kind, chunk, bucket, data, raw, cnt = (c[i].as_py() for c in cols)
                if kind == 0:
                    if now is not None and (out := spans(seen.flags, ids, counts)) is not None:
                        yield out
                    now, seen = chunk, _Flags(unpack(data, np.uint16))
                    ids = unpack(raw, np.uint8).tobytes().decode().split("\n")
                    counts = np.frombuffer(cnt, np.int32)
                else:
                    assert chunk == now, "an answer without its layout"
                    seen.add(bucket, data)
        if now is not None and (out := spans(seen.flags, ids, counts)) is not None:
            yield out

    return run


def repeated_spans(docs: DataFrame, key: str, text: str, width: int = 35, bucket_bytes: int = 8 << 20) -> DataFrame:
    """(span_key, spans, n): per `key` with repeats, [from, to) word intervals, flat, in order, and its rows."""
    p = partitions(session(docs))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets, levels = max(1, -(-total // bucket_bytes)), 1
    while buckets > FAN:
        buckets, levels = -(-buckets // FAN), levels + 1
    buckets = min(FAN, buckets if levels == 1 else FAN)
    rows = docs.select(key, text).mapInArrow(_send(width, buckets), MOVED)
    for level in range(1, levels):
        salt = F.pmod(F.xxhash64("chunk"), F.lit(p))
        rows = rows.repartition(p * level, "kind", "at", salt).sortWithinPartitions("kind", "at", "chunk").mapInArrow(_split_again(level), MOVED)
    p_count = max(p, min(-(-total // bucket_bytes), PARTITIONS * p))  # a task streams bucket after bucket
    rows = rows.repartition(p_count, "kind", "at").sortWithinPartitions("kind", "at", "chunk").mapInArrow(_count, ANSWER)
    by_chunk = lambda rows: rows.repartition(p, "chunk").sortWithinPartitions("chunk", "kind", "bucket")
    for level in range(levels - 1, 0, -1):
        rows = by_chunk(rows).mapInArrow(_answer_back(level), ANSWER)
    found = by_chunk(rows).mapInArrow(_merge(width), "span_key string, spans array<int>")
    return found.groupBy("span_key").agg(F.first("spans").alias("spans"), F.count(F.lit(1)).alias("n"))


def _squeeze(batches):
    """(carried, span_key, text) with the text compressed for the shuffle."""
    codec = pa.Codec("zstd")
    for b in batches:
        z = []
        for v in b.column(2):
            raw = v.as_buffer() if v.is_valid else None
            z.append(None if raw is None else raw.size.to_bytes(8, "little") + codec.compress(raw, asbytes=True))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.binary())], names=["carried", "span_key", "z"])


def _open(batches):
    """Slices of (carried, texts, spans) of rows with compressed texts."""
    codec = pa.Codec("zstd")
    for b in batches:
        at = 0
        while at < b.num_rows:
            lo, size, texts = at, 0, []
            while at < b.num_rows and (at == lo or size < 4 << 20):
                raw = b.column(1)[at].as_py()
                texts.append(None if raw is None else codec.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True))
                size += len(texts[-1] or b"")
                at += 1
            yield b.column(0).slice(lo, at - lo), texts, b.column(2).slice(lo, at - lo).to_pylist()


def _kept(texts: list, spans: list, cut: str, others: pa.Array) -> pa.RecordBatch:
    t = Batch(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
    s, bounds = t.words[0], t.word_bounds
    out, removed = [], np.zeros(len(texts), np.int64)
    for i, (raw, sp) in enumerate(zip(texts, spans)):
        first, last = bounds[i], bounds[i + 1]
        if sp:
            removed[i] = sum(sp[1::2]) - sum(sp[::2])
        if raw is None:
            out.append(None)
        elif cut == "bytes":
            base, at, pieces = t.offsets[i], 0, []
            for a, z in zip((sp or [])[::2], (sp or [])[1::2]):
                pieces.append(raw[at : s[first + a] - base])
                at = s[first + z] - base if first + z < last else len(raw)
            out.append(b"".join([*pieces, raw[at:]]))
        else:
            words, at, pieces = raw.split(), 0, []  # the same six separators
            for a, z in zip((sp or [])[::2], (sp or [])[1::2]):
                pieces += words[at:a]
                at = z
            out.append(b" ".join(pieces + words[at:]))
    lists = pa.array(spans, pa.list_(pa.int32()))
    cols = [others, pa.array(out, pa.binary()).cast(pa.string()), pa.array(np.diff(bounds).astype(np.int64)), pa.array(removed), lists]
    return pa.RecordBatch.from_arrays(cols, names=["carried", "text", *RESULTS])


def _cut(docs: DataFrame, id_col: str, text: str, width: int, cut: str) -> DataFrame:
    """(carried, text, n_words, n_removed, removed_spans); carried holds all other columns."""
    scratch = Scratch(session(docs))
    body = F.col(quoted(text))
    key = F.concat_ws("/", F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("none")), F.lower(F.hex(F.xxhash64(body))))
    keyed = docs.select(carried([c for c in docs.columns if c != text]), key.alias("span_key"), body.alias("text"))
    spans = scratch.table(repeated_spans(keyed, "span_key", "text", width), "spans")
    marked = Filter(scratch, spans, "span_key", "filter").mark(keyed, F.col("span_key"), "maybe")
    schema = keyed.select("carried").schema.add("text", "string").add("n_words", "long").add("n_removed", "long").add("removed_spans", ArrayType(IntegerType()))

    def whole(batches):
        for b in slices(batches, 1):
            texts = [v.as_py() for v in b.column(1).cast(pa.large_string()).cast(pa.large_binary())]
            yield _kept(texts, [None] * len(texts), cut, b.column(0))

    def pieces(batches):
        for others, texts, found in _open(batches):
            yield _kept(texts, found, cut, others)

    untouched = marked.where("not maybe").select("carried", "text").mapInArrow(whole, schema)
    squeezed = keyed.select("carried", "span_key").schema.add("z", "binary")
    small = marked.where("maybe").select("carried", "span_key", "text").mapInArrow(_squeeze, squeezed)
    met = join_by_share(small, spans, "span_key", how="left").select("carried", "z", "spans")
    return met.mapInArrow(pieces, schema).union(untouched)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 35, cut: str = "words") -> DataFrame:
    """All columns of `docs`, with the text cut, and n_words, n_removed, removed_spans.

    cut="words" joins the kept words by one space.  cut="bytes" leaves texts
    without a repeat as they are and otherwise cuts out only the removed words
    with the white space after them.
    """
    return _named(docs, _cut(docs, id_col, text, width, cut), [c for c in docs.columns if c not in RESULTS], text)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 35) -> DataFrame:
    """The columns of `docs`, whatever their names, with repeats cut out of the text and nothing else changed."""
    return _named(docs, _cut(docs, id_col, text, width, "bytes"), docs.columns, text, [])


def _named(docs: DataFrame, out: DataFrame, names: list[str], text: str, results: list[str] = RESULTS) -> DataFrame:
    own = [F.col("text").alias(text) if c == text else unpacked([c])[0] for c in names]
    return out.select(*own, *results)
