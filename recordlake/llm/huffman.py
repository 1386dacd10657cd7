"""Token ids in canonical length-limited Huffman files.

Texts are encoded with the tokenizers library; the distinct words of a task are
encoded once each (white space always ends a piece, so a text's ids are its
words' ids in order).  Counts over the whole corpus (as many as the vocabulary
has ids) give code lengths by package-merge; files hold their documents in
ascending id order, blocks of BLOCK ids with the bit offset of each, and
everything a reader needs.  Blocks are decoded side by side by table look-up.

Files are written by Spark's text writer, one row a file, and read as
binaryFile; no task opens a path itself.

Defined results: a null text is an empty one (its end id remains); null ids
come first; rows that repeat an id follow each other in order of their ids;
a text of any length is one document of one file; other columns are ignored; an
empty table gives no files.
"""

from __future__ import annotations

import hashlib
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, quoted, session, shipped, slices
from .textkit import Batch, WordPool

MAGIC, BLOCK, LIMIT = b"HUFB0001", 256, 18
FILE_TOKENS = 4 << 20
CACHE_WORDS = 1 << 21
_ENCODERS: dict = {}  # of this worker process, by the tokenizer's digest


class WordEncoder:
    """Ids of whole texts from the ids of their distinct words (kept between batches)."""

    def __init__(self, tokenizer: bytes):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_buffer(tokenizer)
        self.words = WordPool(CACHE_WORDS)

    def _learn(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes, ids = [], []
        for lo in range(0, len(texts), 2048):  # words side by side; the tokens' places tell them apart
            part = texts[lo : lo + 2048]
            e = self.tok.encode(" ".join(part), add_special_tokens=False)
            begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in part])])
            place = np.array([o[0] for o in e.offsets], np.int64)
            word = np.searchsorted(begin, place, side="right") - 1
            sizes.append(np.bincount(word, minlength=len(part)))
            ids.append(np.array(e.ids, np.uint32))
        return np.concatenate(sizes), np.concatenate(ids)

    def encode(self, t: Batch, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, row bounds); `end` is appended to each row."""
        s, e, _ = t.words
        raw = t.data.tobytes()
        spell = lambda at: self._learn([raw[a:z].decode() for a, z in zip(s[at].tolist(), e[at].tolist())])
        start, size = self.words.places(t.data, s, e, spell)
        pool = self.words.pool
        if end is not None:
            pool = np.append(pool, np.uint32(end))
            start = np.insert(start, t.word_bounds[1:], len(pool) - 1)
            size = np.insert(size, t.word_bounds[1:], 1)
        at = np.concatenate([[0], np.cumsum(size)])
        out = pool[np.repeat(start - at[:-1], size) + np.arange(at[-1])]
        extra = np.arange(t.n + 1) if end is not None else 0
        return out, at[t.word_bounds + extra]


def encoder(tokenizer: bytes) -> WordEncoder:
    """The encoder of this process; its words outlive a task."""
    name = hashlib.sha256(tokenizer).digest()
    if name not in _ENCODERS:
        _ENCODERS[name] = WordEncoder(tokenizer)
    return _ENCODERS[name]


def id_type(tokenizer: str, end: int | None) -> str:
    from tokenizers import Tokenizer

    most = max([*Tokenizer.from_file(tokenizer).get_vocab().values(), end or 0])
    return "<u2" if most < 1 << 16 else "<u4"


def token_table(docs: DataFrame, tokenizer: str, end: int | None = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) with ids as little-endian bytes, two an id if the vocabulary allows."""
    dtype, model = id_type(tokenizer, end), shipped(session(docs), tokenizer)

    def run(batches):
        enc = encoder(model.value)
        for b in slices(batches, 1):
            ids, at = enc.encode(Batch(b.column(1)), end)
            raw, k = ids.astype(dtype).tobytes(), np.dtype(dtype).itemsize
            blobs = [raw[k * a : k * z] for a, z in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(blobs, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text)).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def id_counts(tokens: DataFrame, dtype: str) -> dict[int, int]:
    """Occurrences of every id over the corpus; at most one entry per id of the vocabulary."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for blob in b.column(0):
                c = np.bincount(np.frombuffer(blob.as_buffer(), dtype).astype(np.int64))
                if len(c) > len(total):
                    total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
                total[: len(c)] += c
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[i])], names=["id", "n"])

    return {r["id"]: r["n"] for r in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}


def code_lengths(weights: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths of at most `limit` bits (package-merge); weights are positive."""
    n = len(weights)
    if n == 1:
        return np.ones(1, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    order = np.argsort(weights, kind="stable")
    leaves = weights[order].astype(np.float64)
    kinds, row = [], leaves
    for level in range(limit):
        if level:
            m = len(row) // 2 * 2
            both = np.concatenate([leaves, row[0:m:2] + row[1:m:2]])
            by = np.argsort(both, kind="stable")
            row = both[by]
            kinds.append(by < n)
        else:
            kinds.append(np.ones(n, bool))
    out, need = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(kinds):
        k = int(leaf[:need].sum())
        out[:k] += 1
        need = 2 * (need - k)
    lengths = np.empty(n, np.int64)
    lengths[order] = out
    return lengths


class Code:
    """Canonical code over `symbols` (ascending) with `lengths`."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        self.symbols, self.lengths = np.asarray(symbols, np.int64), np.asarray(lengths, np.int64)
        order = np.lexsort((self.symbols, self.lengths))
        size = self.lengths[order]
        self.width = int(size[-1]) if len(size) else 1
        first = np.concatenate([[0], np.cumsum(1 << (self.width - size))])
        codes = np.empty(len(size), np.int64)
        codes[order] = first[:-1] >> (self.width - size)
        self.codes = codes
        self.table_symbol = np.zeros(1 << self.width, np.uint32)
        self.table_length = np.ones(1 << self.width, np.uint8)
        self.table_symbol[: first[-1]] = np.repeat(self.symbols[order], 1 << (self.width - size))
        self.table_length[: first[-1]] = np.repeat(size, 1 << (self.width - size))

    def encode(self, ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray, int]:
        """(bits, bit offset of every block, number of bits)."""
        words, offsets, total = np.zeros(2, np.uint64), [], 0
        for lo in range(0, len(ids), 1 << 18):
            k = np.searchsorted(self.symbols, ids[lo : lo + (1 << 18)])
            size, code = self.lengths[k], self.codes[k].astype(np.uint64)
            end = total + np.cumsum(size)
            begin = end - size
            total = int(end[-1])
            words = np.concatenate([words, np.zeros(max(0, total // 64 + 2 - len(words)), np.uint64)])
            slot, room = begin >> 6, 64 - (begin & 63)
            over = np.maximum(0, size - room)
            head = np.where(over > 0, code >> over.astype(np.uint64), code << np.maximum(0, room - size).astype(np.uint64))
            starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
            words[slot[starts]] += np.add.reduceat(head, starts)
            o = np.flatnonzero(over)
            words[slot[o] + 1] += code[o] << (64 - over[o]).astype(np.uint64)
            offsets.append(begin[::block])  # 1 << 18 is a multiple of block
        at = np.concatenate(offsets) if offsets else np.zeros(0, np.int64)
        return words.astype(">u8").tobytes()[: (total + 7) // 8], at.astype(np.uint64), total

    def decode(self, bits: bytes, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
        """All blocks in step: one table look-up a round gives the next id of each."""
        data = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        at = offsets.astype(np.int64).copy()
        out = np.zeros((len(at), block), np.uint32)
        left = n - block * (len(at) - 1)
        for k in range(block):
            live = at if k < left else at[:-1]
            w = window[live >> 3]
            code = (w << (live & 7).astype(np.uint32)) >> np.uint32(32 - self.width)
            out[: len(live), k] = self.table_symbol[code]
            live += self.table_length[code]
        return out.ravel()[:n]


def make_file(code: Code, docs: list[int | None], counts: np.ndarray, ids: np.ndarray, part: int, seq: int) -> bytes:
    bits, offsets, total = code.encode(ids)
    z = lambda a: zlib.compress(a.tobytes(), 6)
    tables = [
        z(np.diff(code.symbols, prepend=0).astype("<u4")),
        z(code.lengths.astype(np.uint8)),
        z(np.array([d is None for d in docs], np.uint8)),
        z(np.array([d or 0 for d in docs], "<i8")),
        z(counts.astype("<u4")),
        z(np.diff(offsets, prepend=np.uint64(0)).astype("<u4")),
    ]
    head = json.dumps({"part": part, "seq": seq, "docs": len(docs), "tokens": len(ids), "bits": total, "block": BLOCK, "tables": [len(t) for t in tables]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *tables, bits])


def parse_head(data: bytes) -> tuple[dict, int]:
    if data[:8] != MAGIC:
        raise ValueError("not a Huffman id file")
    n = int.from_bytes(data[8:12], "little")
    return json.loads(data[12 : 12 + n]), 12 + n


def parse_file(data: bytes) -> tuple[dict, list[int | None], np.ndarray, np.ndarray]:
    """(head, document ids, tokens of each, all ids)."""
    head, at = parse_head(data)
    raw = []
    for size in head["tables"]:
        raw.append(zlib.decompress(data[at : at + size]))
        at += size
    code = Code(np.cumsum(np.frombuffer(raw[0], "<u4").astype(np.int64)), np.frombuffer(raw[1], np.uint8))
    null, names = np.frombuffer(raw[2], np.uint8), np.frombuffer(raw[3], "<i8").tolist()
    docs = [None if x else d for x, d in zip(null, names)]
    offsets = np.cumsum(np.frombuffer(raw[5], "<u4").astype(np.int64))
    ids = code.decode(data[at : at + (head["bits"] + 7) // 8], offsets, head["tokens"], head["block"]) if head["tokens"] else np.zeros(0, np.uint32)
    return head, docs, np.frombuffer(raw[4], "<u4").astype(np.int64), ids


def write_files(tokens: DataFrame, path: str, dtype: str) -> Code:
    """Writes (doc_id, n_tokens, ids of `dtype`), a table, in ascending doc_id order; returns the code."""
    counts = id_counts(tokens, dtype)
    symbols = np.array(sorted(counts), np.int64)
    code = Code(symbols, code_lengths(np.array([counts[s] for s in symbols.tolist()], np.int64))) if len(symbols) else Code([0], [1])
    n = max(1, -(-sum(counts.values()) // FILE_TOKENS))
    pair, width = (code.symbols, code.lengths), np.dtype(dtype).itemsize

    def run(batches):
        own, part, seq = Code(*pair), TaskContext.get().partitionId(), 0
        docs, blobs, size = [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(blobs), dtype)
            counts = np.array([len(x) // width for x in blobs], np.int64)
            return pa.RecordBatch.from_arrays([pa.array([make_file(own, docs, counts, ids, part, seq)], pa.binary())], names=["file"])

        for b in batches:
            for d, blob in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                if docs and size + len(blob) > 2 * width * FILE_TOKENS:
                    yield flush()
                    docs, blobs, size, seq = [], [], 0, seq + 1
                docs.append(d)
                blobs.append(blob)
                size += len(blob)
        if docs:
            yield flush()

    by = F.col("doc_id").asc_nulls_first()
    dealt = tokens.select("doc_id", "ids").repartitionByRange(n, by).sortWithinPartitions(by, "ids")
    files = dealt.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).text(path)
    return code


def read_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches, with_ids=False):
        for b in batches:
            for c in b.column(0):
                if len(c.as_py()) <= 1:
                    continue
                head, docs, counts, ids = parse_file(c.as_py())
                at = np.concatenate([[0], np.cumsum(counts)])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist())]
                k = len(docs)
                cols = [pa.array([head["part"]] * k, pa.int64()), pa.array([head["seq"]] * k, pa.int64()), pa.array(docs, pa.int64()), pa.array(at[:-1]), pa.array(counts), pa.array(crc, pa.int64())]
                names = ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    narrow = "part long, seq long, doc_id long, local long, n_tokens long, ids_crc32 long"
    rows = Scratch(spark).table(files.mapInArrow(run, narrow), "rows")  # so the files are read once
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    sizes = rows.groupBy("part", "seq").agg(F.sum("n_tokens").alias("tokens"))
    place = sizes.select("part", "seq", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("before"))
    if with_ids:
        rows = files.mapInArrow(lambda batches: run(batches, True), f"{narrow}, ids array<long>")
    out = rows.join(place, ["part", "seq"])
    return out.select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def encode_corpus(docs: DataFrame, tokenizer: str, path: str, end: int | None = 2, id_col: str = "doc_id", text: str = "text") -> Code:
    tokens = Scratch(session(docs)).table(token_table(docs, tokenizer, end, id_col, text), "tokens")
    return write_files(tokens, path, id_type(tokenizer, end))
