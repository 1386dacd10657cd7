"""SentencePiece encoding and decoding with a shared-prefix search.

A text is cut into marked words (a run of word marks and what follows, or one
control character that no piece of the model holds beside another character; a
carriage return may be held so): no piece of such a model has a mark behind
another character, so words are independent.  The distinct words of a task are sorted,
which lays out their trie, and traversed depth-first: the forward state of a
prefix (its best last piece, where that begins and the path's score) is
computed once and reused by every word that shares it.

Unigram models: the forward state maximises the sum of scores (Viterbi).
BPE models: merging by rank has one result for every prefix, and it is the one
path whose adjacent pieces stay apart when merged on their own.  The maximum is
therefore taken over arcs between compatible pairs, which leaves that path, and
so the library's ids.  The maximum over all splits, which for negated ranks as
scores is another one, is given beside the ids (score and number of pieces).

Defined results: a null text gives no ids and decodes to an empty text; the
mark U+2581 in a text decodes to a space, as in the library; ids outside the
vocabulary are an error; rows that repeat are encoded alike; a word of any
length is one word (time and memory grow with its length); columns that are not
asked for are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import carried, held, quoted, session, shipped, slices, unpacked
from .textkit import Batch, WordPool

MARK = "▁"
CACHE_WORDS = 1 << 19
PAIRS = 1 << 18
UNKNOWN = -1e6  # score of a character that no piece holds


class Model:
    """Pieces of a model file; kind is "bpe" or "unigram"."""

    def __init__(self, pieces: dict[str, tuple[int, float]], bytes_: dict[int, int], unknown: int, kind: str, texts: list[bytes]):
        self.pieces, self.bytes, self.unknown, self.kind, self.texts = pieces, bytes_, unknown, kind, texts
        self.reach: dict[str, int] = {}  # length of the longest piece by its last two characters
        for p in pieces:
            if len(p) > 1:
                self.reach[p[-2:]] = max(len(p), self.reach.get(p[-2:], 0))
        self.apart: dict[int, bool] = {}  # by the two ids

    @classmethod
    def load(cls, model: bytes, kind: str = "bpe") -> Model:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces, bytes_, texts = {}, {}, []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                bytes_[int(p[1:-1], 16)] = i
                texts.append(bytes([int(p[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                texts.append(b"" if sp.is_control(i) else " ⁇ ".encode())
            else:
                texts.append(p.replace(MARK, " ").encode())
                if not sp.is_unused(i):
                    pieces[p] = (i, sp.get_score(i))
        return cls(pieces, bytes_, sp.unk_id(), kind, texts)

    def merge(self, text: str) -> list[str]:
        """Merging by rank, leftmost first among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                hit = self.pieces.get(parts[i] + parts[i + 1])
                if hit is not None and (best is None or hit[1] > best):
                    best, at = hit[1], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: str, b: str) -> bool:
        pair = self.pieces[a][0] << 32 | self.pieces[b][0]
        known = self.apart.get(pair)
        if known is None:
            known = self.merge(a + b) == [a, b]
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            self.apart[pair] = known
        return known

    def encode_sorted(self, words: list[str]) -> list[tuple[list[int], float, int]]:
        """(ids, best score, its pieces) of ascending distinct words, sharing forward states of common prefixes.

        The best score is the Viterbi maximum over all splits into pieces; the
        ids are those of the best split whose adjacent pieces may stand together
        (for Unigram models every pair may, so it is the same split).
        """
        pieces, reach, bpe = self.pieces, self.reach, self.kind == "bpe"
        # forward states by depth: last piece (None for an unknown character), its length, the path's score,
        # and the free maximum with its number of pieces
        last: list[str | None] = [None]
        size: list[int] = [0]
        score: list[float] = [0.0]
        free: list[float] = [0.0]
        count: list[int] = [0]
        before, out = "", []
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            for states in (last, size, score, free, count):
                del states[shared + 1 :]
            for d in range(shared + 1, len(word) + 1):
                found, length, total = None, 1, None
                top, parts = free[d - 1] + UNKNOWN, count[d - 1] + 1
                for k in range(min(reach.get(word[d - 2 : d], 1), d) if d > 1 else 1, 0, -1):
                    p = word[d - k : d]
                    hit = pieces.get(p)
                    if hit is None:
                        continue
                    s = free[d - k] + hit[1]
                    if s > top:
                        top, parts = s, count[d - k] + 1
                    s = score[d - k] + hit[1]
                    if total is None or s > total:
                        prev = last[d - k]
                        if not bpe or d == k or prev is None or self.compatible(prev, p):
                            found, length, total = p, k, s
                if found is None:
                    total = score[d - 1] + UNKNOWN
                last.append(found)
                size.append(length)
                score.append(total)
                free.append(top)
                count.append(parts)
            d, ids = len(word), []
            while d:
                p = last[d]
                if p is not None:
                    ids.append(pieces[p][0])
                elif self.bytes:
                    ids.extend(self.bytes[x] for x in reversed(word[d - 1].encode()))
                else:
                    ids.append(self.unknown)
                d -= size[d]
            ids.reverse()
            out.append((ids, free[-1], count[-1]))
            before = word
        return out


class PieceEncoder:
    """Ids of whole texts; the words of earlier batches are remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.words = WordPool(CACHE_WORDS)
        lengths = np.array([len(t) for t in model.texts], np.int64)
        self.text_at = np.concatenate([[0], np.cumsum(lengths)])
        self.text_pool = np.frombuffer(b"".join(model.texts), np.uint8)
        joined = {c for p in model.pieces if len(p) > 1 for c in p}
        self.cuts = np.array([b < 32 and chr(b) not in joined for b in range(256)])  # bytes that are words of their own

    def encode(self, t: Batch) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, row bounds, Viterbi score and pieces of each row)."""
        if MARK.encode() in t.data.tobytes():  # a mark in the text is a space to the model
            raw, at = t.data.tobytes(), t.offsets.tolist()
            t = Batch(pa.array([raw[a:z].decode().replace(MARK, " ") for a, z in zip(at[:-1], at[1:])], pa.large_string()))
        full = np.diff(t.offsets) > 0
        data = np.insert(t.data, t.offsets[:-1][full], 32)  # the mark before every text
        row_at = t.offsets + np.concatenate([[0], np.cumsum(full)])
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(t.n + 1, np.int64), np.zeros(t.n), np.zeros(t.n, np.int64)
        space, control = data == 32, self.cuts[data]
        begins = control.copy()
        begins[1:] |= control[:-1] | (space[1:] & ~space[:-1])
        begins[row_at[:-1][full]] = True
        s = np.flatnonzero(begins)
        e = np.append(s[1:], len(data))
        raw = data.tobytes()
        start, size = self.words.places(data, s, e, lambda at: self._learn([raw[a:z] for a, z in zip(s[at].tolist(), e[at].tolist())]))
        # a word's entry: its Viterbi score (two numbers), its pieces, then its ids
        pool, row = self.words.pool, np.searchsorted(row_at, s, side="right") - 1
        head = pool[start[:, None] + np.arange(3)]
        best = head[:, :2].copy().view(np.float64).ravel()
        scores = np.bincount(row, weights=best, minlength=t.n)
        parts = np.bincount(row, weights=head[:, 2], minlength=t.n).astype(np.int64)
        start, size = start + 3, size - 3
        at = np.concatenate([[0], np.cumsum(size)])
        out = pool[np.repeat(start - at[:-1], size) + np.arange(at[-1])].astype(np.int32)
        return out, at[np.searchsorted(s, row_at)], scores, parts

    def _learn(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = [x.decode().replace(" ", MARK) for x in raw]
        order = sorted(range(len(words)), key=words.__getitem__)
        found: list = [None] * len(words)
        for i, x in zip(order, self.model.encode_sorted([words[i] for i in order])):
            found[i] = x
        sizes = np.array([3 + len(x[0]) for x in found], np.int64)
        head = np.cumsum(sizes) - sizes
        out = np.array([v for ids, _, _ in found for v in (0, 0, 0, *ids)], np.uint32)
        score = np.array([x[1] for x in found], np.float64).view(np.uint32).reshape(-1, 2)
        out[head], out[head + 1], out[head + 2] = score[:, 0], score[:, 1], [x[2] for x in found]
        return sizes, out

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """UTF-8 texts of the rows' ids, without the mark before each."""
        begin, size = self.text_at[ids], self.text_at[ids.astype(np.int64) + 1] - self.text_at[ids]
        at = np.concatenate([[0], np.cumsum(size)])
        raw = self.text_pool[np.repeat(begin - at[:-1], size) + np.arange(at[-1])].tobytes()
        cut = at[bounds].tolist()
        return [raw[a + (raw[a : a + 1] == b" ") : z] for a, z in zip(cut[:-1], cut[1:])]


def encoder(model: bytes) -> PieceEncoder:
    """The encoder of this process; its words outlive a task, but not the stage."""
    return held(("pieces", hashlib.sha256(model).digest()), lambda: PieceEncoder(Model.load(model)))


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns, n_tokens, ids, decoded_sha256, round_trip (the decoded text is the text),
    viterbi_score and viterbi_pieces (the maximum over all splits, and its number of pieces).

    A kept column with the name of a result gives way to it.
    """
    results = ["n_tokens", "ids", "decoded_sha256", "round_trip", "viterbi_score", "viterbi_pieces"]
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in results]
    rows = docs.select(carried(keep), F.col(quoted(text)).alias("text"))
    schema = rows.select("carried").schema.add("n_tokens", "long").add("ids", "binary").add("decoded_sha256", "string").add("round_trip", "boolean")
    schema = schema.add("viterbi_score", "double").add("viterbi_pieces", "long")
    model = shipped(session(docs), model_path)

    def run(batches):
        enc = encoder(model.value)
        for b in slices(batches, 1, 2 << 20):
            t = Batch(b.column(1))
            ids, at, score, parts = enc.encode(t)
            back, raw = enc.decode(ids, at), t.data.tobytes()
            own = [raw[a:z] for a, z in zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist())]
            packed = ids.astype("<i4").tobytes()
            blobs = [packed[4 * a : 4 * z] for a, z in zip(at[:-1].tolist(), at[1:].tolist())]
            cols = [pa.array(np.diff(at)), pa.array(blobs, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in back]), pa.array([x == y for x, y in zip(back, own)])]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(score), pa.array(parts)], names=["carried", *results])

    return rows.mapInArrow(run, schema).select(*unpacked(keep), *results)
