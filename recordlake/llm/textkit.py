"""Vectorised text primitives over Arrow string buffers.

Every function works on whole texts and on all rows of a batch at once: a word
is a maximal run of bytes outside ``0x20`` and ``0x09-0x0D``.  UTF-8
continuation bytes are all above ``0x7F``, so byte positions are safe cut points.

Byte spans are hashed by eight-byte words: each word is mixed with a key of its
place in the span and the results are added, so no algebraic pattern of the text
(repeats, Thue-Morse words) carries over to the sum.  Windows of tokens have
Rabin-Karp hashes in the field modulo the prime 2**61 - 1.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

U64 = np.uint64
PRIME = (1 << 61) - 1
WORD_BASE = 0x16E8FEB86659FD93  # below PRIME
WORD_BASE_2 = 0x0761D6478BD642F5
PLACE = 0x9E3779B97F4A7C15
SECOND = 0xA0761D6478BD642F


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser (a permutation of 0..2**64-1)."""
    x = x ^ U64(salt & 0xFFFFFFFFFFFFFFFF) if salt else x.copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Batch:
    """Bytes and row offsets of an Arrow string column; null rows are empty."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if column.null_count:
            column = column.fill_null("")
        column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
        n = len(column)
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = raw[off[0] : off[-1]]
        self.offsets = (off - off[0]).astype(np.int64)
        self.n = n

    @functools.cached_property
    def lowered(self) -> np.ndarray:
        """The bytes with A-Z in lower case."""
        d = self.data
        return np.where((d >= 65) & (d <= 90), d | 32, d).astype(np.uint8)

    @functools.cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start byte, end byte, row) of every word, in text order."""
        d = self.data
        if not len(d):
            z = np.zeros(0, np.int64)
            return z, z, z
        inside = ~((d == 32) | ((d >= 9) & (d <= 13)))
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        edge = self.offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(d))]
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        s = np.flatnonzero(begins)
        e = np.flatnonzero(ends) + 1
        row = np.searchsorted(self.offsets, s, side="right") - 1
        return s, e, row

    @functools.cached_property
    def word_bounds(self) -> np.ndarray:
        """Row boundaries in the word arrays (n + 1 entries)."""
        return np.searchsorted(self.words[0], self.offsets)

    def span_hash(self, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hash of each byte span [start, end)."""
        return span_hash(self.lowered if lower else self.data, start, end)

    def word_hash(self, lower: bool = False) -> np.ndarray:
        s, e, _ = self.words
        return self.span_hash(s, e, lower)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of each byte span; another `salt` gives an independent hash."""
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at8 = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place
    for lo in range(0, len(start), 1 << 17):
        hi = min(len(start), lo + (1 << 17))
        out[lo:hi] = _first_words(at8, start[lo:hi], size[lo:hi], salt)
    more = np.flatnonzero(size > 8)
    chunks = (size[more] - 1) // 8  # eight-byte words after the first
    upto = np.cumsum(chunks)
    at = 0
    while at < len(more):  # about 2**17 words at a time; a longer span goes in pieces
        done = int(upto[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, done + (1 << 17), side="right")))
        n = chunks[at:stop]
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        for piece in range(0, int(n.sum()), 1 << 17):
            k = np.arange(piece, min(int(n.sum()), piece + (1 << 17)))
            own = np.searchsorted(begin, k, side="right") - 1
            place = k - begin[own] + 1
            span = more[at:stop][own]
            v = at8[start[span] + 8 * place] & _low_bytes(size[span] - 8 * place)
            v = mix(v ^ mix(place.astype(np.uint64) * U64(PLACE), salt))
            np.add.at(out, span, v)
        at = stop
    return mix(out + size.astype(np.uint64) * U64(PLACE))


def _low_bytes(n: np.ndarray) -> np.ndarray:
    """Masks of the low min(n, 8) bytes."""
    keep = np.clip(n, 0, 8).astype(np.uint64)
    return np.where(keep == 0, U64(0), U64(0xFFFFFFFFFFFFFFFF) >> (U64(8) * (U64(8) - np.maximum(keep, U64(1)))))


def _first_words(at8: np.ndarray, start: np.ndarray, size: np.ndarray, salt: int) -> np.ndarray:
    v = at8[start] & _low_bytes(size)
    return mix(v ^ mix(np.zeros(1, np.uint64), salt))


def distinct_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, check, first span, number) of the distinct byte spans; number maps each span to its key.

    Spans are told apart by two independent 64-bit hashes; where only the first
    agrees, both make the keys.
    """
    h, g = span_hash(data, start, end), span_hash(data, start, end, SECOND)
    u, first, number = np.unique(h, return_index=True, return_inverse=True)
    if (g[first][number] != g).any():
        u, first, number = np.unique(mix(h, SECOND) ^ g, return_index=True, return_inverse=True)
    return u, g[first], first, number


class WordPool:
    """Numbers of distinct words, kept between batches; forgets all beyond `most` words."""

    def __init__(self, most: int):
        self.most = most
        self.reset()

    def reset(self):
        self.known = np.zeros(0, np.uint64)
        self.check = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def places(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, learn) -> tuple[np.ndarray, np.ndarray]:
        """(first place in the pool, size) of each word; learn(first spans) gives (sizes, numbers) of new ones."""
        u, check, first, number = distinct_spans(data, start, end)
        if len(self.known) + len(u) > self.most:
            self.reset()
        k = np.minimum(np.searchsorted(self.known, u), max(0, len(self.known) - 1))
        old = self.known[k] == u if len(self.known) else np.zeros(len(u), bool)
        if (self.check[k[old]] != check[old]).any():  # another word has the key
            self.reset()
            old[:] = False
        if not old.all():
            sizes, numbers = learn(first[~old])
            begin = len(self.pool) + np.concatenate([[0], np.cumsum(sizes)[:-1]])
            self.pool = np.concatenate([self.pool, numbers.astype(np.uint32)])
            known = np.concatenate([self.known, u[~old]])
            order = np.argsort(known)
            self.known = known[order]
            self.check = np.concatenate([self.check, check[~old]])[order]
            self.start = np.concatenate([self.start, begin])[order]
            self.size = np.concatenate([self.size, sizes])[order]
            k = np.searchsorted(self.known, u)
        return self.start[k][number], self.size[k][number]


def times(a: np.ndarray, c: int) -> np.ndarray:
    """a * c modulo PRIME, for values below PRIME."""
    low, high = U64(c & 0x7FFFFFFF), U64(c >> 31)
    al, ah = a & U64(0x7FFFFFFF), a >> U64(31)
    middle = ah * low + al * high
    out = ((ah * high) << U64(1)) + (middle >> U64(30)) + ((middle & U64(0x3FFFFFFF)) << U64(31)) + al * low
    return reduced((out & U64(PRIME)) + (out >> U64(61)))


def reduced(a: np.ndarray) -> np.ndarray:
    """Values below 2 * PRIME, modulo PRIME."""
    return np.where(a >= U64(PRIME), a - U64(PRIME), a)


def window_hash(tokens: np.ndarray, width: int, base: int = WORD_BASE) -> np.ndarray:
    """Rabin-Karp hash modulo PRIME, mixed, of every run of `width` consecutive tokens.

    The hash of a run is built from those of its halves (width 35 is 32 + 2 + 1),
    so no prefix sum is needed.  There are max(0, n - width + 1) entries; row
    boundaries are ignored (see window_starts).
    """
    n = len(tokens)
    if n < width:
        return np.zeros(0, np.uint64)
    out = np.empty(n - width + 1, np.uint64)
    for lo in range(0, len(out), 1 << 16):
        hi = min(len(out), lo + (1 << 16))
        run = tokens[lo : hi + width - 1]
        run = reduced((run & U64(PRIME)) + (run >> U64(61)))
        size, total, done = 1, None, 0
        while True:
            if width & size:  # the next `size` tokens, after the `done` ones
                k = hi - lo
                part = run[done : done + k]
                total = part if total is None else reduced(times(total, pow(base, size, PRIME)) + part)
                done += size
            if 2 * size > width:
                break
            run = reduced(times(run[:-size], pow(base, size, PRIME)) + run[size:])
            size *= 2
        out[lo:hi] = total
    return mix(out)


def window_starts(bounds: np.ndarray, width: int) -> np.ndarray:
    """Mask over window_hash()'s entries: the window lies within one row."""
    n = int(bounds[-1])
    if n < width:
        return np.zeros(0, bool)
    ok = np.ones(n - width + 1, bool)
    for k in range(1, width):  # a window may not begin in the last width-1 words of a row
        at = bounds[1:] - k
        at = at[(at >= bounds[:-1]) & (at < len(ok))]
        ok[at] = False
    return ok


def sorted_unique(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, ordered by row and value."""
    order = np.lexsort((values, rows))
    r, v = rows[order], values[order]
    if not len(r):
        return r, v
    keep = np.ones(len(r), bool)
    keep[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return r[keep], v[keep]
