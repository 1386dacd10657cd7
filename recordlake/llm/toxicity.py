"""Toxicity severity by cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(threshold[k] - w.x) with one weight vector for all
ordered thresholds; the output is the expected grade.  Features are the
distinct words of a text (letters and digits, A-Z lower-cased) as 64-bit
hashes.

Labels are binary, so severity is graded from the labelled rows themselves:
clean rows are 0, toxic rows are 1 to 3 by how often they use terms that occur
in toxic rows at least TERM_RATIO times as often as in clean ones, cut at the
thirds of that count.  The fit uses at most SAMPLE rows of each label, chosen by
hash, and as many of them as hold ENTRIES distinct words together; prediction
covers every text.

Defined results: a null text has no words; repeated label rows count as often
as they stand; without rows of both labels every severity is 0; repeated
documents are judged alike; a text of any length is taken whole; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import sample, within
from .linear import Sparse, expected_grade, train_ordinal
from .shared import Scratch, quoted, session, slices
from .textkit import Batch, span_hash

SAMPLE = 4000  # labelled rows of each label that the fit sees at most
ENTRIES = 1 << 21  # distinct words, summed over those rows, that it sees of each label at most (24 MB)
TERM_RATIO, TERM_ROWS = 10.0, 5
GRADES = 4

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def tokens(t: Batch) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word in text order."""
    d = t.lowered
    inside = _WORD[d] if len(d) else np.zeros(0, bool)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = t.offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(d))]
    begins[edge], ends[edge - 1] = inside[edge], inside[edge - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return span_hash(d, s, e), np.searchsorted(t.offsets, s, side="right") - 1


class SeverityModel:
    def __init__(self, terms: np.ndarray, weights: np.ndarray, cut: np.ndarray):
        order = np.argsort(terms)
        self.terms, self.weights, self.cut = terms[order], weights[order], cut

    def score(self, t: Batch) -> np.ndarray:
        """w.x of every row: the weights of its distinct known words."""
        h, row = tokens(t)
        if not len(self.terms):
            return np.full(t.n, -np.inf)
        k = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        hit = self.terms[k] == h
        pairs = np.unique(row[hit] * len(self.terms) + k[hit])
        return np.bincount(pairs // len(self.terms), weights=self.weights[pairs % len(self.terms)], minlength=t.n)

    def severity(self, t: Batch) -> np.ndarray:
        return expected_grade(self.score(t), self.cut) if len(self.terms) else np.zeros(t.n)


def grades(x: Sparse, toxic: np.ndarray, features: int) -> np.ndarray:
    """0 for clean rows, 1 to 3 for toxic ones by their use of toxic terms."""
    own = np.repeat(np.arange(len(x)), np.diff(x.indptr))
    t, c = (np.bincount(x.index[toxic[own] == k], minlength=features) for k in (1, 0))
    rate = lambda n, total: (n + 0.5) / (total + 1)
    term = (t >= TERM_ROWS) & (rate(t, (toxic == 1).sum()) >= TERM_RATIO * rate(c, (toxic == 0).sum()))
    uses = np.bincount(own, weights=x.value * term[x.index], minlength=len(x))
    if not (toxic == 1).any():
        return np.zeros(len(x), np.int64)
    low, high = np.quantile(uses[toxic == 1], [1 / 3, 2 / 3])
    return np.where(toxic == 1, 1 + (uses > low) + (uses > high), 0).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE) -> SeverityModel:
    lab = labels.select(F.col(quoted(id_col)).alias("k"), F.col(quoted(label)).cast("int").alias("y")).where(F.col("y").isin(0, 1))
    chosen = sample(lab, "k", "y", most)  # at most 2 * `most` rows
    rows = docs.select(F.col(quoted(id_col)).alias("d"), F.col(quoted(text)).alias("t")).join(F.broadcast(chosen), F.col("d") == F.col("k"))

    def features(batches):
        for b in slices(batches, 2):
            t = Batch(b.column(2))
            h, row = tokens(t)
            hs, ns = [], []
            cut = np.searchsorted(row, np.arange(t.n + 1))
            for a, z in zip(cut[:-1], cut[1:]):
                u, n = np.unique(h[a:z], return_counts=True)
                hs.append(u.tobytes())
                ns.append(n.astype(np.int32).tobytes())
            sizes = pa.array([len(x) // 8 for x in hs], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sizes, pa.array(hs, pa.binary()), pa.array(ns, pa.binary())], names=["y", "rank", "size", "h", "n"])

    found = rows.select("y", "rank", "t").mapInArrow(features, "y int, rank int, size long, h binary, n binary")
    got = within(Scratch(session(docs)).table(found, "features"), "y", "size", ENTRIES).collect()
    got.sort(key=lambda r: (r["y"], bytes(r["h"]), bytes(r["n"])))
    toxic = np.array([r["y"] for r in got], np.int64)
    if len(set(toxic.tolist())) < 2:
        return SeverityModel(np.zeros(0, np.uint64), np.zeros(0), np.zeros(GRADES - 1))
    h = np.concatenate([np.frombuffer(r["h"], np.uint64) for r in got])
    terms, index, rows_with = np.unique(h, return_inverse=True, return_counts=True)
    value = np.concatenate([np.frombuffer(r["n"], np.int32) for r in got]).astype(np.float64)
    x = Sparse(np.concatenate([[0], np.cumsum([len(r["h"]) // 8 for r in got])]), index, value)
    y = grades(x, toxic, len(terms))
    common = rows_with >= TERM_ROWS  # rarer words say nothing about other documents
    own = np.repeat(np.arange(len(x)), np.diff(x.indptr))
    keep = common[x.index]
    number = np.cumsum(common) - 1
    x = Sparse(np.concatenate([[0], np.cumsum(np.bincount(own[keep], minlength=len(x)))]), number[x.index[keep]], np.ones(int(keep.sum())))
    terms = terms[common]
    w, cut = train_ordinal(x, y, GRADES, len(terms), alpha=0.3, l1=0.3, l2=0.01, epochs=max(10, 24000 // len(x)))
    used = w != 0
    return SeverityModel(terms[used], w[used], cut)


def severities(docs: DataFrame, model: SeverityModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, severity, grade, toxic) of every row: the expected grade, its rounding, and whether it is at least a half."""

    def run(batches):
        for b in slices(batches, 1):
            s = model.severity(Batch(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(np.floor(s + 0.5).astype(np.int32)), pa.array(s >= 0.5)], names=[id_col, "severity", "grade", "toxic"])

    rows = docs.select(F.col(quoted(id_col)).alias(id_col), F.col(quoted(text)).alias("t"))
    schema = rows.select(F.col(quoted(id_col))).schema.add("severity", "double").add("grade", "integer").add("toxic", "boolean")
    return rows.mapInArrow(run, schema)
