"""Quality classifier: random Fourier features of document statistics, ridge
scores from summed normal equations, isotonic calibration.

The statistics of a whole text are standardised by the mean and deviation of the
labelled training rows; cos(W x + b) with Gaussian W approximates a Gaussian kernel
over them.  Every task sums z z' and z y of its labelled rows for each of FOLDS folds;
the sums of partitions are added, FAN of them at a time, so the driver gets numbers of a size
that the data do not change.  The ridge weights of all folds but one score that
fold, and pooled adjacent violators over the counts of these scores, in BINS bins, give
the calibration; the weights of all folds score every document.  Every labelled row counts.

Defined results: a null or empty text has statistics 0 and is scored like
any other; rows without a 0 or 1 label do not teach; a null id counts as an
empty text in the split; repeated label rows count as often as they stand, repeated
documents get the same score; without labels of both kinds the score is the share of label 1
(0.5 without any); a text of any length is taken whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, quoted, session, slices
from .states import fold_states
from .textkit import Batch, sorted_unique, window_hash, window_starts

FEATURES, WIDTH, RIDGE, FOLDS, BINS, FAN = 256, 6.0, 1e-4, 5, 4096, 16
WINDOW = 4  # words of the runs whose repeats are counted
STATISTICS = ["words", "length", "spread", "longest", "distinct", "runs", "lines", "repeated_lines", "symbols", "upper", "digits", "marks", "stops", "commas", "beyond_ascii", "bare"]

_KINDS = {"symbols": b"#*$%&|<>@^~_=+{}[]\\/", "upper": bytes(range(65, 91)), "digits": bytes(range(48, 58)), "marks": b"!?", "stops": b".", "commas": b",;:"}


def _kind(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_TABLES = {k: _kind(v) for k, v in _KINDS.items()} | {"beyond_ascii": _kind(bytes(range(192, 256))), "letter": _kind(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))}


def _distinct(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(sorted_unique(rows, values)[0], minlength=n)


def statistics(t: Batch) -> np.ndarray:
    """A row of STATISTICS for each text."""
    s, e, row = t.words
    out = np.zeros((t.n, len(STATISTICS)))
    put = lambda name, v: out.__setitem__((slice(None), STATISTICS.index(name)), v)
    words = np.bincount(row, minlength=t.n).astype(float)
    some, size = np.maximum(words, 1), (e - s).astype(float)
    total = np.bincount(row, weights=size, minlength=t.n)
    mean = total / some
    put("words", np.log1p(words))
    put("length", mean)
    put("spread", np.sqrt(np.maximum(np.bincount(row, weights=size**2, minlength=t.n) / some - mean**2, 0)))
    longest = np.zeros(t.n)
    np.maximum.at(longest, row, size)
    put("longest", np.log1p(longest))
    h = t.word_hash()
    put("distinct", _distinct(row, h, t.n) / np.sqrt(some))
    inside = window_starts(t.word_bounds, WINDOW)
    run, run_row = window_hash(h, WINDOW)[inside], row[: len(inside)][inside]
    runs = np.bincount(run_row, minlength=t.n)
    put("runs", 1 - _distinct(run_row, run, t.n) / np.maximum(runs, 1))
    # lines with a word: from the first word behind a line end to the last word before the next
    ends = np.flatnonzero(t.data == 10)
    line = np.searchsorted(ends, s) + row  # a row begins a line
    first = np.flatnonzero(np.diff(line, prepend=-1) > 0)
    last = np.append(first[1:], len(s)) - 1 if len(first) else first
    lines = np.bincount(row[first], minlength=t.n)
    put("lines", np.log1p(lines) - np.log1p(words))
    put("repeated_lines", 1 - _distinct(row[first], t.span_hash(s[first], e[last]), t.n) / np.maximum(lines, 1))
    for name, table in _TABLES.items():
        upto = np.concatenate([[0], np.cumsum(table[t.data])])
        if name == "letter":
            put("bare", np.bincount(row, weights=upto[e] == upto[s], minlength=t.n) / some)
        else:
            put(name, (upto[t.offsets[1:]] - upto[t.offsets[:-1]]) / np.maximum(total, 1))
    out[words == 0] = 0.0
    return out


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, x): the statistics of every text as doubles."""
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text)).alias("t"))

    def run(batches):
        for b in slices(batches, 1):
            x = statistics(Batch(b.column(1)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], names=["id", "x"])

    return rows.mapInArrow(run, rows.select("id").schema.add("x", T.ArrayType(T.DoubleType())))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


class Fourier:
    """Random features of standardised statistics; the last feature is 1."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int, width: float, seed: int = 12):
        r = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 0, deviation, 1.0)
        self.w = r.normal(size=(len(mean), features)) / width
        self.b = r.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -20, 20)
        return np.concatenate([np.cos(z @ self.w + self.b) * np.sqrt(2 / self.w.shape[1]), np.ones((len(x), 1))], 1)


def ridge(gram: np.ndarray, moment: np.ndarray, n: float, penalty: float) -> np.ndarray:
    """Weights of least squares; the constant is not penalised."""
    keep = np.full(len(gram), penalty * max(n, 1))
    keep[-1] = 1e-9
    return np.linalg.solve(gram + np.diag(keep), moment)


def isotonic(good: np.ndarray, every: np.ndarray) -> np.ndarray:
    """The rising sequence of least squared error to good / every, weighted by `every` (positive): adjacent violators are pooled."""
    blocks: list[tuple[float, float, int]] = []  # good, all, number of entries
    for g, n in zip(good.tolist(), every.tolist()):
        k = 1
        while blocks and blocks[-1][0] * n >= g * blocks[-1][1]:
            before = blocks.pop()
            g, n, k = g + before[0], n + before[1], k + before[2]
        blocks.append((g, n, k))
    return np.repeat([g / n for g, n, _ in blocks], [k for _, _, k in blocks])


class Classifier:
    """Statistics to score; `curve` holds the calibrated share of each bin of raw scores."""

    def __init__(self, fourier: Fourier | None, weights: np.ndarray, curve: np.ndarray, share: float):
        self.fourier, self.weights, self.curve, self.share = fourier, weights, curve, share

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.fourier is None:
            return np.full(len(x), self.share)
        return self.curve[bins(self.fourier(x) @ self.weights)]


def bins(raw: np.ndarray) -> np.ndarray:
    """Raw ridge scores between -0.5 and 1.5 in BINS bins."""
    return np.clip((raw + 0.5) * (BINS / 2), 0, BINS - 1).astype(np.int64)


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def labelled(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    """(id, x, good, bad, fold): statistics of the training documents with the numbers of their labels."""
    own = labels.select(F.col(quoted(id_col)).alias("labelled_id"), F.col(quoted(label)).alias("y")).where(F.col("y").isin(0, 1))
    own = own.groupBy("labelled_id").agg(F.count_if(F.col("y") == 1).alias("good"), F.count_if(F.col("y") == 0).alias("bad"))
    rows = stats.where(~held_out("id")).join(own, F.col("id") == F.col("labelled_id")).drop("labelled_id")
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(FOLDS)).cast("int"))


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (matrix(b.column("x")), *(b.column(c).to_numpy(zero_copy_only=False) for c in ("good", "bad", "fold")))


def fit(rows: DataFrame, features: int = FEATURES, width: float = WIDTH, penalty: float = RIDGE) -> Classifier:
    """Learns from a stored table of labelled()."""
    scratch, k = Scratch(session(rows)), len(STATISTICS)
    weight = F.col("good") + F.col("bad")
    first = rows.agg(F.sum("good"), F.sum(weight), *[f for i in range(k) for f in (F.sum(F.col("x")[i] * weight), F.sum(F.col("x")[i] * F.col("x")[i] * weight))]).first()
    good, n = first[0] or 0, first[1] or 0
    if not 0 < good < n:
        return Classifier(None, np.zeros(0), np.zeros(0), good / n if n else 0.5)
    mean, square = np.array(first[2::2]) / n, np.array(first[3::2]) / n
    fourier = Fourier(mean, np.sqrt(np.maximum(square - mean**2, 0)), features, width)
    size = features + 1

    def equations(batches):
        """One row a task: for each fold the gram matrix, the moments and the number of labels."""
        sums = np.zeros((FOLDS, size, size + 2))
        for b in batches:
            x, good, bad, fold = _columns(b)
            z = fourier(x)
            for f in range(FOLDS):
                on, w = z[fold == f], (good + bad)[fold == f].astype(float)
                sums[f, :, :size] += on.T @ (on * w[:, None])
                sums[f, :, size] += on.T @ good[fold == f]
                sums[f, 0, size + 1] += w.sum()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=["part", "sums"])

    def add(states: list[dict]) -> dict:
        return {"sums": sum(np.frombuffer(s["sums"]) for s in states).tobytes()}

    state = fold_states(scratch, rows.select("x", "good", "bad", "fold").mapInArrow(equations, "part long, sums binary"), add, FAN, "equations")
    sums = np.frombuffer(state["sums"]).reshape(FOLDS, size, size + 2)
    solve = lambda s: ridge(s[:, :size], s[:, size], s[0, size + 1], penalty)
    whole = sums.sum(0)
    apart = np.stack([solve(whole - sums[f]) for f in range(FOLDS)], 1)  # a column for each fold left out

    def judged(batches):
        counts = np.zeros((BINS, 2), np.int64)
        for b in batches:
            x, good, bad, fold = _columns(b)
            at = bins((fourier(x) * apart[:, fold].T).sum(1))
            np.add.at(counts, at, np.stack([good, good + bad], 1))
        used = np.flatnonzero(counts[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used, 0]), pa.array(counts[used, 1])], names=["bin", "good", "every"])

    found = rows.select("x", "good", "bad", "fold").mapInArrow(judged, "bin long, good long, every long").groupBy("bin").agg(F.sum("good").alias("good"), F.sum("every").alias("every"))
    got = sorted(found.collect())  # at most BINS rows
    at, good, every = (np.array(c) for c in zip(*got))
    return Classifier(fourier, solve(whole), np.interp(np.arange(BINS), at, isotonic(good, every)), good.sum() / every.sum())


def scores(stats: DataFrame, model: Classifier, id_col: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted) of every row of with_statistics()."""

    def run(batches):
        for b in batches:
            s = model.score(matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    out = stats.mapInArrow(run, stats.select("id").schema.add("score", "double").add("predicted", "integer"))
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", "predicted")
