"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams (1 to 3 letters, hashed), trained with
follow-the-regularised-leader and elastic-net penalties, then calibrated by one
temperature.

Document frequencies come from all training documents.  The regression is
fitted on at most SAMPLE documents of each language, chosen by hash, and on as
many of them as hold ENTRIES n-gram counts together; a fifth of them only sets
the temperature.  The driver holds this sample and the weights, so its memory
grows with the number of languages, not with the data.  Texts are lower-cased, runs of other
characters than letters become one separator.

Defined results: a text that is null or has no letter is `und` with score 0, as
is every text when there is nothing to learn from; documents without a language
do not teach; a null id counts as an empty text in the split and so teaches;
rows that repeat teach as often as they stand; a text of any length is taken
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import join_by_share
from .linear import Sparse, softmax, temperature, train_multinomial
from .shared import Scratch, quoted, session, slices
from .textkit import U64

DIMS = 1 << 14
SAMPLE = 500  # documents of each language that the fit sees at most
ENTRIES = 1 << 20  # n-gram counts of each language that the fit sees at most (8 MB)
UNKNOWN = "und"
_LETTERS: list = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngram_counts(texts: list[str | None], dims: int = DIMS) -> tuple[Sparse, np.ndarray]:
    """(hashed n-gram counts of each text, whether it has a letter)."""
    low = [t.lower() if t else "" for t in texts]
    cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.fromiter(map(len, low), np.int64, len(low))
    row = np.repeat(np.arange(len(low)), n)
    is_letter = letters()[cp]
    has = np.bincount(row[is_letter], minlength=len(low)) > 0
    keep = is_letter.copy()
    first = np.ones(len(cp), bool)
    first[1:] = row[1:] != row[:-1]
    keep[1:] |= is_letter[:-1] & ~first[1:]  # one separator after each run of letters
    c = np.where(is_letter, cp, 0).astype(np.uint64)[keep]
    row = row[keep]
    feats, rows = [], []
    for k, base in ((1, 0x9E3779B1), (2, 0x85EBCA77C2B2AE3D), (3, 0x27D4EB2F165667C5)):
        if len(c) < k:
            continue
        h = c[: len(c) - k + 1] * U64(base)
        for j in range(1, k):
            h = (h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9) + c[j : len(c) - k + 1 + j]
        h = (h ^ (h >> U64(31))) * U64(0x94D049BB133111EB)
        same = row[: len(row) - k + 1] == row[k - 1 :]
        feats.append((h >> U64(40)).astype(np.int64)[same] % dims)
        rows.append(row[: len(row) - k + 1][same])
    if not feats:
        return Sparse(np.zeros(len(low) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0)), has
    rows, feats = np.concatenate(rows), np.concatenate(feats)
    at, index, value = [0], [], []
    order = np.argsort(rows, kind="stable")
    rows, feats = rows[order], feats[order]
    cut = np.searchsorted(rows, np.arange(len(low) + 1))
    for lo in range(0, len(low), 64):  # dense counts of 64 texts at a time
        hi = min(len(low), lo + 64)
        part = slice(cut[lo], cut[hi])
        dense = np.bincount((rows[part] - lo) * dims + feats[part], minlength=(hi - lo) * dims)
        hit = np.flatnonzero(dense)
        index.append(hit % dims)
        value.append(dense[hit])
        at.extend((at[-1] + np.searchsorted(hit, np.arange(1, hi - lo + 1) * dims)).tolist())
    return Sparse(np.array(at, np.int64), np.concatenate(index), np.concatenate(value).astype(np.float64)), has


def tfidf(x: Sparse, idf: np.ndarray) -> Sparse:
    """(1 + log count) * idf, each row of length 1."""
    v = (1 + np.log(x.value)) * idf[x.index]
    own = np.repeat(np.arange(len(x)), np.diff(x.indptr))
    norm = np.sqrt(np.bincount(own, weights=v * v, minlength=len(x)))
    return Sparse(x.indptr, x.index, v / np.maximum(norm[own], 1e-12))


def held_out(id_col: str) -> Column:
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 3 == 1


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """(documents, documents with each hashed n-gram) over all rows; DIMS numbers reach the driver."""

    def run(batches):
        total, n = np.zeros(DIMS, np.int64), 0
        for b in slices(batches, 0, 2 << 20):
            x, _ = ngram_counts(b.column(0).to_pylist())
            total += np.bincount(x.index, minlength=DIMS)
            n += len(x)
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1)), pa.array(np.append(total[i], n))], names=["f", "n"])

    out, n = np.zeros(DIMS, np.int64), 0
    for r in texts.mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():
        if r["f"] < 0:
            n = r["n"]
        else:
            out[r["f"]] = r["n"]
    return n, out


class LanguageModel:
    def __init__(self, langs: list[str], weights: np.ndarray, idf: np.ndarray, heat: float):
        self.langs, self.weights, self.idf, self.heat = langs, weights, idf, heat

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        counts, has = ngram_counts(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        p = softmax((tfidf(counts, self.idf).dot(self.weights[:-1]) + self.weights[-1]) / self.heat)
        best = p.argmax(1)
        return [self.langs[k] if h else UNKNOWN for k, h in zip(best, has)], np.where(has, p.max(1), 0.0)


def sample(train: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """At most `most` rows of each label, with their `rank`: those of least hash (a threshold first, then an exact cut)."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), F.lit(2.0 * most + 50) / F.col("n"))
    counts = Scratch(session(train)).table(counts.withColumn("sample_cut", (share * (1 << 30)).cast("long")), "counts")
    h = F.pmod(F.xxhash64(F.lit("sample"), F.col(key).cast("string")), F.lit(1 << 30))
    few = join_by_share(train.withColumn("sample_hash", h), counts, label).where("sample_hash <= sample_cut")
    rank = F.row_number().over(Window.partitionBy(label).orderBy("sample_hash", key))
    return few.withColumn("rank", rank).where(F.col("rank") <= most).drop("sample_hash", "sample_cut")


def within(rows: DataFrame, label: str, size: str, budget: int) -> DataFrame:
    """The rows of each label, by rank, whose sizes sum up to at most `budget`, and the first in any case."""
    upto = F.sum(size).over(Window.partitionBy(label).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("upto", upto).where((F.col("upto") <= budget) | (F.col("rank") == 1)).drop("upto", "rank", size)


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE) -> LanguageModel:
    """Learns from rows with a text and a language that are not held out."""
    rows = docs.select(F.col(quoted(id_col)).alias("k"), F.col(quoted(lang)).alias("y"), F.col(quoted(text)).alias("t"))
    train = rows.where(~held_out("k") & F.col("y").isNotNull() & F.col("t").isNotNull())
    n, df = document_frequencies(train.select("t"))
    idf = np.log((1 + n) / (1 + df)) + 1

    def features(batches):
        for b in slices(batches, 2, 2 << 20):
            x, _ = ngram_counts(b.column(2).to_pylist())
            cut = x.indptr
            index, value = x.index.astype(np.int32), x.value.astype(np.int32)
            packed = [pa.array([v[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:])], pa.binary()) for v in (index, value)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(cut)), *packed], names=["y", "rank", "size", "index", "value"])

    chosen = sample(train, "k", "y", most)
    rows = chosen.select("y", "rank", "t").mapInArrow(features, "y string, rank int, size long, index binary, value binary")
    rows = within(Scratch(session(docs)).table(rows, "features"), "y", "size", ENTRIES).collect()
    rows.sort(key=lambda r: (r["y"], bytes(r["index"]), bytes(r["value"])))
    langs = sorted({r["y"] for r in rows})
    if not langs:
        return LanguageModel([], np.zeros((DIMS + 1, 0)), idf, 1.0)
    index = [np.frombuffer(r["index"], np.int32) for r in rows]
    value = [np.frombuffer(r["value"], np.int32) for r in rows]
    x = Sparse(np.concatenate([[0], np.cumsum([len(i) for i in index])]), np.concatenate(index).astype(np.int64), np.concatenate(value).astype(np.float64))
    x, y = tfidf(x, idf), np.array([langs.index(r["y"]) for r in rows])
    tune = np.arange(len(rows)) % 5 == 4

    def part(mask):
        at = np.flatnonzero(mask)
        own, i, v = x.take(at)
        return Sparse(np.concatenate([[0], np.cumsum(np.diff(x.indptr)[at])]), i, v)

    w = train_multinomial(part(~tune), y[~tune], len(langs), DIMS, alpha=1.0, l1=1e-3, l2=1e-4, epochs=8)
    heat = temperature(part(tune).dot(w[:-1]) + w[-1], y[tune])
    return LanguageModel(langs, w, idf, heat)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row."""

    def run(batches):
        for b in slices(batches, 2, 2 << 20):
            langs, score = model.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(score)], names=[id_col, "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(quoted(id_col)).alias(id_col), held_out(quoted(id_col)).alias("held_out"), F.col(quoted(text)).alias("t"))
    schema = rows.drop("t").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)
