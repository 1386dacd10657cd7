"""The stages of the corpus pipeline.

Each takes (spark, docs, sf_dir) and returns the rows it keeps, with the columns
of `docs`, whatever their names (the last one returns token ids instead).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, neardup, pieces, rules, substring
from .shared import Filter, Scratch, carried, documents, unpacked


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rule or a learned rule rejects."""
    labels = documents(spark, sf_dir, "labels")
    known = Scratch(spark).table(rules.statistics(rules.labelled_documents(docs, labels)).select(F.col("carried.doc_id").alias("doc_id"), *rules.BASE, *rules.MORE), "labelled")
    learned = rules.learn(rules.labelled_statistics(known, labels))
    return rules.select_kept(docs, learned)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each near-duplicate group (and every document without words).

    Rows are told apart by id and text: of several texts of that id in a group
    one is kept (the least hash), and of rows with equal id and text one (the
    least other columns), also where the text has no words.
    """
    kept, others = neardup.kept_rows(docs.select("doc_id", "text"))
    kept = kept.toDF("kept_id", "kept_key", "n")
    names = docs.columns
    rows = docs.select(carried(names), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_key"))
    # rows of their own pass; the others meet the table of what is kept
    marked = Filter(Scratch(spark), others, "row_key", "filter").mark(rows, F.xxhash64("own_id", "own_key"), "maybe")
    own, rows = marked.where("not maybe"), marked.where("maybe")
    on = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_key") == F.col("kept_key"))
    once, more = kept.where("n = 1"), kept.where("n > 1")
    out = own.select("carried").union(rows.join(once, on, "left_semi").select("carried"))
    if not more.isEmpty():
        again = rows.join(more, on).groupBy("kept_id", "kept_key").agg(F.min("carried").alias("carried"))
        out = out.union(again.select("carried"))
    return out.select(*unpacked(names))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 35 words or more that occur elsewhere; other text stays as it is."""
    out = substring.cut_repeats(docs)
    if "n_chars" not in out.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents as the mix takes them (0, 1 or 2 times)."""
    return mixing.repeat(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the check that they decode to its text."""
    import public_tokenizers

    return pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id", "lang", "source", "n_chars"])


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]
