"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash of its id (the head of an MD5 digest); a
source takes the documents below its threshold once more than the others.
Thresholds for growing budgets are nested, so a larger budget keeps all that a
smaller one took.  The threshold is found without sorting: tokens are summed by
(source, top 12 bits); the documents of the bucket in which the budget ends, one
in 4096, are set apart, and only they are read to refine it by the next 12 bits,
and so on.  What is left of the mix is a filter: no text is shuffled.

Defined results: a null text has size 0; a null source is a source of its own
and the last in order; a null id is an id like others; documents of one source
with the same id are taken together, so repeated rows are; a text of any length
is counted whole; an empty table gives no rows; other columns are kept if named
in `keep`, and one with the name of a result gives way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import join_by_share
from .shared import Scratch, carried, quoted, session, slices, unpacked
from .textkit import Batch

BITS, LEVELS = 12, 5
RESULTS = ["size", "source_size", "target", "copies"]


def word_counts(rows: DataFrame) -> DataFrame:
    """All columns of `rows` (the last one is the text) but the text, and `size`, the number of its words."""
    *names, text = rows.columns
    schema = rows.select(*names).schema.add("size", "long")

    def count(batches):
        for b in slices(batches, len(names)):
            bounds = Batch(b.column(len(names))).word_bounds
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.diff(bounds).astype(np.int64))], names=[*names, "size"])

    return rows.mapInArrow(count, schema)


def pick_hash(pick_id: Column, seed: int) -> Column:
    """0 .. 2**60 - 1, the same for equal ids."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(pick_id.cast("string"), F.lit("none")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def targets(sizes: DataFrame, weights: list[float], share: float, limit: float) -> DataFrame:
    """(source, source_size, target, n), one row per source; n counts its documents.

    Weights repeat over the sources in code point order, null last.  A target
    stops at `limit` times its source's size; what is over is shared again by
    weight among the others until none is above (each round is one aggregate
    of two numbers over the source table).
    """
    scratch = Scratch(session(sizes))
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row per source
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by = by.withColumn("weight", F.element_at(cycle, (rank % len(weights) + 1).cast("int")))
    by = scratch.table(by.withColumn("cap", F.lit(float(limit)) * F.col("source_size")), "sources")
    total = float(by.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:  # level: target per unit of weight; it only grows, and with it the set of full sources
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        a = by.agg(
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(full, 1)),
        ).first()
        if a[2] == capped or not a[1]:
            break
        capped, level = a[2], max(level, (total - a[0]) / a[1])
    return by.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"), "n")


def thresholds(sizes: DataFrame, goals: DataFrame, seed: int) -> DataFrame:
    """`goals` as a table by source_key, with passes, budget and threshold.

    A document is taken `passes` times, and once more if its hash is below the
    threshold.  `sizes` (a table) has pick_id, source and size.
    """
    scratch = Scratch(session(sizes))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = goals.withColumn("source_key", source_key(F.col("source"))).withColumn("passes", F.floor(ratio).cast("int"))
    goals = scratch.table(goals.withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size")).drop("source"), "goals")
    rows = sizes.select(source_key(F.col("source")).alias("source_key"), "size", pick_hash(F.col("pick_id"), seed).alias("h"))
    # state per source: hashes below `low` are in, `left` tokens remain for the bucket that starts at `low`
    state = goals.select("source_key", F.lit(0).cast("long").alias("low"), F.col("budget").alias("left"), "n")
    for level in range(LEVELS):
        width = BITS * (LEVELS - 1 - level)
        bucket = F.shiftrightunsigned(F.col("h") - F.col("low"), width)
        inside = (F.col("h") >= F.col("low")) & (F.shiftrightunsigned(F.col("h") - F.col("low"), width + BITS) == 0)
        stored = scratch.table(state, f"state{level}")
        rows = join_by_share(rows, stored, "source_key").where(inside)
        if level:  # what is left of the boundary buckets, and read from here on
            rows = scratch.table(rows, f"rows{level}")
        hist = rows.groupBy("source_key", "low", "left", bucket.alias("b")).agg(F.sum("size").alias("t"), F.count(F.lit(1)).alias("n"))
        run = Window.partitionBy("source_key").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)  # at most 4096 rows a source
        # the boundary bucket: the first whose tokens reach the budget
        hist = hist.withColumn("upto", F.sum("t").over(run)).where(F.col("upto") > F.col("left"))
        edge = hist.groupBy("source_key", "low", "left").agg(F.min_by(F.struct("b", "t", "upto", "n"), "b").alias("e"))
        start = F.col("low") + F.shiftleft(F.col("e.b"), width)
        rest = F.col("left") - (F.col("e.upto") - F.col("e.t"))
        if level == LEVELS - 1:  # one full hash: in if that is nearer to the budget
            nearer = F.col("e.upto") - F.col("left") <= rest
            edge = edge.select("source_key", (start + nearer.cast("long")).alias("low2"), F.lit(0.0).alias("left2"), F.lit(0).cast("long").alias("n2"))
        else:
            edge = edge.select("source_key", start.alias("low2"), rest.alias("left2"), F.col("e.n").alias("n2"))
        # without an edge the whole bucket fits: the threshold is its end, and stays there
        fits = F.col("low") + F.shiftleft(F.lit(1).cast("long"), width + BITS)
        state = stored.join(edge, "source_key", "left").select("source_key", F.coalesce("low2", fits).alias("low"), F.coalesce("left2", "left").alias("left"), F.coalesce("n2", F.lit(0)).alias("n"))
        rows = rows.select("source_key", "size", "h")
    end = scratch.table(state.select("source_key", F.col("low").alias("threshold")), "thresholds")
    return scratch.table(goals.join(end, "source_key"), "plan")


def with_copies(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """`rows` (pick_id, source and others) with source_size, target and copies, by a filter on the hash."""
    keyed = rows.withColumn("source_key", source_key(F.col("source")))
    joined = join_by_share(keyed, plan, "source_key")
    more = (pick_hash(F.col("pick_id"), seed) < F.col("threshold")) & (F.col("budget") > 0)
    return joined.select(*rows.columns, "source_size", "target", (F.col("passes") + more.cast("int")).alias("copies"))


def plan_mix(docs: DataFrame, id_col: str, source: str, text: str, weights, share: float, limit: float, seed: int, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(sizes, plan): a table of pick_id, source, carried and size, and the thresholds of every source."""
    rows = docs.select(F.col(quoted(id_col)).alias("pick_id"), F.col(quoted(source)).alias("source"), carried(keep or []), F.col(quoted(text)).alias("text"))
    sizes = Scratch(session(docs)).table(word_counts(rows), "sizes")
    return sizes, thresholds(sizes, targets(sizes, list(weights), share, limit), seed)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    limit: float = 2.0,
    seed: int = 20,
    keep: list[str] | None = None,
) -> DataFrame:
    """Per document: `keep`, id, source, size, source_size, target and copies (0, 1 or 2 at limit 2)."""
    keep = [c for c in (keep or []) if c not in (id_col, source, *RESULTS)]
    sizes, plan = plan_mix(docs, id_col, source, text, weights, share, limit, seed, keep)
    out = with_copies(sizes, plan, seed)
    return out.select(*unpacked(keep), F.col("pick_id").alias(id_col), F.col("source").alias(source), *RESULTS)


def repeat(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, seed: int = 20) -> DataFrame:
    """The mix itself: every row of `docs`, all its columns, as often as the mix takes it."""
    _, plan = plan_mix(docs, id_col, source, text, weights, share, limit, seed)
    rows = docs.select(F.col(quoted(id_col)).alias("pick_id"), F.col(quoted(source)).alias("source"), carried(docs.columns))
    taken = with_copies(rows, plan, seed).where("copies > 0")
    return taken.select("carried", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*unpacked(docs.columns))
