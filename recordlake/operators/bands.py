"""Matter counts of entities: distinct records, histograms, bands and partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.fixed import THRESHOLDS


def distinct_records(refs: DataFrame, entity: str, number: str, filed: str, pos: str) -> DataFrame:
    """First reference (by `pos`) of each distinct record of an entity; blank numbers are dropped."""
    keyed = refs.withColumn("record_key", text.record_key(F.col(number))).where("record_key <> ''")
    first = keyed.groupBy(entity, "record_key").agg(F.min_by(F.struct(F.col(number).alias("number"), F.col(filed).alias("filed")), pos).alias("x"))
    return first.select(entity, "record_key", "x.number", "x.filed")


def band_table(spark: SparkSession, include_zero: bool = False) -> DataFrame:
    rows = []
    for i, lo in enumerate(THRESHOLDS):
        hi = THRESHOLDS[i - 1] - 1 if i else None
        rows.append((i, f"{lo}-plus" if hi is None else str(lo) if lo == hi else f"{lo}-{hi}", lo, hi))
    if include_zero:
        rows.append((len(rows), "0", 0, 0))
    return spark.createDataFrame(rows, "band_order int, band string, lo long, hi long")


def band_of(count: Column, include_zero: bool = False) -> Column:
    """The band's label, without a range join; null below the lowest band."""
    out = F.when(count == 0, "0") if include_zero else F.lit(None).cast("string")
    for i in reversed(range(len(THRESHOLDS))):
        lo = THRESHOLDS[i]
        label = f"{lo}-plus" if not i else str(lo) if lo == THRESHOLDS[i - 1] - 1 else f"{lo}-{THRESHOLDS[i - 1] - 1}"
        hit = count >= lo if not i else (count >= lo) & (count < THRESHOLDS[i - 1])
        out = F.when(hit, label).otherwise(out)
    return out


def bands(counts: DataFrame, count: str, include_zero: bool = False) -> DataFrame:
    """Entities and records per band; empty bands stay.

    Entities are aggregated by their band first, so only one row a band meets
    the band table.
    """
    by = counts.withColumn("band", band_of(F.col(count), include_zero)).groupBy("band").agg(F.count(F.lit(1)).alias("entity_count"), F.sum(count).alias("case_count"))
    t = band_table(counts.sparkSession, include_zero)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return t.join(F.broadcast(by), "band", "left").select("band_order", "band", zero("entity_count"), zero("case_count"))


def quantiles(counts: DataFrame, count: str) -> DataFrame:
    """Exact linear-interpolated quantiles in one row."""
    q = F.percentile(count, F.array(*map(F.lit, [0.5, 0.9, 0.95, 0.99, 0.999])))
    one = counts.agg(F.min(count).alias("min"), q.alias("q"), F.max(count).alias("max"))
    return one.select(F.col("min").cast("double"), *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(["p50", "p90", "p95", "p99", "p999"])], F.col("max").cast("double"))


def ranked(df: DataFrame, partition: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)).cast("long"))


def parts_by_count(df: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """Part number of every row when each group is cut after `most` rows.

    Rows are numbered by (group, order) in range partitions, and a group's first
    number is taken off, so no task holds a whole group.
    """
    from .rankings import ordinals

    numbered = ordinals(df, [F.col(group), *order], "_number")
    first = numbered.groupBy(group).agg(F.min("_number").alias("_first"))
    first = first.withColumnRenamed(group, "_group")
    out = numbered.join(F.broadcast(first) if first.count() <= MANY_GROUPS else first, F.col(group).eqNullSafe(F.col("_group")))
    return out.withColumn("part", F.floor((F.col("_number") - F.col("_first")) / most).cast("long")).drop("_number", "_first", "_group")


MANY_GROUPS = 1 << 16  # up to so many groups their first numbers are broadcast


class Packer:
    """Greedy parts of a stream of sizes; a size over the limit stands alone."""

    def __init__(self, most_rows: int, most_bytes: int):
        self.most_rows, self.most_bytes = most_rows, most_bytes
        self.part = self.rows = self.total = 0

    def place(self, size: int | None) -> int:
        size = size or 0
        if self.rows and (self.rows >= self.most_rows or self.total + size > self.most_bytes):
            self.part, self.rows, self.total = self.part + 1, 0, 0
        self.rows, self.total = self.rows + 1, self.total + size
        return self.part


def pack_parts(df: DataFrame, group: str, order: str, size: str, most_rows: int, most_bytes: int) -> DataFrame:
    """Greedy parts of at most `most_rows` rows and `most_bytes`; a row over the limit stands alone.

    Rows go by `order`, those of equal order by size.  Greedy packing depends on order, so
    a group's sizes go through one task, but as a sorted stream of Arrow batches, never
    as a whole; the records themselves do not pass through Python.  Every row has
    a number of its own, by which it gets its part back, so equal keys multiply nothing;
    a null group is a group.
    """
    import pyarrow as pa

    from .rankings import ordinals

    def pack(batches):
        now, packer = None, None
        for b in batches:
            parts = []
            for g, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if (g,) != now:
                    now, packer = (g,), Packer(most_rows, most_bytes)
                parts.append(packer.place(s))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(parts, pa.int64())], names=["_number", "part"])

    numbered = ordinals(df, [F.col(group), F.col(order), F.col(size)], "_number")
    keys = numbered.select(F.col(group).alias("_g"), "_number", F.col(size).cast("long").alias("_s"))
    packed = keys.repartition("_g").sortWithinPartitions("_g", "_number").mapInArrow(pack, "_number long, part long")
    return numbered.join(packed, "_number").drop("_number")


def display_is_consistent(display: Column, norm: Column, approved: Column) -> Column:
    d, n = text.name_key(display), text.name_key(norm)
    same = (d == "") | (n == "") | (d == n)
    return F.coalesce(approved, F.lit(False)) | same | ((F.length(d) >= 12) & n.contains(d)) | ((F.length(n) >= 12) & d.contains(n))


def bands_with_unknown(counts: DataFrame, count: str) -> DataFrame:
    """Bands from most to least, then 0, then the entities without a captured count."""
    known = bands(counts.where(F.col(count).isNotNull()), count, True)
    missing = counts.where(F.col(count).isNull()).agg(F.count(F.lit(1)).alias("entity_count"))
    last = missing.select(F.lit(len(THRESHOLDS) + 1).alias("band_order"), F.lit("not captured").alias("band"), "entity_count", F.lit(0).cast("long").alias("case_count"))
    return known.union(last)


def json_record_count(x: Column) -> Column:
    """Distinct records of a JSON list in text, cleaned and in capitals."""
    keys = F.transform(text.json_list(x), lambda v: F.upper(text.clean(v)))
    return F.size(F.array_distinct(F.filter(keys, lambda v: v != ""))).cast("long")


def merge_histograms(histograms: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Histograms of repeated ids added up; missing counts add nothing and stay missing if all are."""
    return histograms.groupBy(*keys).agg(F.sum(count).alias(count))


def rank_in_window(histogram: DataFrame, entity: str, year: str, first: int, last: int) -> DataFrame:
    """Entities ranked by their matters of the years in range."""
    by = histogram.where(F.col(year).between(first, last)).groupBy(entity).agg(F.sum("n").alias("matters"))
    from .rankings import ordinals

    return ordinals(by, [F.col("matters").desc(), F.col(entity)], "rank")
