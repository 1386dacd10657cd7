"""Stateful streams: sliding and session windows, joins of two streams, first arrivals and retractions.

State is bounded by watermarks where time ends it (windows, joins) and is one small row
a key where it does not (routes, records); it lives in Spark's RocksDB store, which
use_rocksdb() names for the session.  Every result equals the batch one over the same
rows; the batch forms are beside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed processors need Spark's RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _late(df: DataFrame, ts: str, late: str) -> DataFrame:
    return df.withWatermark(ts, late) if df.isStreaming else df


def sliding_counts(df: DataFrame, ts: str, key: str, width: str, slide: str, late: str = "1 day") -> DataFrame:
    """(key, start, end, n): rows of every window of `width` that begins every `slide`."""
    by = _late(df, ts, late).groupBy(F.window(ts, width, slide), key).agg(F.count(F.lit(1)).alias("n"))
    return by.select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def session_counts(df: DataFrame, ts: str, key: str, gap: str, late: str = "1 day") -> DataFrame:
    """(key, start, end, n): runs of rows of a key that follow each other within `gap`."""
    by = _late(df, ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return by.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def joined(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within: str, late: str = "1 day", how: str = "inner") -> DataFrame:
    """Rows of `left` with the rows of `right` of their key that come at most `within` later.

    Watermarks on both sides and the bound on time let Spark forget rows that can
    meet nobody any more; with how="left" rows that met nobody come out then.
    """
    a, b = _late(left, left_ts, late), _late(right.withColumnRenamed(key, "_right_key"), right_ts, late)
    near = (F.col(right_ts) >= F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(key) == F.col("_right_key")) & near, how).drop("_right_key")


class FirstArrival(StatefulProcessor):
    """Per key: the least position with its record, and how many rows came."""

    SCHEMA = T.StructType([T.StructField("pos", T.LongType()), T.StructField("record", T.StringType()), T.StructField("n", T.LongType())])

    def init(self, handle) -> None:
        self.held = handle.getValueState("first", self.SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pos, record, n = self.held.get() if self.held.exists() else (None, None, 0)
        for b in rows:
            n += len(b)
            best = b.sort_values(["pos", "record"], na_position="last").iloc[0]
            if pos is None or (best["pos"], best["record"]) < (pos, record):
                pos, record = int(best["pos"]), best["record"]
        self.held.update((pos, record, n))
        yield pd.DataFrame({"route": [key[0]], "record": [record], "pos": [pos], "duplicates": [n - 1]})

    def close(self) -> None:
        pass


def first_routes(df: DataFrame, route: str, record: str, pos: str) -> DataFrame:
    """(route, record, pos, duplicates): the first record of each route by position, then by record.

    A stream gives a route's row anew whenever rows of it arrive, also if an earlier
    position comes late; the last row of a route is its batch result.
    """
    rows = df.select(F.col(route).alias("route"), F.col(record).cast("string").alias("record"), F.col(pos).cast("long").alias("pos")).where("route is not null and pos is not null")
    if not df.isStreaming:
        least = F.min(F.struct("pos", "record")).alias("x")
        return rows.groupBy("route").agg(least, (F.count(F.lit(1)) - 1).alias("duplicates")).select("route", "x.record", "x.pos", "duplicates")
    return rows.groupBy("route").transformWithStateInPandas(FirstArrival(), "route string, record string, pos long, duplicates long", "Update", "None")


class FacetOfRecord(StatefulProcessor):
    """Per record: its newest version's facet; a change takes back the old one."""

    SCHEMA = T.StructType([T.StructField("version", T.LongType()), T.StructField("facet", T.StringType())])

    def init(self, handle) -> None:
        self.held = handle.getValueState("facet", self.SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.held.exists()
        version, facet = self.held.get() if known else (None, None)
        before = facet
        for b in rows:
            newest = b[b["version"] == b["version"].max()]
            of = sorted(f for f in newest["facet"] if f is not None)
            top, least = int(newest["version"].iloc[0]), (of[0] if of else None)
            if version is None or top > version:
                version, facet = top, least
            elif top == version:  # of one version the least facet counts
                facet = min(f for f in (facet, least) if f is not None) if facet is not None or least is not None else None
        self.held.update((version, facet))
        if before != facet:
            out = [(f, d) for f, d in ((before, -1), (facet, 1)) if f is not None]
            yield pd.DataFrame(out, columns=["facet_key", "delta"])

    def close(self) -> None:
        pass


def facet_changes(df: DataFrame, record: str, version: str, facet: Column) -> DataFrame:
    """(facet_key, delta): +1 where a record takes a facet, -1 where it leaves it; the sums are the facets' counts.

    Rows that repeat and versions that come late change nothing.  The batch form gives the sums' one step.
    """
    rows = df.select(F.col(record).cast("string").alias("record"), F.col(version).cast("long").alias("version"), facet.alias("facet")).where("record is not null and version is not null")
    if not df.isStreaming:
        newest = rows.groupBy("record").agg(F.min_by("facet", F.struct(-F.col("version"), F.col("facet").isNull(), F.col("facet"))).alias("facet_key"))
        return newest.where("facet_key is not null").select("facet_key", F.lit(1).cast("long").alias("delta"))
    return rows.groupBy("record").transformWithStateInPandas(FacetOfRecord(), "facet_key string, delta long", "Append", "None")


def counts(changes: DataFrame) -> DataFrame:
    """(facet_key, case_count) of changes; facets that all records left are gone."""
    return changes.groupBy("facet_key").agg(F.sum("delta").alias("case_count")).where("case_count <> 0")
