"""Table functions for SQL: greedy packing and posting blocks over sorted partitions.

    SELECT * FROM pack_parts(TABLE(rows) PARTITION BY grp ORDER BY (pos, bytes), 'bytes', 20, 30000)
    SELECT * FROM posting_blocks(TABLE(grams) PARTITION BY gram ORDER BY (ordinal), 'gram', 'ordinal', 65536)

Spark deals and sorts the rows; each function streams a partition and keeps one open part
or block, so a group of any size passes through.  Rows of pack_parts come back whole with
their part, so nothing is joined and equal keys multiply nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.hashing import encode_differences
from .bands import Packer


class PackParts:
    """Every row and its part; the size column is named, then the limits of rows and bytes."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, size: AnalyzeArgument, most_rows: AnalyzeArgument, most_bytes: AnalyzeArgument) -> AnalyzeResult:
        names = rows.dataType.names
        if size.value not in names:
            raise ValueError(f"no column {size.value!r} among {names}")
        return AnalyzeResult(T.StructType([*rows.dataType.fields, T.StructField("part", T.LongType())]))

    def __init__(self):
        self.packer = None

    def eval(self, row, size, most_rows, most_bytes):
        if self.packer is None:
            self.packer = Packer(most_rows, most_bytes)
        yield (*row, self.packer.place(row[size]))


class PostingBlocks:
    """(key, page, first, last, n, data) of sorted (key, ordinal) rows; a repeated ordinal counts once."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, ordinal: AnalyzeArgument, page: AnalyzeArgument) -> AnalyzeResult:
        long = lambda n: T.StructField(n, T.LongType())
        own = T.StructField(key.value, rows.dataType[key.value].dataType)
        return AnalyzeResult(T.StructType([own, long("page"), long("first"), long("last"), long("n"), T.StructField("data", T.BinaryType())]))

    def __init__(self):
        self.key, self.page, self.held = None, None, []

    def _block(self):
        values = np.array(self.held, np.int64)
        return self.key, self.page, self.held[0], self.held[-1], len(self.held), encode_differences(values, np.array([0, len(values)]))[0]

    def eval(self, row, key, ordinal, page):
        now = row[ordinal] // page
        if self.held and now != self.page:
            yield self._block()
            self.held = []
        if not self.held or self.held[-1] != row[ordinal]:
            self.key, self.page = row[key], now
            self.held.append(row[ordinal])

    def terminate(self):
        if self.held:
            yield self._block()


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    spark.udtf.register("pack_parts", udtf(PackParts))
    spark.udtf.register("posting_blocks", udtf(PostingBlocks))
