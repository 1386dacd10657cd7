"""Continuous ingest: facets kept up to date per micro-batch, and watermarked counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def yearly_counts(stream: DataFrame, ts: str, key: str, late: str = "1 day", width: str = "365 days") -> DataFrame:
    """Counts per key and window; rows later than `late` are dropped by the watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"))


def facet_stream(stream: DataFrame, table: str, checkpoint: str, key: str, record: str):
    """Appends each batch's distinct (key, record) pairs to `table`, tagged with the batch.

    A batch that is run again replaces its own rows, so results are exactly once;
    readers count distinct records.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(key, record).distinct().withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def facet_counts(df: DataFrame, key: str, record: str) -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(record).alias("case_count"))


def observed(df: DataFrame, name: str, bytes_of: str) -> tuple[DataFrame, Observation]:
    """`df` with an observation of its rows and bytes, filled when it is read; it costs no second pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(bytes_of)).alias("bytes")), seen


class Progress(StreamingQueryListener):
    """What a stream has read so far, by query."""

    def __init__(self):
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event):
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event):
        p = event.progress
        self.rows[str(p.id)] = self.rows.get(str(p.id), 0) + p.numInputRows

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
