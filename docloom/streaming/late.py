"""Time windows on streams, and late rows kept in a table of their own.

Spark drops rows behind the watermark without a trace. `split_late` marks them first: every shard of the stream sees the
watermark that its micro-batch runs under, rows behind it go to the late table, all others to the table of rows in time.
Windows read that table as their stream; their own watermark is never ahead of the one that the rows were judged by, so they
drop nothing. What the windows count and what the late table holds is together what a batch over all rows counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

SHARDS = 64


def split_late(events: DataFrame, delay: str, in_time: str, late: str, checkpoint: str, shards: int = SHARDS):
    """Starts a query that writes the rows of a stream (ts, ...) to the folders in_time and late. A micro-batch is one folder, written anew when it is replayed."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    names = events.columns
    schema = StructType([*events.schema.fields, StructField("is_late", BooleanType())])

    def mark(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        watermark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        for rows in batches:
            ts = rows["ts"] if rows["ts"].dt.tz is None else rows["ts"].dt.tz_convert("UTC").dt.tz_localize(None)
            yield rows[names].assign(is_late=(ts < watermark).fillna(False))

    sharded = events.withColumn("shard", F.pmod(F.xxhash64(*names), F.lit(shards)))
    marked = sharded.groupBy("shard").applyInPandasWithState(mark, schema, "none boolean", "append", "NoTimeout")

    def write(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            for late_rows, folder in ((False, in_time), (True, late)):
                rows.where(F.col("is_late") == late_rows).drop("is_late").write.mode("overwrite").parquet(f"{folder}/batch={number:08d}")
        finally:
            rows.unpersist()

    return marked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return _windowed(_timed(events, late), F.window("ts", width), ["event_type"])


def sliding_counts(events: DataFrame, width: str = "1 hour", slide: str = "20 minutes", late: str = "2 hours") -> DataFrame:
    """Counts in windows that start every `slide`; a row counts in each window that holds it."""
    return _windowed(_timed(events, late), F.window("ts", width, slide), ["event_type"])


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Counts of each user's sessions: rows no further apart than `gap`."""
    return _windowed(_timed(events, late), F.session_window("ts", gap), ["user_id"])


def _windowed(events: DataFrame, window, keys: list[str]) -> DataFrame:
    counts = events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), *keys, "n")
