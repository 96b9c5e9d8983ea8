"""Streams: idempotent ingest by micro-batch, windowed event counts, incremental conversation state.

Queues with retries are in `queue`, phases with commits in `phases`, late rows in `late`, summaries in `summary`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def ingest(tasks: DataFrame, process: Callable[[DataFrame], DataFrame], target: str, failed: str, checkpoint: str):
    """Runs `process` on each micro-batch of tasks (task_id, ...); its rows must carry task_id.

    A batch is one folder of target, overwritten when the batch is replayed, and what is done is read from
    target itself, so a crash at any point neither loses nor doubles a task. A task that an earlier batch
    finished is skipped. Where process fails with a ValueError the batch's tasks go to `failed` with the reason
    and the stream goes on; other errors stop it, and the batch runs again after a restart.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows = rows.dropDuplicates(["task_id"])
        try:
            earlier = spark.read.parquet(target).where(F.col("batch") < number).select("task_id")
            rows = rows.join(earlier, "task_id", "left_anti")
        except AnalysisException:  # the first batch
            pass
        rows = rows.persist()
        try:
            process(rows).write.mode("overwrite").parquet(f"{target}/batch={number}")
        except ValueError as error:
            rows.select("task_id", F.lit(str(error)[:500]).alias("reason")).write.mode("overwrite").parquet(f"{failed}/batch={number}")
        finally:
            rows.unpersist()

    return tasks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resumable(tasks: DataFrame, finished: DataFrame) -> DataFrame:
    """Tasks (task_id, phase_no) with the phase to go on with: one after the last finished (task_id, phase_no); tasks without one start at 1."""
    last = finished.groupBy("task_id").agg(F.max("phase_no").alias("last"))
    return tasks.join(last, "task_id", "left").withColumn("next_phase", F.coalesce(F.col("last") + 1, F.lit(1))).drop("last")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start_ts"), "event_type", "n")


def covered_turns(turns: DataFrame) -> DataFrame:
    """Keyed state of a conversation: the highest turn seen and how many were counted; repeated turns count once."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        covered, count = state.get if state.exists else (-1, 0)
        for rows in batches:
            fresh = sorted({t for t in rows["turn"] if t > covered})
            if fresh:
                covered, count = int(fresh[-1]), count + len(fresh)
        state.update((covered, count))
        yield pd.DataFrame({"conv_id": [key[0]], "covered_turn": [covered], "covered_count": [count]})

    return turns.groupBy("conv_id").applyInPandasWithState(update, "conv_id long, covered_turn long, covered_count long", "covered long, count long", "update", "NoTimeout")
