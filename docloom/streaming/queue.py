"""Task queues on folders with retry-later, for chains of streams.

A consumer reads its inbox and its own retry folder as one stream. Of every document the first waiting task is handled
if it is due; the others go back to the retry folder as they are, so a document's tasks are handled in order. A task that
fails goes back with one more attempt and a later due time, or to the dead letters after the last. What is done goes to
the target, which may be the inbox of the next consumer, and its id to a table that each micro-batch asks for its own
buckets only. A micro-batch writes folders of its own number, so a replay writes the same places again.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_ATTEMPTS, DELAY, BUCKETS = 4, 60.0, 64
STATE = "attempts int, due double, reason string"


class Consumer:
    """process: tasks (task_id, document_id, ...) to rows with task_id, document_id and error (null where it went well)."""

    def __init__(self, spark: SparkSession, name: str, inbox: str, schema: str, folder: str, process: Callable[[DataFrame], DataFrame], clock: Callable[[], float] = time.time, most_attempts: int = MOST_ATTEMPTS, delay: float = DELAY):
        self.spark, self.name, self.inbox, self.schema, self.process, self.clock = spark, name, inbox, schema, process, clock
        self.most_attempts, self.delay = most_attempts, delay
        self.target, self.retry, self.dead, self.done, self.checkpoint = (f"{folder}/{name}/{x}" for x in ("target", "retry", "dead", "done", "checkpoint"))

    def _columns(self) -> list[str]:
        return [f.name for f in self.spark.createDataFrame([], self.schema).schema]

    def run(self) -> bool:
        """Handles what waits now. True if tasks still wait."""
        fresh = self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.inbox)
        fresh = fresh.withColumns({"attempts": F.lit(0), "due": F.lit(0.0), "reason": F.lit(None).cast("string")})
        self.spark.createDataFrame([], f"{self.schema}, {STATE}").write.mode("ignore").parquet(f"{self.retry}/batch=none")
        again = self.spark.readStream.schema(f"{self.schema}, {STATE}").option("recursiveFileLookup", "true").parquet(self.retry)
        self._waiting = False
        query = fresh.unionByName(again).writeStream.foreachBatch(self._batch).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return self._waiting

    def _not_done(self, rows: DataFrame, number: int) -> DataFrame:
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("task_id"), F.lit(BUCKETS)).cast("int"))
        buckets = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # BUCKETS at most
        try:
            done = self.spark.read.parquet(self.done).where(F.col("bucket").isin(buckets) & (F.col("batch") < number)).select("task_id")
        except AnalysisException:  # the first batch
            return rows.drop("bucket")
        return rows.drop("bucket").join(done, "task_id", "left_anti")

    def _batch(self, rows: DataFrame, number: int) -> None:
        now, columns = self.clock(), self._columns()
        others = F.struct(*[c for c in rows.columns if c not in ("task_id",)])
        # a task that came twice counts with its most attempts
        rows = rows.groupBy("task_id").agg(F.max_by(others, F.struct("attempts", "due")).alias("x")).select("task_id", "x.*")
        rows = self._not_done(rows, number).persist()
        try:
            first = F.row_number().over(Window.partitionBy("document_id").orderBy("task_id")) == 1
            rows = rows.withColumn("turn", first & (F.col("due") <= now)).persist()
            handled = self.process(rows.where("turn").select(*columns)).persist()
            ok = handled.where("error is null").drop("error")
            bad = handled.where("error is not null").groupBy("task_id").agg(F.first("error").alias("error"))
            ok = ok.join(bad.select("task_id"), "task_id", "left_anti")
            ok.write.mode("overwrite").parquet(f"{self.target}/batch={number}")
            marks = rows.where("turn").join(bad.select("task_id"), "task_id", "left_anti").select("task_id", F.pmod(F.xxhash64("task_id"), F.lit(BUCKETS)).cast("int").alias("bucket"))
            failed = rows.where("turn").join(bad, "task_id").withColumns(
                {"attempts": F.col("attempts") + 1, "due": F.lit(now) + self.delay * F.pow(F.lit(2.0), F.col("attempts")), "reason": F.substring("error", 1, 500)}
            ).drop("error", "turn")
            over = failed.where(F.col("attempts") >= self.most_attempts)
            over.write.mode("overwrite").parquet(f"{self.dead}/batch={number}")
            marks = marks.unionByName(over.select("task_id", F.pmod(F.xxhash64("task_id"), F.lit(BUCKETS)).cast("int").alias("bucket")))
            waiting = rows.where("not turn").drop("turn").unionByName(failed.where(F.col("attempts") < self.most_attempts)).persist()
            self._waiting = not waiting.isEmpty()
            if self._waiting:
                waiting.write.mode("overwrite").parquet(f"{self.retry}/batch={number}")
            # what is done is marked last: until then a replay handles the same tasks and writes the same folders
            marks.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(self.done)
            waiting.unpersist()
            handled.unpersist()
        finally:
            rows.unpersist()


def drain(consumers: list[Consumer], rounds: int = 100, pause: Callable[[], None] = lambda: time.sleep(1)) -> None:
    """Runs a chain of consumers until nothing waits, at most `rounds` times."""
    for _ in range(rounds):
        if not any([c.run() for c in consumers]):
            return
        pause()
