"""A chain of phases over tasks, with a commit after each: resume after the last commit, fail fast, take back what a failed run wrote.

A phase turns the tasks' rows into new rows. A run writes every phase's rows to a folder of its own and then a commit; a
run that is started again skips phases with a commit and writes the others anew, so a crash at any point changes nothing
in the tables. Rows that a phase returns with an `error` fail their task: it leaves the chain, and its rows of all phases
are taken back when the run ends. An exception fails the whole run: its folders are removed, its tasks are failures, and
the exception goes on. Readers see the rows of published runs only.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "run string, step int, phase string"
FAILURES = "run string, task_id long, phase string, error string"
PUBLISHED = "published"


class Phase(NamedTuple):
    """run: rows with task_id to rows with task_id and, where a task fails, error."""

    name: str
    run: Callable[[DataFrame], DataFrame]


class Chain:
    def __init__(self, spark: SparkSession, folder: str, phases: list[Phase]):
        names = [p.name for p in phases]
        if len(set(names)) != len(names) or {PUBLISHED, "commits", "failures"} & set(names):
            raise ValueError(f"phases need names of their own: {names}")
        self.spark, self.folder, self.phases = spark, folder, phases

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}")
        except AnalysisException:  # nothing is written yet
            return self.spark.createDataFrame([], schema)

    def commits(self, run: str) -> list[str]:
        """The committed phases of a run, in order."""
        return [r["phase"] for r in self._read("commits", COMMITS).where(F.col("run") == run).orderBy("step").collect()]

    def failures(self) -> DataFrame:
        return self._read("failures", FAILURES).distinct()

    def _commit(self, run: str, step: int, phase: str) -> None:
        self.spark.createDataFrame([(run, step, phase)], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def _stage(self, phase: str, run: str) -> str:
        return f"{self.folder}/{phase}/run={run}"

    def run(self, run: str, tasks: DataFrame) -> None:
        """Runs or resumes a run over tasks (task_id, ...). tasks must be the same when a run is resumed."""
        done = self.commits(run)
        if PUBLISHED in done:
            return
        try:
            rows = tasks
            for step, phase in enumerate(self.phases):
                if phase.name not in done:
                    phase.run(rows).write.mode("overwrite").parquet(self._stage(phase.name, run))
                    self._commit(run, step, phase.name)
                rows = self.spark.read.parquet(self._stage(phase.name, run))
                if "error" in rows.columns:
                    rows = rows.where("error is null").drop("error")
        except Exception as error:  # not KeyboardInterrupt and the like: a killed process leaves its run to be resumed
            self._take_back(run, tasks, phase.name, error)
            raise
        self._fail_tasks(run)
        self._commit(run, len(self.phases), PUBLISHED)

    def _fail_tasks(self, run: str) -> None:
        for phase in self.phases:
            rows = self.spark.read.parquet(self._stage(phase.name, run))
            if "error" in rows.columns:
                failed = rows.where("error is not null").select(F.lit(run).alias("run"), F.col("task_id").cast("long").alias("task_id"), F.lit(phase.name).alias("phase"), F.substring("error", 1, 500).alias("error"))
                failed.write.mode("append").parquet(f"{self.folder}/failures")

    def _take_back(self, run: str, tasks: DataFrame, phase: str, error: Exception) -> None:
        failed = tasks.select(F.lit(run).alias("run"), F.col("task_id").cast("long").alias("task_id"), F.lit(phase).alias("phase"), F.lit(str(error)[:500]).alias("error"))
        failed.write.mode("append").parquet(f"{self.folder}/failures")
        for x in reversed(self.phases):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._stage(x.name, run))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        left = self._read("commits", COMMITS).where(F.col("run") != run).collect()  # a row for each phase of a run
        self.spark.createDataFrame(left, COMMITS).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits")

    def table(self, phase: str) -> DataFrame | None:
        """A phase's rows of published runs, without those of failed tasks; None before the first run."""
        runs = [r["run"] for r in self._read("commits", COMMITS).where(F.col("phase") == PUBLISHED).select("run").distinct().collect()]
        if not runs:
            return None
        rows = self.spark.read.option("basePath", f"{self.folder}/{phase}").parquet(*[self._stage(phase, r) for r in runs])
        rows = rows.where("error is null").drop("error") if "error" in rows.columns else rows
        return rows.join(self.failures().select("run", "task_id"), ["run", "task_id"], "left_anti")

    def status(self, run: str, tasks: DataFrame) -> DataFrame:
        """task_id, status (DONE, FAILED or RUNNING) and the phase reached or failed in."""
        done = self.commits(run)
        failed = self.failures().where(F.col("run") == run).groupBy("task_id").agg(F.first("phase").alias("failed_in"))
        state = F.when(F.col("failed_in").isNotNull(), "FAILED").when(F.lit(PUBLISHED in done), "DONE").otherwise("RUNNING")
        reached = done[-2] if PUBLISHED in done else done[-1] if done else None
        return tasks.select("task_id").join(failed, "task_id", "left").select("task_id", state.alias("status"), F.coalesce("failed_in", F.lit(reached)).alias("phase"))
