"""Channels run side by side under time limits; one that fails or takes too long gives no hits and is marked degraded."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import Future, TimeoutError
from typing import NamedTuple

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans.options import Plan
from docloom.sources.index import shared_folder

HITS = "question_id long, chunk_id long, score double"
#: Seconds that a channel without a limit of its own may take.
LIMIT = 12.0


class Answer(NamedTuple):
    """A channel's hits, written down; why it is degraded, or None."""

    name: str
    hits: DataFrame
    reason: str | None


def within(spark: SparkSession, name: str, hits: Callable[[], DataFrame], folder: str, tag: str) -> Future:
    """Starts a thread that writes a channel's hits under a job tag."""
    done: Future = Future()

    def run() -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            hits().select(F.col("question_id").cast("long"), F.col("chunk_id").cast("long"), F.col("score").cast("double")).write.parquet(folder)
            done.set_result(None)
        except Exception as error:  # the channel's own failure degrades the channel, not the search
            done.set_exception(error)

    InheritableThread(target=run, name=f"channel-{name}", daemon=True).start()
    return done


def answers(spark: SparkSession, channels: dict[str, Callable[[], DataFrame]], limits: dict[str, float] | None = None) -> dict[str, Answer]:
    """Runs all channels at once and waits for each up to its limit, in seconds from the start; the jobs of those that are late are cancelled."""
    import time

    limits, began, out = limits or {}, time.monotonic(), {}
    runs = {name: (f"{shared_folder(spark)}", f"channel-{uuid.uuid4().hex}") for name in channels}
    started = {name: within(spark, name, channels[name], *runs[name]) for name in channels}
    for name, future in sorted(started.items(), key=lambda x: limits.get(x[0], LIMIT)):
        folder, tag = runs[name]
        try:
            future.result(max(0.0, limits.get(name, LIMIT) - (time.monotonic() - began)))
            out[name] = Answer(name, spark.read.schema(HITS).parquet(folder), None)
        except TimeoutError:
            spark.sparkContext.cancelJobsWithTag(tag)
            out[name] = Answer(name, spark.createDataFrame([], HITS), "timeout")
        except Exception as error:
            out[name] = Answer(name, spark.createDataFrame([], HITS), str(error)[:200])
    return out


def degraded_search(spark: SparkSession, channels: dict[str, Callable[[], DataFrame]], plan: Plan | None = None, limits: dict[str, float] | None = None) -> tuple[DataFrame, list[str]]:
    """The final hits over the plan's channels, each row marked `degraded` if a channel is, and a note for each degraded channel."""
    from docloom.operators import retrieval

    plan = plan or Plan()
    found = answers(spark, {c.name: channels[c.name] for c in plan.enabled() if c.name in channels}, limits)
    notes = [f"channel {a.name} gave no hits: {a.reason}" for a in found.values() if a.reason]
    fused = retrieval.fuse(retrieval.gated_channels({a.name: a.hits for a in found.values()}, plan), plan)
    hits = retrieval.final_hits(retrieval.candidates(fused, plan.candidates), plan.final_top_k)
    return hits.withColumn("degraded", F.lit(bool(notes))), notes
