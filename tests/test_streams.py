"""Summaries, phases, queues, late rows and time limits: streams equal batches, and crashes change nothing."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.plans import channels
from docloom.streaming import ingest, late, phases, queue, summary

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run_files(spark, frames, folder, schema, build, checkpoint, name):
    """Feeds frames one file at a time; returns the rows of the memory sink."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(folder)
    out = []
    for n, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(folder)
        table = f"{name}_{n}"
        seen = []
        stream = build(spark.readStream.schema(schema).parquet(folder))
        q = stream.writeStream.outputMode("update").foreachBatch(lambda rows, _, seen=seen: seen.extend(rows.collect())).option("checkpointLocation", checkpoint).queryName(table).trigger(availableNow=True).start()
        q.awaitTermination()
        out += seen
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_summaries_equal_batch(rocks, tmp_path, seed):
    spark, r = rocks, random.Random(seed)
    rows = [(c, t, r.choice([f"question {c} {t}", " ", None, f"问题 {'x' * 200}"]), r.choice([f"answer {t}", "", None]), r.random() < 0.9) for c in range(5) for t in range(r.randrange(3, 20))]
    cut = sorted(r.sample(range(len(rows)), 2))
    by_turn = sorted(rows, key=lambda x: x[1])
    parts = [by_turn[: cut[0]], by_turn[cut[0] : cut[1]], by_turn[: cut[1]][-10:], by_turn[cut[1] :]]  # the third is a replay
    frames = [spark.createDataFrame(p, summary.EXCHANGES) for p in parts if p]
    seen = run_files(spark, frames, str(tmp_path / "in"), summary.EXCHANGES, lambda s: summary.summaries(s, 2, 3), str(tmp_path / "cp"), f"summary{seed}")
    newest = {}
    for x in seen:
        newest[x["conv_id"]] = tuple(x)
    want = {x["conv_id"]: tuple(x) for x in summary.batch_summaries(spark.createDataFrame(rows, summary.EXCHANGES), 2, 3).collect()}
    assert newest == want and any(x[3] for x in want.values())


def test_summary_by_hand():
    done = summary.Summary().folded([(1, " a ", "b"), (2, "c", "")])
    assert done == (2, 2, 1, "c", ("a", "c"), "用户关注：a；已有结论：b；用户关注：c")
    again = done.folded([(3, "a", "d")])
    assert again.questions == ("a", "c") and again.goal == "c" and again.text.endswith(";用户关注：a；已有结论：d")
    assert len(again.folded([(4, "x" * 5000, "y" * 5000)] * 40).text) <= summary.MAX_CHARS


# phases


class Killed(BaseException):
    pass


def chain(spark, folder, crash_after=None, fail_in=None):
    def phase(name, fn):
        def run(rows):
            if fail_in == name:
                raise RuntimeError(f"{name} broke")
            return fn(rows)

        return phases.Phase(name, run)

    made = phases.Chain(spark, folder, [
        phase("parse", lambda rows: rows.select("task_id", F.upper("text").alias("text"), F.when(F.col("text") == "bad", "can't be read").alias("error"))),
        phase("split", lambda rows: rows.select("task_id", F.explode(F.split("text", " ")).alias("word"))),
        phase("index", lambda rows: rows.groupBy("task_id").agg(F.count("*").alias("n")).withColumn("error", F.when(F.col("n") > 3, "too long"))),
    ])
    if crash_after is not None:
        commit, left = made._commit, [crash_after]

        def crashing(*args):
            if left[0] == 0:
                raise Killed
            left[0] -= 1
            commit(*args)

        made._commit = crashing
    return made


def tables(made):
    return {p: sorted(map(tuple, made.table(p).select("task_id", *sorted(set(made.table(p).columns) - {"task_id"})).collect())) for p in ("parse", "split", "index")}


TASKS = [(1, "a b"), (2, "bad"), (3, "a b c d"), (4, "x")]


def test_a_crash_at_any_commit_changes_nothing(spark, tmp_path):
    tasks = spark.createDataFrame(TASKS, "task_id long, text string")
    whole = chain(spark, str(tmp_path / "whole"))
    whole.run("r", tasks)
    want, failed = tables(whole), sorted(map(tuple, whole.failures().collect()))
    assert {t for t, *_ in want["split"]} == {1, 4} and [(x[1], x[2]) for x in failed] == [(2, "parse"), (3, "index")]
    assert {r["task_id"]: r["status"] for r in whole.status("r", tasks).collect()} == {1: "DONE", 2: "FAILED", 3: "FAILED", 4: "DONE"}
    for crash in range(4):
        folder = str(tmp_path / f"crash{crash}")
        with pytest.raises(Killed):
            chain(spark, folder, crash_after=crash).run("r", tasks)
        resumed = chain(spark, folder)
        assert len(resumed.commits("r")) == crash and resumed.table("parse") is None
        resumed.run("r", tasks)
        assert tables(resumed) == want and sorted(map(tuple, resumed.failures().collect())) == failed


def test_a_failed_run_is_taken_back(spark, tmp_path):
    tasks, folder = spark.createDataFrame(TASKS, "task_id long, text string"), str(tmp_path / "c")
    chain(spark, folder).run("good", tasks)
    before = tables(chain(spark, folder))
    with pytest.raises(RuntimeError, match="index broke"):
        chain(spark, folder, fail_in="index").run("bad", tasks)
    after = chain(spark, folder)
    assert tables(after) == before and after.commits("bad") == []
    assert {r["status"] for r in after.status("bad", tasks).collect()} == {"FAILED"}
    assert not (tmp_path / "c" / "parse" / "run=bad").exists()


# queues


def test_failing_tasks_are_retried_in_order(spark, tmp_path):
    clock, calls = [0.0], {"parse": [], "index": []}
    failures = {("parse", 1): 2, ("index", 3): 1, ("parse", 4): 99}
    schema = "task_id long, document_id long, text string"

    def process(name):
        def run(rows):
            found = rows.collect()
            calls[name] += [r["task_id"] for r in found]
            out = []
            for r in found:
                left = failures.get((name, r["task_id"]), 0)
                failures[name, r["task_id"]] = left - 1
                out.append((*r, "not now" if left > 0 else None))
            return spark.createDataFrame(out, f"{schema}, error string")

        return run

    inbox = str(tmp_path / "inbox")
    spark.createDataFrame([(1, 10, "a"), (2, 10, "b"), (3, 11, "c"), (4, 12, "d"), (1, 10, "a")], schema).write.parquet(inbox)
    parse = queue.Consumer(spark, "parse", inbox, schema, str(tmp_path), process("parse"), lambda: clock[0], most_attempts=4, delay=10)
    index = queue.Consumer(spark, "index", parse.target, schema, str(tmp_path), process("index"), lambda: clock[0], delay=10)
    parse.run()
    assert calls["parse"] == [1, 3, 4] or sorted(calls["parse"]) == [1, 3, 4]
    parse.run()
    assert sorted(calls["parse"]) == [1, 3, 4]  # nothing is due
    spark.createDataFrame([(3, 11, "c")], schema).write.mode("append").parquet(inbox)  # a replay

    def pause():
        clock[0] += 15

    queue.drain([parse, index], pause=pause)
    indexed = [r["task_id"] for r in spark.read.parquet(index.target).collect()]
    assert sorted(indexed) == [1, 2, 3]
    assert calls["parse"].count(1) == 3 and calls["parse"].index(2) > max(i for i, x in enumerate(calls["parse"]) if x == 1)
    assert calls["index"].index(2) > calls["index"].index(1) and calls["index"].count(3) == 2
    assert [(r["task_id"], r["attempts"]) for r in spark.read.parquet(parse.dead).collect()] == [(4, 4)]


# windows


def test_windows_and_late_rows_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type").orderBy("ts").toPandas()
    cut = len(events) // 2
    old = events.iloc[: cut // 10]  # comes last, far behind the watermark
    parts = [events.iloc[cut // 10 : cut], events.iloc[cut:], old]
    schema = "event_id long, user_id long, ts timestamp, event_type string"
    source, in_time, behind = (str(tmp_path / x) for x in ("in", "in_time", "late"))
    make = lambda p: spark.createDataFrame(p[["event_id", "user_id", "ts", "event_type"]], schema).coalesce(1)
    for part in parts:
        make(part).write.mode("append").parquet(source)
        late.split_late(ingest.stream(spark, source, schema), "2 hours", in_time, behind, str(tmp_path / "cp")).awaitTermination()
    kept, dropped = spark.read.parquet(in_time).drop("batch"), spark.read.parquet(behind).drop("batch")
    assert dropped.count() > 0 and {r["event_id"] for r in dropped.collect()} <= set(old["event_id"])
    assert sorted(r["event_id"] for r in kept.unionByName(dropped).collect()) == sorted(events["event_id"])
    # a last row far ahead lets every window close
    make(pd.DataFrame([(-1, -1, events["ts"].max() + pd.Timedelta(days=9), "end")], columns=events.columns)).write.parquet(f"{in_time}/batch=99999999")
    make(pd.DataFrame([(-2, -2, events["ts"].max() + pd.Timedelta(days=10), "end")], columns=events.columns)).write.parquet(f"{in_time}/batch=99999999a")
    for n, (build, batch) in enumerate([
        (late.tumbling_counts, lambda x: late.tumbling_counts(x)), (late.sliding_counts, lambda x: late.sliding_counts(x)), (late.session_counts, lambda x: late.session_counts(x)),
    ]):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 3).parquet(in_time)
        q = build(stream).writeStream.outputMode("append").format("memory").queryName(f"windows{n}").option("checkpointLocation", str(tmp_path / f"w{n}")).trigger(availableNow=True).start()
        q.awaitTermination()
        closed = spark.table(f"windows{n}").where("event_type <> 'end'" if n < 2 else "user_id >= 0")
        got = sorted(map(tuple, closed.collect()))
        assert got == sorted(map(tuple, batch(kept).collect())), n
        if n < 2:  # counts add up with the late rows
            keys = ["start_ts", "end_ts", "event_type"]
            both = closed.unionByName(batch(dropped)).groupBy(*keys).agg(F.sum("n").alias("n"))
            assert sorted(map(tuple, both.select(*keys, "n").collect())) == sorted(map(tuple, batch(make(events)).collect()))


# time limits


def test_a_slow_channel_degrades(spark):
    spark.range(1).count()
    hits = spark.createDataFrame([(1, 5, 0.9), (1, 6, 0.8)], channels.HITS)

    def slow():
        @F.udf("double")
        def wait(x):
            time.sleep(60)
            return x

        return hits.withColumn("score", wait("score"))

    def broken():
        raise ValueError("no such index")

    began = time.monotonic()
    found, notes = channels.degraded_search(spark, {"vector": lambda: hits, "keyword": slow}, limits={"keyword": 4.0, "vector": 90.0})
    rows = found.collect()
    assert time.monotonic() - began < 50
    assert [(r["chunk_id"], r["channel"], r["degraded"]) for r in sorted(rows, key=lambda r: r["final_rank"])] == [(5, "vector", True), (6, "vector", True)]
    assert notes == ["channel keyword gave no hits: timeout"]
    found, notes = channels.degraded_search(spark, {"vector": lambda: hits, "keyword": broken}, limits={"vector": 90.0})
    assert notes == ["channel keyword gave no hits: no such index"] and found.count() == 2
    found, notes = channels.degraded_search(spark, {"vector": lambda: hits, "keyword": lambda: hits}, limits={"vector": 90.0, "keyword": 90.0})
    assert {r["degraded"] for r in found.collect()} == {False} and notes == []
    for _ in range(50):  # the late channel's job was cancelled
        if not spark.sparkContext.statusTracker().getActiveJobsIds():
            break
        time.sleep(0.2)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
