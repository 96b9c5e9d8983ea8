"""Relational queries of the admin pages: coverage, distributions, counts, pages, scope checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE_SIZE, PAGE_CAP = 20, 100


def page(rows: DataFrame, order: list, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """A page of ordered rows: numbers from 1, sizes 1 to 100."""
    number, size = max(1, number), min(PAGE_CAP, size if size > 0 else PAGE_SIZE)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def live(rows: DataFrame) -> DataFrame:
    """Soft-deleted rows dropped: live rows have deleted = 0."""
    return rows.where("deleted = 0")


def counts_with_missing(left: DataFrame, right: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows of right for each key of left, 0 where there are none."""
    counts = right.groupBy(key).agg(F.count("*").alias(name))
    return left.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def status_summary(rows: DataFrame, status: str, value: str, high: float) -> DataFrame:
    return rows.groupBy(status).agg(
        F.count("*").alias("n"), F.count_if(F.col(value) >= high).alias("high"), F.count_distinct("user_id").alias("users"), F.round(F.avg(value), 6).alias("avg_value")
    )


def top_distribution(rows: DataFrame, key: str, value: str, ok: str, k: int = 6) -> DataFrame:
    found = rows.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("avg_value"), F.count_if(F.col("event_type") != ok).alias("other"))
    return found.orderBy(F.col("n").desc(), key).limit(k)


def scope_conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value: what must be unique and isn't."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("kinds")).where("kinds > 1")


def sessions_by_gap(events: DataFrame, minutes: int) -> DataFrame:
    """Session windows of each user, closed after a gap."""
    return events.groupBy("user_id", F.session_window("ts", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


def tumbling(events: DataFrame, width: str) -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start_ts"), "event_type", "n", "total")


def newest_version(rows: DataFrame, key: str, version: str) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(version).desc()))).where("n = 1").drop("n")
