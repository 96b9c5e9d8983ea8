"""Writers: appends, replacement by document or task, upsert, cascade delete.

Targets are Parquet folders; those replaced in parts are partitioned by a hash bucket of the document, so a
replacement rewrites the buckets of its documents and the number of folders stays bounded.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARTITION, BUCKET, BUCKETS = "document_id", "document_bucket", 256


def append(rows: DataFrame, path: str, partition: str | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(PARTITION), F.lit(BUCKETS)).cast("int"))


def _overwrite_buckets(rows: DataFrame, path: str) -> None:
    rows.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def replace_documents(rows: DataFrame, documents: DataFrame, path: str) -> None:
    """The rows of the documents in `documents` (document_id) give way to rows; those of others stay. A document without rows ends with none."""
    spark = rows.sparkSession
    fresh = bucketed(rows)
    try:
        old = spark.read.parquet(path)
    except AnalysisException:  # nothing is there yet
        _overwrite_buckets(fresh, path)
        return
    touched = bucketed(documents.select(PARTITION)).select(BUCKET).distinct()
    stay = old.join(F.broadcast(touched), BUCKET, "left_semi").join(documents.select(PARTITION).distinct(), PARTITION, "left_anti")
    # what stays is read from the folder that is overwritten, so it is set down before
    _overwrite_buckets(stay.select(*old.columns).unionByName(fresh.select(*old.columns)).checkpoint(), path)


def write_index(chunks: DataFrame, path: str) -> None:
    """Non-blank chunks in place of the chunks of their documents; other documents' chunks stay."""
    replace_documents(chunks.where(F.length(F.trim("chunk_text")) > 0), chunks.select(PARTITION).distinct(), path)


def replaced_by_task(old: DataFrame, new: DataFrame) -> DataFrame:
    """Artifacts, blocks or tables: all rows of the (document_id, task_id) in new give way to new."""
    return old.join(new.select(PARTITION, "task_id").distinct(), [PARTITION, "task_id"], "left_anti").unionByName(new)


def snapshot(rows: DataFrame, links: list[str], first_id: int) -> DataFrame:
    """A document's rows with new ids, and the links between them (columns that hold ids) written anew; links to unknown ids become null."""
    order = Window.partitionBy(PARTITION).orderBy("id")
    ids = rows.select(PARTITION, "id", (F.lit(first_id) + F.row_number().over(order) - 1).alias("new_id"))
    out = rows.join(ids, [PARTITION, "id"])
    for link in links:
        out = out.join(ids.select(PARTITION, F.col("id").alias(link), F.col("new_id").alias(f"new_{link}")), [PARTITION, link], "left").withColumn(link, F.col(f"new_{link}")).drop(f"new_{link}")
    return out.withColumn("id", F.col("new_id")).drop("new_id")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new put in place by key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def without_documents(tables: dict[str, DataFrame], documents: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given documents."""
    return {name: t.join(documents.select(PARTITION), PARTITION, "left_anti") for name, t in tables.items()}


def cleared_defaults(rows: DataFrame, key: str, current: int, flag: str = "is_default") -> DataFrame:
    return rows.withColumn(flag, F.when(F.col(key) != current, 0).otherwise(F.col(flag)))


#: Tables of a search's trace.
TRACES = ("channel_executions", "retrieval_results", "stages")


def write_trace(rows: dict[str, DataFrame], folder: str, run: str) -> None:
    """The trace of one run: a table's rows of this run are written anew, those of other runs stay."""
    if unknown := set(rows) - set(TRACES):
        raise ValueError(f"a trace has the tables {TRACES}, not {sorted(unknown)}")
    for table, found in rows.items():
        found.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{folder}/{table}")


def read_trace(spark, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}")
