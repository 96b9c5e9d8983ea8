"""What the training-data operators share: word rules, table reading and shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blank characters (space and U+0009 to U+000D); words are the runs of all others.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole(text: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    trimmed = F.btrim(whole(text), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is named, local sessions (tests) get one and clusters an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named


#: Tables and folders written by this process and not dropped yet.
_SCRATCH: list[str] = []


def saved(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunked(docs: DataFrame, chunk_bytes: int, extra: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(doc_id, text, extra columns, row, chunk) as a table bucketed by chunk, and its total of text bytes.

    A chunk is a set of whole documents of one input partition, of about chunk_bytes together, chosen by the
    row number (a long of its own for each row), so texts are not shuffled to make chunks. Grouping this table
    by chunk shuffles no texts either.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"), *extra)
    parts = docs.groupBy(F.spark_partition_id().alias("part")).agg(F.sum(F.octet_length("text")).alias("n"))
    total, most = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    cuts = max(1, -(-most // chunk_bytes))
    buckets = int(min(4096, max(24, total // (32 << 20))))
    placed = docs.withColumn("row", F.monotonically_increasing_id()).withColumn("chunk", F.spark_partition_id().cast("long") * cuts + F.pmod(F.xxhash64("row"), F.lit(cuts)))
    return _kept_table(placed, buckets, "chunk"), total


def by_row(docs: DataFrame) -> DataFrame:
    """(row, doc): a number of its own for each row and all its columns, as a table bucketed by row: joins on row shuffle only their other side."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = int(min(4096, max(24, total // (32 << 20))))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc"))
    return _kept_table(numbered.repartition(buckets, "row"), buckets, "row")


def _kept_table(df: DataFrame, buckets: int, key: str) -> DataFrame:
    """df as a bucketed table whose files lie in the shared folder."""
    name = f"docloom_{uuid.uuid4().hex}"
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    _SCRATCH.extend([path, name])  # the table goes before its files
    return df.sparkSession.table(name)


def drop_scratch(spark: SparkSession) -> None:
    """Drops the scratch tables and folders of this session; call it when the results made from them are written."""
    while _SCRATCH:
        name = _SCRATCH.pop()
        if "/" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        else:
            spark.sql(f"drop table if exists {name}")
