"""What stored indexes share: terms, a shared folder, and indexes built on first use, once for each state of their table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import vectors as V

#: Terms are lower-cased Latin words of two letters or more and Han characters.
TERMS = r"[a-z0-9]{2,}|\p{IsHan}"

_STORED: dict[tuple[str, str, str, int], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a cluster must name one in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="docloom-index-")
    return f"{base}/{uuid.uuid4().hex}"


def once(rows: DataFrame) -> DataFrame:
    """Rows written to a shared folder, so that all that reads them finds them made."""
    folder = shared_folder(rows.sparkSession)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def terms_of(text) -> F.Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERMS), F.lit(0))


def state_of(spark: SparkSession, table: str) -> int:
    """A number that changes when files of a table come, go or are written anew."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(table)
    return files.agg(F.coalesce(F.bit_xor(F.xxhash64("path", "modificationTime", "length")), F.lit(0))).first()[0]


def stored(spark: SparkSession, kind: str, table: str, build: Callable[[str], None]) -> str:
    """The folder of the index of this kind over a table: built on its first use in this application, and again when the table has changed."""
    key = (spark.sparkContext.applicationId, kind, table, state_of(spark, table))
    if key not in _STORED:
        folder = shared_folder(spark)
        build(folder)
        _STORED[key] = folder
    return _STORED[key]


def with_norms(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """vectors with the column as doubles and its length in `norm`."""
    return vectors.withColumn(column, V.doubles(F.col(column))).withColumn("norm", F.sqrt(V.dot(F.col(column), F.col(column))))
