"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing and sharding, in this order.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs; what it returns is written and
read again as the docs of the next. All but the last return the columns of docs.

Defined results: every decision is a row's own, so null and repeated doc_ids lose no row and keep none
that a rule rejects; of near copies the row with the smallest doc_id stays (null is largest), of rows
with that id one. Empty tables give empty results; columns that docs has besides are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import saved, table
from docloom.llm.decontaminate import without_items
from docloom.llm.mixing import mixed
from docloom.llm.near_dedup import deduplicated
from docloom.llm.quality import fit_ratio, kept_documents
from docloom.llm.sharding import shard_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return kept_documents(docs, fit_ratio(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return deduplicated(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_items(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: whole repetitions as repeated rows, a fraction as a cut text."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row of the mix."""
    return shard_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Near-duplicate components and the fitted ratio can't be put in SQL; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
    return docs
