"""Blocks of a document: normalising, statistics, section runs, structure tree and navigation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T


def in_order(order: str = "block_no"):
    return Window.partitionBy("document_id").orderBy(order)


def normalise(blocks: DataFrame) -> DataFrame:
    """blocks: document_id, block_no, block_type, text, section_path. Cleans, drops blanks, renumbers, fills sections forward."""
    clean = blocks.withColumn("text", T.cleaned(F.col("text"))).where(~T.is_blank(F.col("text")))
    numbered = clean.withColumn("block_no", F.row_number().over(in_order()))
    title = F.when(F.col("block_type") == "TITLE", F.col("text"))
    filled = numbered.withColumn("section_path", F.when(T.is_blank(F.col("section_path")), F.coalesce(F.last(title, ignorenulls=True).over(in_order()), F.lit(""))).otherwise(F.col("section_path")))
    return filled.withColumn("canonical_path", F.concat(F.lit("/"), T.slug(F.col("section_path")), F.lit("/"), F.col("block_no")))


def filled_sections(blocks: DataFrame, order: str = "block_no", key: str = "document_id") -> DataFrame:
    """Adds section_path: the text of the last title up to each block, empty before the first."""
    title = F.when(F.col("block_type") == "TITLE", F.trim("text"))
    return blocks.withColumn("section_path", F.coalesce(F.last(title, ignorenulls=True).over(Window.partitionBy(key).orderBy(order)), F.lit("")))


def stats(blocks: DataFrame) -> DataFrame:
    """Heading and paragraph counts, longest paragraph, characters, structure level and quality level of each document."""
    heading = F.col("block_type") == "TITLE"
    found = blocks.groupBy("document_id").agg(
        F.count("*").alias("block_count"), F.count_if(heading).alias("heading_count"), F.count_if(~heading).alias("paragraph_count"),
        F.coalesce(F.max(F.when(~heading, F.char_length("text"))), F.lit(0)).cast("long").alias("max_paragraph"), F.sum(F.char_length("text")).alias("char_count"),
    )
    h, n, c, p = (F.col(x) for x in ("heading_count", "block_count", "char_count", "max_paragraph"))
    return found.withColumns(
        {
            "structure_level": F.when((h >= 10) | (n >= 30), 3).when((h >= 3) | (n >= 10), 2).when((h >= 1) | (n >= 5), 1).otherwise(0),
            "quality_level": F.when((c >= 5000) & (n >= 10) & (p >= 100), 3).when((c >= 1000) & (n >= 3), 2).when(c >= 100, 1).otherwise(0),
        }
    )


def section_runs(rows: DataFrame, key: str, order: list[str], section: str) -> DataFrame:
    """Consecutive rows of one section (gaps and islands): run_no from 1."""
    w = Window.partitionBy(key).orderBy(*order)
    change = F.coalesce((F.col(section) != F.lag(section).over(w)).cast("int"), F.lit(1))
    return rows.withColumn("changed", change).withColumn("run_no", F.sum("changed").over(w)).drop("changed")


TREE = "document_id long, node_no int, parent_no int, depth int, node_type string, title string"


def structure_tree(blocks: DataFrame) -> DataFrame:
    """document_id, node_no, parent_no, depth, node_type, title: titles nest by level, content hangs under the open title.

    A fold with a stack over each document's ordered blocks. Documents are sorted within partitions and read as a
    stream of batches, so neither a document nor a partition is held in memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, stack, n = None, [], 0  # stack: (node, heading level, depth)
        for rows in batches:
            out = []
            for document, kind, level, text in zip(rows["document_id"], rows["block_type"], rows["level"], rows["text"], strict=True):
                if document != current:
                    current, stack, n = document, [(0, 0, 0)], 0
                n += 1
                if kind == "TITLE":
                    while len(stack) > 1 and stack[-1][1] >= level:
                        stack.pop()
                    out.append((document, n, stack[-1][0], stack[-1][2] + 1, "SECTION", text))
                    stack.append((n, level, stack[-1][2] + 1))
                else:
                    out.append((document, n, stack[-1][0], stack[-1][2] + 1, "CONTENT", text))
            yield pd.DataFrame(out, columns=["document_id", "node_no", "parent_no", "depth", "node_type", "title"])

    levelled = blocks.select("document_id", "block_no", "block_type", T.heading_level(F.col("text"), F.col("heading_level")).alias("level"), "text")
    return levelled.repartition("document_id").sortWithinPartitions("document_id", "block_no").mapInPandas(run, TREE)


def with_siblings(tree: DataFrame) -> DataFrame:
    w = Window.partitionBy("document_id", "parent_no").orderBy("node_no")
    return tree.withColumns({"prev_no": F.lag("node_no").over(w), "next_no": F.lead("node_no").over(w)})


def sections_with_children(tree: DataFrame) -> DataFrame:
    children = tree.groupBy("document_id", F.col("parent_no").alias("node_no")).agg(F.array_sort(F.collect_list(F.struct(F.col("node_no").alias("child_no"), F.col("title").alias("child_title")))).alias("children"))
    return tree.where("node_type = 'SECTION'").join(children, ["document_id", "node_no"], "left")


def section_fields(tree: DataFrame) -> DataFrame:
    """The fields that a section is searched by: title, path of titles, anchor (number and title) and the text that hangs under it. tree: rows of `structure_tree`."""
    sections = tree.where("node_type = 'SECTION'").select("document_id", "node_no", "parent_no", "title")
    body = tree.where("node_type = 'CONTENT'").groupBy("document_id", F.col("parent_no").alias("node_no")).agg(F.array_sort(F.collect_list(F.struct(F.col("node_no").alias("n"), "title"))).alias("xs"))
    rows = sections.join(body.select("document_id", "node_no", F.array_join(F.col("xs.title"), "\n").alias("content_text")), ["document_id", "node_no"], "left")
    rows = rows.withColumns({"section_path": F.col("title"), "at": F.col("parent_no")})
    above = sections.select("document_id", F.col("node_no").alias("at"), F.col("parent_no").alias("above"), F.col("title").alias("above_title"))
    for _ in range(5):  # titles nest by the six heading levels
        rows = rows.join(above, ["document_id", "at"], "left").withColumns({"section_path": F.concat_ws("/", "above_title", "section_path"), "at": F.coalesce("above", F.lit(0))}).drop("above", "above_title")
    return rows.select("document_id", "node_no", "title", "section_path", F.concat_ws(" ", F.col("node_no").cast("string"), "title").alias("anchor_text"), "content_text")


def subtree_counts(tree: DataFrame) -> DataFrame:
    """Nodes below each top section, by joining level after level (depth is bounded by the heading levels)."""
    top = tree.where("depth = 1").select("document_id", F.col("node_no").alias("top_no"), F.col("node_no").alias("at"))
    found, level = top, top
    for _ in range(6):
        level = level.join(tree.select("document_id", F.col("parent_no").alias("at"), F.col("node_no").alias("below")), ["document_id", "at"]).select("document_id", "top_no", F.col("below").alias("at"))
        found = found.unionByName(level)
    return found.groupBy("document_id", "top_no").count()


_ARROW = {"boolean": pa.bool_(), "int": pa.int32()}


def folded(rows: DataFrame, keys: list[str], order: list[str], column: str, kind: str, start: Callable[[], Callable[[dict], object]]) -> DataFrame:
    """rows with one column more: what a fold over each key's rows in order says of every row.

    start makes a fold: a function that takes a row and keeps what it needs. Rows are sorted within partitions and read as a
    stream of batches, so neither a key's rows nor a partition is held in memory. kind: boolean or int.
    """
    schema = rows.withColumn(column, F.lit(None).cast(kind)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, fold = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if fold is None or key != current:
                    current, fold = key, start()
                out.append(fold(row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, _ARROW[kind])], [*batch.schema.names, column])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
