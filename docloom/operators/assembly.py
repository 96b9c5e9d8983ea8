"""From blocks to parents and children: rendering, packing, parent and child seeds, strategy pipelines, chunk texts.

Blocks: document_id, block_no, block_id, block_type, text, section_path, canonical_path, page_no, page_range, table_html, image_caption.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import blocks as B
from docloom.operators.chunking import RECURSIVE_MAX, STRATEGIES, recursive_pieces, without_repeats

# What steps do in a strategy.
STRUCTURE = "STRUCTURE"
ROLES = {"RECURSIVE": "FALLBACK", "SEMANTIC": "OPTIMIZE", "LLM": "ENHANCE"}


def rendered() -> Column:
    """A block's content by type: titles with #, tables and images with a mark; the first filled of text, caption and table."""
    filled = T.first_non_blank(F.col("text"), F.col("image_caption"), F.col("table_html"))
    kind, table = F.upper(F.trim("block_type")), F.coalesce("table_html", F.lit(""))
    return (
        F.when(T.is_blank(filled), F.lit(""))
        .when((kind == "TITLE") & ~F.ltrim(filled).startswith("#"), F.concat(F.lit("# "), filled))
        .when((kind == "TABLE") & ~T.is_blank(table) & ~F.contains(filled, table), F.concat(F.lit("[TABLE]\n"), filled, F.lit("\n\n"), table))
        .when(kind.isin("IMAGE", "FIGURE") & ~T.is_blank(F.col("image_caption")), F.concat(F.lit("[IMAGE]\n"), F.col("image_caption")))
        .otherwise(filled)
    )


def parsed_text(blocks: DataFrame) -> DataFrame:
    """document_id, parsed_text: of each block the text, else its table, else its caption."""
    part = T.first_non_blank(T.trimmed(F.col("text")), F.col("table_html"), F.col("image_caption"))
    ordered = F.array_sort(F.collect_list(F.struct("block_no", part.alias("part"))))
    return blocks.groupBy("document_id").agg(T.trimmed(F.array_join(F.filter(F.transform(ordered, lambda x: x["part"]), lambda x: x != ""), "\n\n")).alias("parsed_text"))


def _first(xs: Column) -> Column:
    """The first filled string of an array, trimmed; empty if none is."""
    return F.coalesce(F.get(F.filter(F.transform(xs, T.trimmed), lambda x: x != ""), 0), F.lit(""))


def path_title(path: Column) -> Column:
    """The last filled part of a section path split on > / |."""
    parts = F.filter(F.transform(F.split(path, "[>/|]"), T.trimmed), lambda x: x != "")
    return F.coalesce(F.regexp_replace(F.element_at(F.when(F.size(parts) > 0, parts), -1), "^#+", ""), F.lit(""))


def parents_of(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """One parent for each group of blocks: text, title, type, page range, first section, path and page, block ids in order, bounds and count."""
    row = F.struct(
        "block_no", "block_id", F.upper(F.trim("block_type")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("section_path", F.lit("")).alias("section"),
        F.coalesce("canonical_path", F.lit("")).alias("path"), F.coalesce("page_no", F.lit(0)).alias("page"), F.coalesce("page_range", F.lit("")).alias("range"), T.trimmed(rendered()).alias("content"),
    )
    found = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("xs"))
    get = lambda name: F.transform("xs", lambda x: x[name])
    kinds = F.array_distinct(F.filter(get("kind"), lambda x: x != ""))
    pages = F.filter(get("page"), lambda x: x > 0)
    low, high = F.array_min(pages).cast("string"), F.array_max(pages).cast("string")
    section = _first(get("section"))
    titles = F.transform(F.filter("xs", lambda x: (x["kind"] == "TITLE") & ~T.is_blank(x["text"])), lambda x: F.regexp_replace(T.trimmed(x["text"]), "^#+", ""))
    return found.select(
        *keys,
        F.array_join(F.filter(get("content"), lambda x: x != ""), "\n\n").alias("text"),
        F.coalesce(F.get(titles, 0), path_title(section)).alias("title"),
        F.when(F.size(kinds) == 0, "TEXT").when(F.size(kinds) == 1, F.get(kinds, 0)).otherwise("MIXED").alias("chunk_type"),
        F.when(F.size(pages) == 0, _first(get("range"))).when(low == high, low).otherwise(F.concat_ws("-", low, high)).alias("page_range"),
        F.coalesce(F.get(pages, 0), F.lit(0)).alias("page_no"),
        section.alias("section_path"),
        _first(get("path")).alias("canonical_path"),
        F.array_distinct(F.filter(get("block_id"), lambda x: x > 0)).alias("block_ids"),
        F.size("xs").alias("block_count"),
        F.get("xs", 0)["block_no"].alias("first_block"),
        F.element_at("xs", -1)["block_no"].alias("last_block"),
    )


def packed(blocks: DataFrame, limit: int = RECURSIVE_MAX) -> DataFrame:
    """blocks with run_no. Greedy windows of each run: document_id, run_no, block_no, window_no, oversize.

    A run whose joined text fits is one window; else blocks fill a window up to limit characters (2 for each
    separator). A block longer than limit is a window of its own, to be split. Blocks without content are left out.
    """
    sizes = blocks.select("document_id", "run_no", "block_no", F.char_length(T.trimmed(rendered())).alias("size")).where("size > 0")
    rows = sizes.withColumn("total", F.sum(F.col("size") + 2).over(Window.partitionBy("document_id", "run_no")) - 2)

    def start():
        window, used = -1, None

        def step(row: dict) -> int:
            nonlocal window, used
            size = row["size"]
            if row["total"] <= limit:
                return 0
            opens = used is None or size > limit or used + size + 2 > limit
            window += opens
            used = None if size > limit else size + 2 if opens else used + size + 2
            return window

        return step

    found = B.folded(rows, ["document_id", "run_no"], ["block_no"], "window_no", "int", start)
    return found.select("document_id", "run_no", "block_no", "window_no", (F.col("size") > limit).alias("oversize"))


def with_runs(blocks: DataFrame, by_section: bool) -> DataFrame:
    """Adds run_no: consecutive blocks of one section, or all of a document."""
    if not by_section:
        return blocks.withColumn("run_no", F.lit(1).cast("long"))
    return B.section_runs(blocks.withColumn("__section", T.trimmed(F.coalesce("section_path", F.lit("")))), "document_id", ["block_no"], "__section").drop("__section")


def parent_seeds(blocks: DataFrame, steps: list[str], limit: int = RECURSIVE_MAX) -> DataFrame:
    """Parents of documents by the steps of a strategy: by section where STRUCTURE is one of them, else by window; the other steps follow as a pipeline."""
    by_section = STRUCTURE in steps
    rows = with_runs(blocks, by_section)
    placed = rows.join(packed(rows, limit), ["document_id", "run_no", "block_no"])
    whole = parents_of(placed.where("not oversize"), ["document_id", "run_no", "window_no"])
    large = parents_of(placed.where("oversize"), ["document_id", "run_no", "window_no"])
    pieces = _mapped(large, lambda x: recursive_pieces(x, limit, 0))
    seeds = whole.withColumn("piece_no", F.lit(0)).unionByName(pieces)
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("first_block", "piece_no"))
    seeds = seeds.withColumn("position", order).withColumn("item_index", F.lit(None).cast("int"))
    rest = [s for s in steps if s != (STRUCTURE if by_section else "RECURSIVE")]
    return run_pipeline(seeds, rest) if rest else seeds


def _mapped(rows: DataFrame, pieces) -> DataFrame:
    """Each row once for every piece of its text, numbered in piece_no; blank texts give none."""
    schema = rows.drop("piece_no").withColumn("piece_no", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in batch.column(batch.schema.get_field_index("text"))]
            cut = [pieces(t) if t and t.strip() else [] for t in texts]
            rest = batch.take(pa.array(np.repeat(np.arange(len(cut)), [len(c) for c in cut])))
            columns = {name: rest.column(i) for i, name in enumerate(rest.schema.names)}
            columns |= {"text": pa.array([p for c in cut for p in c], pa.string()), "piece_no": pa.array([i for c in cut for i in range(len(c))], pa.int32())}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], [f.name for f in schema])

    return rows.mapInArrow(run, schema)


def run_pipeline(candidates: DataFrame, steps: list[str]) -> DataFrame:
    """Every step maps each candidate (section_path, item_index, text, position) to pieces, which keep the candidate's other fields; repeats go after every step.

    Structure and unknown steps are skipped.
    """
    rows = without_repeats(candidates.where(~T.is_blank(F.col("text"))))
    for step in steps:
        pieces = STRATEGIES.get(step.lower())
        if pieces is None or step == STRUCTURE:
            continue
        cut = _mapped(rows, pieces)
        order = F.row_number().over(Window.partitionBy("document_id").orderBy("position", "piece_no"))
        rows = without_repeats(cut.withColumn("position", order))
    return rows


def child_seeds(parents: DataFrame, blocks: DataFrame) -> DataFrame:
    """parents: document_id, parent_no, block_ids, text, section_path, canonical_path. The blocks of each parent in the order of its ids.

    Children inherit blank section and canonical paths; a parent without known blocks is its own only child.
    """
    ids = parents.select("document_id", "parent_no", F.col("section_path").alias("parent_section"), F.col("canonical_path").alias("parent_path"), F.posexplode("block_ids").alias("child_no", "block_id"))
    known = blocks.select("block_id", T.trimmed(rendered()).alias("text"), "section_path", "canonical_path")
    found = ids.join(known, "block_id").select(
        "document_id", "parent_no", "child_no", "block_id", "text", T.first_non_blank(F.col("section_path"), F.col("parent_section")).alias("section_path"), T.first_non_blank(F.col("canonical_path"), F.col("parent_path")).alias("canonical_path")
    )
    own = parents.join(found.select("document_id", "parent_no").distinct(), ["document_id", "parent_no"], "left_anti")
    own = own.select("document_id", "parent_no", F.lit(0).alias("child_no"), F.lit(0).cast("long").alias("block_id"), T.trimmed(F.col("text")).alias("text"), "section_path", "canonical_path")
    return found.unionByName(own)


def with_valid_children(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Parents that have a child with text."""
    return parents.join(children.where(~T.is_blank(F.col("text"))).select("document_id", "parent_no").distinct(), ["document_id", "parent_no"], "left_semi")


def nodes_of(parents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds node_no: the first node (by number) of the document with the canonical path, or with the section path as its path or title."""
    n = nodes.select(F.col("document_id").alias("node_document"), "node_no", F.trim("canonical_path").alias("node_path"), F.trim("section_path").alias("node_section"), F.trim("title").alias("node_title"))
    keys = parents.select("document_id", "parent_no", F.trim("canonical_path").alias("path"), F.trim("section_path").alias("section"))
    # three equi-joins instead of one join over OR
    by = lambda left, right: keys.where(F.col(left) != "").join(n, (F.col("document_id") == F.col("node_document")) & (F.col(left) == F.col(right))).select("document_id", "parent_no", "node_no")
    hits = by("path", "node_path").unionByName(by("section", "node_section")).unionByName(by("section", "node_title"))
    return parents.join(hits.groupBy("document_id", "parent_no").agg(F.min("node_no").alias("node_no")), ["document_id", "parent_no"], "left")


def weighted_content(rows: DataFrame) -> DataFrame:
    """Adds weighted: labelled sections of a chunk (title, section_path, chunk_type, keywords, questions, text, weighted_body). The labels."""
    listed = lambda c: F.array_join(F.filter(F.col(c), lambda x: ~T.is_blank(x)), ";")
    parts = [("[TITLE]", T.trimmed(F.col("title"))), ("[SECTION]", T.trimmed(F.col("section_path"))), ("[CHUNK_TYPE]", T.trimmed(F.col("chunk_type"))),
             ("[KEYWORDS]", listed("keywords")), ("[QUESTIONS]", listed("questions")), ("[CONTENT]", T.first_non_blank(T.trimmed(F.col("weighted_body")), T.trimmed(F.col("text"))))]
    filled = F.array_compact(F.array(*[F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"{label}\n"), x)) for label, x in parts]))
    return rows.withColumn("weighted", F.array_join(filled, "\n\n"))


def step_roles(steps: DataFrame) -> DataFrame:
    """steps: plan_id, pipeline, step_no, strategy. Adds role: the first of a pipeline is PRIMARY, others by strategy."""
    first = F.row_number().over(Window.partitionBy("plan_id", "pipeline").orderBy("step_no")) == 1
    by_strategy = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return steps.withColumn("role", F.when(first, "PRIMARY").otherwise(F.coalesce(by_strategy[F.col("strategy")], F.lit("OPTIMIZE"))))


def same_steps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Of plans in both: plan_id and whether their (pipeline, strategy) steps are the same multiset."""
    counts = lambda rows, name: rows.groupBy("plan_id", "pipeline", "strategy").agg(F.count("*").alias(name))
    both = counts(left, "n").join(counts(right, "m"), ["plan_id", "pipeline", "strategy"], "full")
    same = both.groupBy("plan_id").agg(F.bool_and(F.coalesce("n", F.lit(0)) == F.coalesce("m", F.lit(0))).alias("same"))
    return same.join(left.select("plan_id").distinct(), "plan_id", "left_semi").join(right.select("plan_id").distinct(), "plan_id", "left_semi")


def steps_of(steps: DataFrame, pipeline: str, without: str | None = None) -> DataFrame:
    """Each plan's steps of a pipeline in order, blank pipelines counting as CHILD, without one strategy: plan_id, strategies, has_structure."""
    rows = steps.where(F.upper(T.first_non_blank(F.col("pipeline"), F.lit("CHILD"))) == pipeline.upper())
    has = F.max((F.col("strategy") == STRUCTURE).cast("int"))
    xs = F.filter(F.array_sort(F.collect_list(F.struct("step_no", "strategy"))), lambda x: x["strategy"] != F.lit(without or ""))
    return rows.groupBy("plan_id").agg(F.transform(xs, lambda x: x["strategy"]).alias("strategies"), has.alias("has_structure"))
