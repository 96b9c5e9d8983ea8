"""Chunkers: fixed windows, overlap prefixes, recursive and semantic splitting, parents and children."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

# Default sizes in characters.
RECURSIVE_MAX, RECURSIVE_OVERLAP = 800, 120
SEMANTIC_MAX, SEMANTIC_MIN, SEMANTIC_THRESHOLD = 700, 240, 0.18
MARKS = "。！？!?;；."
PATH_PARTS = r"[/\\.]"
#: Texts that are cut before their pieces leave the task.
AT_ONCE = 128


def fixed_windows(docs: DataFrame, size: int = 400, overlap: int = 40) -> DataFrame:
    """doc_id, chunk_no (from 0), chunk_text: windows of size characters, one every max(1, size - overlap)."""
    step = max(1, size - overlap)
    length = F.char_length("text")
    last = F.greatest(F.lit(0), F.floor((length - overlap - 1) / step)) if size > overlap else F.greatest(F.lit(0), length - size)
    numbers = F.sequence(F.lit(0), last.cast("int"))
    rows = docs.where(F.char_length("text") > 0).select("doc_id", "text", F.explode(numbers).alias("chunk_no"))
    return rows.select("doc_id", "chunk_no", F.expr(f"substring(text, chunk_no * {step} + 1, {size})").alias("chunk_text"))


def overlap_prefixes(chunks: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Adds the tail of the previous chunk, at most min(overlap, limit - length - 1) characters, and the joined text."""
    previous = F.lag("chunk_text").over(Window.partitionBy("doc_id").orderBy("chunk_no"))
    n = F.greatest(F.lit(0), F.least(F.lit(overlap), F.lit(limit) - F.char_length("chunk_text") - 1))
    with_previous = chunks.withColumn("previous", previous).withColumn("n", n)
    prefix = F.coalesce(F.expr("case when n > 0 then right(previous, n) else '' end"), F.lit(""))
    return with_previous.withColumn("prefix", prefix).select(
        "doc_id", "chunk_no", "prefix", F.when(F.col("prefix") == "", F.col("chunk_text")).otherwise(F.concat_ws("\n", "prefix", "chunk_text")).alias("chunk_text")
    )


def split_sentences(x: str) -> list[str]:
    return [s for s in (p.strip() for p in re.split(f"(?<=[{MARKS}])", x)) if s]


def _windows(x: str, limit: int, overlap: int) -> list[str]:
    out, step = [], max(1, limit - overlap)
    for at in range(0, len(x), step):
        out.append(x[at : at + limit])
        if at + limit >= len(x):
            break
    return out


def recursive_pieces(x: str, limit: int, overlap: int, level: int = 0) -> list[str]:
    """Whole if short enough; else packed paragraphs, lines, sentences, at last fixed windows. Every packed list gets its overlaps."""
    x = x.strip()
    if len(x) <= limit:
        return [x] if x else []
    splitters = (lambda t: re.split(r"\n\s*\n+", t), lambda t: t.split("\n"), split_sentences)
    for deeper in range(level, len(splitters)):
        parts = [p for p in (s.strip() for s in splitters[deeper](x)) if p]
        if len(parts) > 1:
            break
    else:
        return _windows(x, limit, overlap)
    out, packed = [], ""
    for part in parts:
        if packed and len(packed) + 1 + len(part) > limit:
            out.append(packed)
            packed = ""
        if len(part) > limit:
            out += [packed] * bool(packed) + recursive_pieces(part, limit, overlap, deeper + 1)
            packed = ""
        else:
            packed = f"{packed}\n{part}" if packed else part
    return with_overlap(out + [packed] * bool(packed), limit, overlap)


def with_overlap(pieces: list[str], limit: int, overlap: int) -> list[str]:
    """Each piece after the first with the tail of the one before it, at most min(overlap, limit - length - 1) characters, on a line of its own."""
    out = pieces[:1]
    for before, piece in zip(pieces, pieces[1:], strict=False):
        n = min(overlap, limit - len(piece) - 1)
        tail = before[-n:].strip() if n > 0 else ""
        out.append(f"{tail}\n{piece}" if tail else piece)
    return out


def semantic_pieces(x: str, limit: int = SEMANTIC_MAX, least: int = SEMANTIC_MIN, threshold: float = SEMANTIC_THRESHOLD) -> list[str]:
    """Sentences folded into chunks, cut where the chunk is full or the next sentence has little in common with it."""
    parts = split_sentences(x)
    if len(x.strip()) <= least or len(parts) <= 1:
        return [x.strip()] if x.strip() else []
    tokens = lambda t: set(re.findall(r"[a-z0-9]{2,}|[一-鿿]", t.lower()))
    out, now, have = [], parts[0], tokens(parts[0])
    for part in parts[1:]:
        new = tokens(part)
        alike = len(have & new) / len(have | new) if have and new else 0.0
        if len(now) + len(part) > limit or (len(now) >= least and alike < threshold):
            out.append(now)
            now, have = part, new
        else:
            now, have = f"{now} {part}", have | new
    return [*out, now]


#: Strategies by name; a new one is a function from text to pieces.
STRATEGIES = {
    "recursive": lambda x: recursive_pieces(x, RECURSIVE_MAX, RECURSIVE_OVERLAP),
    "semantic": semantic_pieces,
}


def chunk_by(docs: DataFrame, strategy: str) -> DataFrame:
    """doc_id, chunk_no, chunk_text by a named strategy; a sequential fold for each document, in Arrow batches."""
    pieces = STRATEGIES[strategy]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
            cut = [pieces(t) if (t := x.as_py()) else [] for x in batch.column(1)]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(cut)), [len(c) for c in cut])))
            yield pa.RecordBatch.from_arrays([ids, pa.array([i for c in cut for i in range(len(c))], pa.int32()), pa.array([p for c in cut for p in c], pa.string())], ["doc_id", "chunk_no", "chunk_text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, chunk_no int, chunk_text string")


def parents_and_children(chunks: DataFrame, group: int = 4) -> DataFrame:
    """Numbers child chunks in parents of `group` children: child count, first and last chunk number, parent text."""
    numbered = chunks.withColumn("parent_no", F.floor(F.col("chunk_no") / group).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "chunk_text")))
    return numbered.groupBy("doc_id", "parent_no").agg(
        F.count("*").alias("child_count"), F.min("chunk_no").alias("start_chunk_no"), F.max("chunk_no").alias("end_chunk_no"), F.array_join(F.transform(ordered, lambda x: x["chunk_text"]), "\n\n").alias("parent_text")
    )


def without_repeats(candidates: DataFrame) -> DataFrame:
    """The first of a document's candidates equal in path, item index and text, in order of position."""
    keys = Window.partitionBy("document_id", "section_path", "item_index", "text").orderBy("position")
    return candidates.withColumn("n", F.row_number().over(keys)).where("n = 1").drop("n")


def keyword_seed(rows: DataFrame, limit: int = 12) -> DataFrame:
    """Adds keywords: title, parts of the section path and tokens, two bytes or more, distinct, the first `limit`."""
    parts = F.split("section_path", PATH_PARTS)
    latin = F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z0-9]+"), F.lit(0))
    every = F.transform(F.concat(F.array("title"), parts, latin), T.trimmed)
    return rows.withColumn("keywords", F.slice(F.array_distinct(F.filter(every, lambda x: F.octet_length(x) >= 2)), 1, limit))


def question_seed(rows: DataFrame) -> DataFrame:
    """rows: title, keywords, chunk_type. Adds questions: two by topic (the title, else the first keyword), one more for a table or an image. The phrases."""
    topic = F.when(~T.is_blank(F.col("title")), T.trimmed(F.col("title"))).otherwise(F.coalesce(F.get("keywords", 0), F.lit("")))
    kind = F.upper(F.coalesce("chunk_type", F.lit("")))
    every = F.array(
        F.when(topic != "", F.concat(F.lit("关于"), topic, F.lit("的核心内容是什么？"))),
        F.when(topic != "", F.concat(topic, F.lit("有哪些要求或注意事项？"))),
        F.when(kind == "TABLE", F.lit("这个表格说明了什么？")).when(kind.isin("IMAGE", "FIGURE"), F.lit("这张图片说明了什么？")),
    )
    return rows.withColumn("questions", F.slice(F.array_distinct(F.array_compact(every)), 1, 4))


def recommend_strategy(stats: DataFrame, recursive_max: int = RECURSIVE_MAX, semantic_min: int = SEMANTIC_MIN) -> DataFrame:
    """stats: char_count, paragraph_count, heading_count, max_paragraph, structure_level, quality_level. Adds flags and the snapshot."""
    flags = stats.withColumns(
        {
            "use_structure": (F.col("structure_level") >= 2) | (F.col("heading_count") >= 2),
            "use_recursive": (F.col("char_count") >= recursive_max) | (F.col("max_paragraph") > recursive_max),
            "use_semantic": (F.col("char_count") >= semantic_min) & (F.col("paragraph_count") >= 3) & (F.col("quality_level") >= 2),
        }
    )
    parent = F.when(F.col("use_structure"), "STRUCTURE").otherwise("RECURSIVE")
    child = F.array_compact(F.array(F.when(F.col("use_semantic"), F.lit("SEMANTIC")), F.when(F.col("use_recursive") | ~F.col("use_semantic"), F.lit("RECURSIVE"))))
    return flags.withColumn("snapshot", F.concat(F.lit("PARENT:"), parent, F.lit(";CHILD:"), F.array_join(child, ">")))
