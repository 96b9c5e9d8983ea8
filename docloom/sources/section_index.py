"""Sections found by what they contain: fields with weights, and postings of character n-grams, so a question reads few sections.

A question scores a section 90 where the title holds it, 70 for the path, 60 for the anchor, 30 for the body, and 25 more
where one of the first three holds its hint; below FLOOR nothing is found. Every distinct gram of GRAM characters of a
section's fields is a posting. A question takes the gram of it that the fewest sections of its document have: all sections
that contain the question are among those, and only they are compared. Questions shorter than a gram meet all sections of
their document. Postings are written in the order of their sections, without a sort, and read once in a search: they stream
past the asked grams, and sections past their candidates, so a task holds what its questions need and no postings or texts.

Defined results: texts are compared lower-cased and trimmed; blank fields contain nothing; a blank question is in every
filled field if there is a hint, and finds nothing otherwise; the first section wins ties; a document without a section
that reaches the floor gives no row.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.sources.index import once

GRAM = 3
# Fields with their weights, what a hint adds and the least score.
FIELDS = {"title": 90, "section_path": 70, "anchor_text": 60, "content_text": 30}
HINTED, HINT, FLOOR = ("title", "section_path", "anchor_text"), 25, 30
SECTIONS = "document_id long, node_no int, title string, section_path string, anchor_text string, content_text string"


class SectionIndex(NamedTuple):
    """sections: SECTIONS, lower-cased. postings: document_id, gram, node_no, of all fields together."""

    sections: DataFrame
    postings: DataFrame


def grams(*texts: Column, size: int = GRAM) -> Column:
    """The distinct runs of `size` characters of texts."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(x, F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1)) for x in texts])))


def write_section_index(sections: DataFrame, folder: str) -> None:
    folded = sections.select(F.col("document_id").cast("long").alias("document_id"), F.col("node_no").cast("int").alias("node_no"), *[F.lower(F.coalesce(f, F.lit(""))).alias(f) for f in FIELDS])
    folded.sortWithinPartitions("document_id", "node_no").write.parquet(f"{folder}/sections")
    stored = folded.sparkSession.read.schema(SECTIONS).parquet(f"{folder}/sections")
    stored.select("document_id", "node_no", F.explode(grams(*map(F.col, FIELDS))).alias("gram")).write.parquet(f"{folder}/postings")


def read_section_index(spark: SparkSession, folder: str) -> SectionIndex:
    return SectionIndex(spark.read.schema(SECTIONS).parquet(f"{folder}/sections"), spark.read.parquet(f"{folder}/postings"))


def candidates(index: SectionIndex, asked: DataFrame) -> DataFrame:
    """question_id, document_id, node_no: the sections that have the question's rarest gram. asked: questions with text in `q`."""
    probes = asked.select("question_id", "document_id", F.explode(grams(F.col("q"))).alias("gram"))
    hits = index.postings.join(probes.hint("shuffle_hash"), ["document_id", "gram"]).repartition("question_id", "document_id")
    question = Window.partitionBy("question_id", "document_id")
    counted = hits.withColumn("n", F.count("*").over(Window.partitionBy("question_id", "document_id", "gram")))
    rarest = counted.withColumn("x", F.min(F.struct("n", "gram")).over(question)).where(F.col("gram") == F.col("x.gram"))
    return rarest.select("question_id", "document_id", "node_no")


def best_sections(index: SectionIndex, questions: DataFrame) -> DataFrame:
    """questions: question_id, document_id, question, hint. question_id, document_id, node_no, score of the section that fits best."""
    folded = lambda c: F.lower(T.trimmed(F.coalesce(c, F.lit(""))))
    asked = once(questions.select("question_id", F.col("document_id").cast("long").alias("document_id"), folded("question").alias("q"), folded("hint").alias("h")))
    short = F.char_length("q") < GRAM
    some = candidates(index, asked.where(~short))
    others = asked.where(short & ((F.col("q") != "") | (F.col("h") != ""))).select("question_id", "document_id")
    whole = index.sections.select("document_id", "node_no").join(others.hint("shuffle_hash"), "document_id").select("question_id", "document_id", "node_no")
    met = some.unionByName(whole).join(asked, ["question_id", "document_id"])
    rows = index.sections.join(met.hint("shuffle_hash"), ["document_id", "node_no"])
    filled = lambda f: ~T.is_blank(F.col(f))
    score = sum((F.when(filled(f) & F.contains(F.col(f), F.col("q")), weight).otherwise(0) for f, weight in FIELDS.items()), F.lit(0))
    hint = F.lit(False)
    for f in HINTED:
        hint = hint | F.contains(F.col(f), F.col("h"))
    score = score + F.when((F.col("h") != "") & hint, HINT).otherwise(0)
    scored = rows.withColumn("score", score).where(F.col("score") >= FLOOR)
    best = scored.groupBy("question_id", "document_id").agg(F.max(F.struct(F.col("score"), (-F.col("node_no")).alias("last"))).alias("x"))
    return best.select("question_id", "document_id", (-F.col("x.last")).alias("node_no"), F.col("x.score").alias("score"))
