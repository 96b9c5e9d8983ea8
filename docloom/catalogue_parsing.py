"""Queries of the Markdown parser and of word segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.catalogue import query, t
from docloom.functions import segmentation
from docloom.sources import index, markdown

BLANKS = r"[ \t\n\f\r\v]"


@query(r"select doc_id, length(regexp_replace(text, '[ \t\n\f\r\v]', '', 'g')) as characters from documents where regexp_matches(text, '[^ \t\n\f\r\v]')")
def markdown_coverage(spark, d):
    """Characters of each document within the spans of its top-level nodes, blanks aside: spans overlap nowhere and leave nothing out."""
    docs = t(spark, d, "documents").select("doc_id", "text")
    top = markdown.parse_nodes(docs).where("parent_no = 0").select(F.col("document_id").alias("doc_id"), "char_start", "char_end")
    spans = top.groupBy("doc_id").agg(F.collect_list(F.struct("char_start", "char_end")).alias("spans"))
    cut = F.transform("spans", lambda x: F.char_length(F.regexp_replace(F.substring(F.col("text"), x["char_start"].cast("int") + 1, (x["char_end"] - x["char_start"]).cast("int")), BLANKS, "")))
    return docs.join(spans, "doc_id").select("doc_id", F.aggregate(cut, F.lit(0).cast("long"), lambda a, n: a + n).alias("characters"))


def turn_tables(spark, d):
    """Each conversation as a Markdown table of its turns, below a heading."""
    cell = F.replace(F.regexp_replace("text", r"\s+", " "), F.lit("|"), F.lit("\\|"))
    row = F.concat(F.lit("| "), F.col("turn").cast("string"), F.lit(" | "), "role", F.lit(" | "), cell, F.lit(" |"))
    rows = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", row.alias("row")))).alias("rows"))
    text = F.concat(F.lit("# Turns\n\n| turn | role | text |\n|--:|:-:|---|\n"), F.array_join(F.col("rows.row"), "\n"))
    return rows.select(F.col("conv_id").alias("doc_id"), text.alias("text"))


@query(
    r"""with x as (select conv_id, turn, role, replace(regexp_replace(text, '\s+', ' ', 'g'), '|', '\|') as text, row_number() over (partition by conv_id order by turn) as row_no from conversations),
 c as (select conv_id, row_no, 0 as column_no, turn::varchar as cell from x union all select conv_id, row_no, 1, role from x union all select conv_id, row_no, 2, trim(text) from x
   union all select conv_id, 0, u.column_no, u.cell from (select distinct conv_id from x), (values (0, 'turn'), (1, 'role'), (2, 'text')) u(column_no, cell))
 select conv_id as document_id, row_no::int as row_no, column_no::int as column_no, row_no = 0 as is_header, ['RIGHT', 'CENTER', 'NONE'][column_no + 1] as alignment, cell, true as cut from c"""
)
def markdown_cells(spark, d):
    """Every cell of the turns' tables; cut says whether its span cuts it out of the source."""
    docs = turn_tables(spark, d)
    cells = markdown.cells_with_spans(markdown.parse_nodes(docs)).join(docs.withColumnRenamed("doc_id", "document_id").withColumnRenamed("text", "source"), "document_id")
    cut = F.substring(F.col("source"), F.col("char_start").cast("int") + 1, (F.col("char_end") - F.col("char_start")).cast("int")) == F.col("text")
    return cells.select("document_id", "row_no", "column_no", "is_header", "alignment", F.col("text").alias("cell"), cut.alias("cut"))


@query(None)
def word_segments(spark, d):
    """Compounds of all documents cut by a model of the same documents: words, and those among them that the dictionary lacks."""
    docs = t(spark, d, "documents").select("doc_id", "text")

    def build(folder):
        model = segmentation.learned(docs, "text", runs=segmentation.LETTERS)
        segmentation.segmented(docs, "text", model, segmentation.LETTERS).drop("text").write.parquet(folder)

    tokens = spark.read.parquet(index.stored(spark, "segments", f"{d}/documents.parquet", build))
    return tokens.select("doc_id", F.size("tokens").alias("words"), F.size(F.array_distinct("tokens")).alias("distinct_words"), F.sha2(F.array_join("tokens", "/"), 256).alias("words_sha256"))
