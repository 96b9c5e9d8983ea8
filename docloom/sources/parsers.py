"""Parsers from files to ordered blocks: plain text, HTML and Markdown, routed by file type."""

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.sources import markdown

BLOCKS = "document_id long, block_no int, block_type string, heading_level int, text string"
#: Numbered headings.
NUMBERED = r"^([一二三四五六七八九十]+、|第[一二三四五六七八九十0-9]+[章节条]|[0-9]+(\.[0-9]+)*[、.])"
TITLE_ENDS = ("章", "节", "：", ":")
TITLE_CHARS = 80
TYPES = {"pdf": "PDF", "docx": "DOCX", "doc": "DOC", "md": "MD", "markdown": "MD", "html": "HTML", "htm": "HTML", "txt": "TXT", "xlsx": "XLSX"}


def file_type(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))), F.lit("UNKNOWN"))


def decoded(content: bytes | None) -> str | None:
    """A file's text: without byte-order mark, as UTF-8, else as GB18030, else byte by byte."""
    if content is None:
        return None
    content = bytes(content).removeprefix(b"\xef\xbb\xbf")
    for coding in ("utf-8", "gb18030"):
        try:
            return content.decode(coding)
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")


def decode(content: Column) -> Column:
    """The text of file contents. Valid UTF-8 is decoded by Spark; only other contents go through Python."""

    @F.pandas_udf("string")
    def by_python(contents: pd.Series) -> pd.Series:
        return contents.map(decoded)

    text = F.try_validate_utf8(content.cast("string"))
    return F.when(text.isNotNull(), F.regexp_replace(text, "^\ufeff", "")).otherwise(by_python(F.when(text.isNull(), content)))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """name, content text. Empty files give no row."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), decode(F.col("content")).alias("content"))


def line_spans(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), char_start, char_end, byte_start of every line, in UTF-8 bytes."""
    lines = F.split("text", "\n")
    one = F.arrays_zip(F.transform(lines, F.char_length).alias("n"), F.transform(lines, F.octet_length).alias("b"))
    rows = docs.select("doc_id", F.posexplode(one).alias("line_no", "x")).select("doc_id", "line_no", F.col("x.n").cast("long").alias("n"), F.col("x.b").cast("long").alias("b"))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0))
    return rows.select("doc_id", "line_no", start.alias("char_start"), (start + F.col("n")).alias("char_end"), F.coalesce(F.sum(F.col("b") + 1).over(before), F.lit(0)).alias("byte_start"))


def block_type(text: Column) -> Column:
    t = T.trimmed(text)
    ends = t.endswith(TITLE_ENDS[0])
    for end in TITLE_ENDS[1:]:
        ends = ends | t.endswith(end)
    return F.when((t != "") & (F.char_length(t) <= TITLE_CHARS) & (t.rlike(NUMBERED) | ends), "TITLE").otherwise("Text")


def parse_text(docs: DataFrame) -> DataFrame:
    """Paragraphs between blank lines; expressions only."""
    parts = F.filter(F.transform(F.split(T.cleaned(F.col("text")), r"\n\s*\n+"), T.trimmed), lambda x: x != "")
    rows = docs.select(F.col("doc_id").alias("document_id"), F.posexplode(parts).alias("pos", "raw"))
    kind = F.when(F.col("raw").rlike(r"^#{1,6}\s+"), "TITLE").otherwise(block_type(F.col("raw")))
    level = F.length(F.regexp_extract("raw", r"^(#{1,6})\s", 1))
    return rows.select("document_id", (F.col("pos") + 1).cast("int").alias("block_no"), kind.alias("block_type"), F.when(level > 0, level).cast("int").alias("heading_level"), F.regexp_replace("raw", r"^#{1,6}\s+", "").alias("text"))


class _Body(HTMLParser):
    """Direct children of body, each with its tag and text."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self, whole: bool = False):
        """whole: the document has no body tag, so all of it is the body."""
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.open: list[str] = []
        self.inside, self.hidden, self.text = whole, 0, []

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self.inside = True
        elif self.inside and tag not in self.VOID:
            if tag == "p" and self.open and self.open[-1] == "p":
                self.handle_endtag("p")
            self.open.append(tag)
            self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag == "body":
            self.close_block()
            self.inside = False
        elif tag in self.open:
            while True:
                last = self.open.pop()
                self.hidden -= last in ("script", "style")
                if not self.open:
                    self.close_block(last)
                if last == tag:
                    break

    def handle_data(self, data):
        if self.inside and not self.hidden:
            self.text.append(data)

    def close_block(self, tag: str = ""):
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((tag, text))
        self.text = []


def html_blocks(page_id: int, html: str | None) -> list[tuple]:
    body = _Body(whole=not re.search("<body[\\s>]", html or "", re.I))
    body.feed(html or "")
    body.close()
    body.close_block(body.open[0] if body.open else "")
    title = lambda tag, t: bool(re.fullmatch("h[1-6]", tag)) or (len(t) <= TITLE_CHARS and bool(re.match(NUMBERED, t) or t.endswith(TITLE_ENDS)))
    return [(page_id, n, "TITLE" if title(tag, t) else "Text", int(tag[1]) if re.fullmatch("h[1-6]", tag) else None, t) for n, (tag, t) in enumerate(body.blocks, 1)]


#: Pages that are parsed before their blocks leave the task.
AT_ONCE = 128


def parse_html(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
            rows = [x for key, html in zip(batch.column(0), batch.column(1), strict=True) for x in html_blocks(key.as_py(), html.as_py())]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string()), strict=True)], ["document_id", "block_no", "block_type", "heading_level", "text"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, BLOCKS)


def parse_markdown(docs: DataFrame) -> DataFrame:
    """Top-level blocks of Markdown documents; `markdown.parse_nodes` has all nodes with their spans."""
    return markdown.blocks_of(markdown.parse_nodes(docs))


def table_cells(blocks: DataFrame) -> DataFrame:
    """document_id, block_no, row_no, column_no, cell, is_header of TABLE blocks; expressions only."""
    rows = blocks.where("block_type = 'TABLE'").select("document_id", "block_no", F.posexplode(F.split("text", "\n")).alias("row_no", "row"))
    cells = rows.select("document_id", "block_no", "row_no", F.posexplode(F.split(F.regexp_replace("row", r"^\s*\||\|\s*$", ""), r"\|")).alias("column_no", "raw"))
    return cells.select("document_id", "block_no", "row_no", "column_no", T.trimmed(F.col("raw")).alias("cell"), (F.col("row_no") == 0).cast("int").alias("is_header"))


#: Parsers by file type; others take the text parser.
PARSERS = {"HTML": parse_html, "MD": parse_markdown, "TXT": parse_text}


def parser_for(kind: str):
    return PARSERS.get(kind.upper(), parse_text)
