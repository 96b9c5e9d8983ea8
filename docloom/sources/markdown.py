"""Markdown by container blocks: quotes, lists and items stand open on a stack, lines go to the innermost block that takes them.

Every line first meets the open containers: a quote wants its mark, an item its indentation. What is left of the line may
open new blocks; a line that opens none but doesn't meet all containers still goes on with an open paragraph (lazy
continuation). Every node keeps where it stands: lines, characters, UTF-8 bytes, and the parts of the source that its
text was cut from, so text always equals those parts joined by line breaks. Tables give a node for each row and cell.

Defined results: null and blank texts have no nodes; lines may end with CR LF; more than MAX_DEPTH open containers are
taken as text; cells that a row lacks are empty, cells beyond the header's are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 100
QUOTE, ITEM, ORDERED, UNORDERED = "BLOCKQUOTE", "LIST_ITEM", "ORDERED_LIST", "UNORDERED_LIST"
PARAGRAPH, HEADING, CODE, HTML, BREAK, TABLE, ROW, CELL, DEFINITION = "PARAGRAPH", "HEADING", "CODE_BLOCK", "HTML_BLOCK", "THEMATIC_BREAK", "TABLE", "TABLE_ROW", "TABLE_CELL", "LINK_DEFINITION"
CONTAINERS = (QUOTE, ITEM, ORDERED, UNORDERED)
#: Block types of top-level nodes; others are Text.
BLOCK_TYPES = {HEADING: "TITLE", ORDERED: "LIST", UNORDERED: "LIST", TABLE: "TABLE", CODE: "CODE", QUOTE: "BLOCKQUOTE", BREAK: "THEMATIC_BREAK", HTML: "HTML"}

# The patterns and tag names of CommonMark and its table extension.
ATX = re.compile(r"(#{1,6})(?:[ \t]+|$)")
FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
SETEXT = re.compile(r"(=+|-+)[ \t]*$")
RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
MARKER = re.compile(r"([-+*])(?=[ \t]|$)|(\d{1,9})([.)])(?=[ \t]|$)")
DELIMITERS = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
LINK = re.compile(r"\[(?!\s*\])((?:[^\[\]\\]|\\.)+)\]:[ \t]*(<[^<>]*>|[^\s<]\S*)(?:[ \t]+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*$")
TAGS = "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
ATTRIBUTE = r"(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)"
#: (start, end) of HTML blocks; None ends at a blank line. The last can't interrupt a paragraph.
HTML_BLOCKS = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{'|'.join(TAGS.split())})(?:\s|/?>|$)", re.I), None),
    (re.compile(rf"(?:<[A-Za-z][A-Za-z0-9-]*{ATTRIBUTE}*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)[ \t]*$"), None),
]

NODES = (
    "document_id long, node_no int, parent_no int, node_type string, block_no int, level int, marker string, ordinal int, is_header boolean, alignment string, row_no int, column_no int, info string, "
    "start_line int, end_line int, char_start long, char_end long, byte_start long, byte_end long, text string, parts array<struct<start:bigint,end:bigint>>"
)


class Node:
    """A block: its place in the source and what it is. parts: the source ranges of its text, one for each line."""

    def __init__(self, kind: str, parent: Node | None, start: int, line: int):
        self.kind, self.parent, self.start, self.line = kind, parent, start, line
        self.end, self.last_line, self.parts = start, line, []
        self.level = self.ordinal = self.row = self.column = None
        self.marker, self.info, self.alignment, self.header = None, None, None, False
        self.offset, self.filled, self.closing = 0, False, None  # columns of an item's content; whether it has any; what ends a fence or HTML block


class Cursor:
    """A place in a line, in characters and in columns (tabs stop at multiples of four)."""

    def __init__(self, text: str, begin: int, end: int):
        self.text, self.at, self.end, self.column, self.owed = text, begin, end, 0, 0

    def indent(self) -> int:
        column, at = self.column, self.at
        width = self.owed
        while at < self.end and self.text[at] in " \t":
            step = 4 - column % 4 if self.text[at] == "\t" else 1
            width, column, at = width + step, column + step, at + 1
        return width

    def eat(self, columns: int) -> None:
        """Passes blanks of so many columns; what a tab has more stays owed."""
        taken = min(self.owed, columns)
        self.owed, columns = self.owed - taken, columns - taken
        while columns > 0 and self.at < self.end and self.text[self.at] in " \t":
            step = 4 - self.column % 4 if self.text[self.at] == "\t" else 1
            self.at, self.column = self.at + 1, self.column + step
            self.owed, columns = max(0, step - columns), columns - step

    def skip(self, characters: int) -> None:
        self.at, self.column = self.at + characters, self.column + characters

    def eat_blanks(self) -> None:
        self.eat(self.indent())

    def blank(self) -> bool:
        return not self.text[self.at : self.end].strip(" \t")

    def match(self, pattern: re.Pattern) -> re.Match | None:
        return pattern.match(self.text, self.at, self.end)


def cells_of(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The ranges of a row's cells: cut at bars that no backslash stands before, trimmed."""
    while start < end and text[start] in " \t":
        start += 1
    while end > start and text[end - 1] in " \t":
        end -= 1
    cuts, escaped = [], False
    for i in range(start, end):
        if text[i] == "|" and not escaped:
            cuts.append(i)
        escaped = text[i] == "\\" and not escaped
    edges = [start - 1, *cuts, end]
    ranges = [(a + 1, b) for a, b in zip(edges, edges[1:], strict=False)]
    if cuts and cuts[0] == start:
        ranges = ranges[1:]
    if cuts and cuts[-1] == end - 1 and len(ranges) > (0 if cuts[0] == start and len(cuts) == 1 else 1):
        ranges = ranges[:-1]
    out = []
    for a, b in ranges:
        while a < b and text[a] in " \t":
            a += 1
        while b > a and text[b - 1] in " \t":
            b -= 1
        out.append((a, b))
    return out


class Parser:
    """Builds the nodes of one text, in the order in which they begin."""

    def __init__(self, text: str):
        self.text, self.nodes = text, []
        self.open: list[Node] = []
        self.leaf: Node | None = None
        at, self.number = 0, 0
        for self.number, line in enumerate(text.split("\n"), 1):
            self.line(at, at + len(line) - line.endswith("\r"))
            at += len(line) + 1
        self.close_to(0)
        self.end_leaf()

    # building

    def add(self, kind: str, start: int) -> Node:
        node = Node(kind, self.open[-1] if self.open else None, start, self.number)
        self.nodes.append(node)
        return node

    def put(self, node: Node, start: int, end: int) -> None:
        node.parts.append((start, end))
        self.extend(node, end)

    def extend(self, node: Node | None, end: int) -> None:
        while node is not None and (node.end < end or node.last_line < self.number):
            node.end, node.last_line = max(node.end, end), self.number
            node = node.parent

    def begin(self, kind: str, start: int) -> Node:
        """A new leaf; lists hold items only, so an open list ends first."""
        self.end_leaf()
        if self.open and self.open[-1].kind in (ORDERED, UNORDERED):
            self.open.pop()
        for node in self.open:
            node.filled = True
        self.leaf = self.add(kind, start)
        return self.leaf

    def close_to(self, depth: int) -> None:
        if len(self.open) > depth:
            self.end_leaf()
            del self.open[depth:]

    def end_leaf(self) -> None:
        leaf, self.leaf = self.leaf, None
        if leaf is None:
            return
        if leaf.kind == PARAGRAPH:
            self.take_definitions(leaf)
        elif leaf.kind == CODE and leaf.closing is None:
            while leaf.parts and not self.text[leaf.parts[-1][0] : leaf.parts[-1][1]].strip():
                leaf.parts.pop()

    def take_definitions(self, leaf: Node) -> None:
        """Lines at a paragraph's start that define links become nodes of their own."""
        at = self.nodes.index(leaf, max(0, len(self.nodes) - 1 - len(leaf.parts)))
        found = []
        while leaf.parts and (m := LINK.match(self.text[slice(*leaf.parts[0])])):
            start, end = leaf.parts.pop(0)
            node = Node(DEFINITION, leaf.parent, start, leaf.line + len(found))
            node.parts, node.end, node.last_line, node.marker, node.info = [(start, end)], end, node.line, m[1], m[2]
            found.append(node)
        if found:
            if leaf.parts:
                leaf.start, leaf.line = leaf.parts[0][0], leaf.line + len(found)
            self.nodes[at : at + 1] = found + ([leaf] if leaf.parts else [])

    # lines

    def line(self, begin: int, end: int) -> None:
        cur = Cursor(self.text, begin, end)
        matched = 0
        for node in self.open:
            if node.kind == QUOTE:
                if cur.blank() or cur.indent() > 3:
                    break
                probe = cur.indent()
                if self.text[cur.at + self.blanks(cur)] != ">":
                    break
                cur.eat(probe)
                cur.skip(1)
                cur.eat(1)
            elif node.kind == ITEM:
                if cur.blank():
                    if not node.filled and self.number > node.line:
                        break
                elif cur.indent() >= node.offset:
                    cur.eat(node.offset)
                else:
                    break
            matched += 1
        whole = matched == len(self.open)
        if whole and self.leaf is not None and self.leaf.kind == CODE and self.leaf.closing:
            return self.in_fence(cur)
        if whole and self.leaf is not None and self.leaf.kind == HTML:
            return self.in_html(cur)
        if cur.blank():
            return self.blank_line(cur, matched)
        cur, matched = self.start_blocks(cur, matched)
        if cur is None:
            return
        whole = matched == len(self.open)
        if not whole and self.leaf is not None and self.leaf.kind == PARAGRAPH:
            cur.eat_blanks()
            self.put(self.leaf, cur.at, cur.end)  # lazy continuation
            return
        self.close_to(matched)
        self.text_line(cur)

    def blanks(self, cur: Cursor) -> int:
        at = cur.at
        while at < cur.end and self.text[at] in " \t":
            at += 1
        return min(at - cur.at, max(0, cur.end - cur.at - 1))

    def blank_line(self, cur: Cursor, matched: int) -> None:
        if self.leaf is not None and self.leaf.kind == CODE and matched == len(self.open):
            cur.eat(4)
            self.leaf.parts.append((cur.at, cur.end))
            return
        self.close_to(matched)
        self.end_leaf()

    def in_fence(self, cur: Cursor) -> None:
        leaf = self.leaf
        mark, indent = leaf.closing
        if cur.indent() <= 3:
            rest = self.text[cur.at : cur.end].strip(" \t")
            if len(rest) >= len(mark) and set(rest) == {mark[0]}:
                self.extend(leaf, cur.end)
                self.leaf = None
                return
        cur.eat(min(indent, cur.indent()))
        self.put(leaf, cur.at, cur.end)

    def in_html(self, cur: Cursor) -> None:
        leaf = self.leaf
        if leaf.closing is None and cur.blank():
            self.end_leaf()
            return
        self.put(leaf, cur.at, cur.end)
        if leaf.closing is not None and leaf.closing.search(self.text, cur.at, cur.end):
            self.leaf = None

    def start_blocks(self, cur: Cursor, matched: int) -> tuple[Cursor | None, int]:
        """Opens the blocks that begin here. Returns what is left of the line (None if nothing is) and how many containers it lies in."""
        whole = matched == len(self.open)
        while True:
            paragraph = self.leaf if whole and self.leaf is not None and self.leaf.kind == PARAGRAPH else None
            in_table = whole and self.leaf is not None and self.leaf.kind == TABLE
            indent = cur.indent()
            if indent >= 4:
                if self.leaf is not None and self.leaf.kind == PARAGRAPH:
                    return cur, matched
                self.close_to(matched)
                if self.leaf is None or self.leaf.kind != CODE:
                    start = cur.at
                    self.begin(CODE, start)
                cur.eat(4)
                if not self.leaf.parts:
                    self.leaf.start = cur.at
                self.put(self.leaf, cur.at, cur.end)
                return None, matched
            probe = Cursor(self.text, cur.at, cur.end)
            probe.column, probe.owed = cur.column, cur.owed
            probe.eat_blanks()
            first = self.text[probe.at] if probe.at < probe.end else ""
            if first == ">" and len(self.open) < MAX_DEPTH:
                self.open_container(QUOTE, probe.at, matched)
                probe.skip(1)
                probe.eat(1)
                cur, matched, whole = probe, len(self.open), True
            elif m := probe.match(ATX):
                self.heading(probe, matched, m)
                return None, matched
            elif (m := probe.match(FENCE)) and not (m[1] and "`" in m[2]):
                self.close_to(matched)
                leaf = self.begin(CODE, probe.at)
                leaf.marker = m[1] or m[3]
                leaf.info, leaf.closing = (m[2] or m[4] or "").strip(), (leaf.marker, indent)
                self.extend(leaf, probe.end)
                return None, matched
            elif first == "<" and (block := self.html_start(probe, paragraph is not None or in_table)):
                self.close_to(matched)
                leaf = self.begin(HTML, probe.at)
                leaf.closing = block[1]
                self.put(leaf, cur.at, cur.end)
                if leaf.closing is not None and leaf.closing.search(self.text, probe.at, probe.end):
                    self.leaf = None
                return None, matched
            elif paragraph is not None and (m := probe.match(SETEXT)) and self.setext(paragraph, probe, m):
                return None, matched
            elif paragraph is not None and paragraph.parts and "-" in self.text[probe.at : probe.end] and probe.match(DELIMITERS) and self.table(paragraph, probe):
                return None, matched
            elif probe.match(RULE):
                self.close_to(matched)
                self.put(self.begin(BREAK, probe.at), probe.at, probe.end)
                self.leaf = None
                return None, matched
            elif (m := probe.match(MARKER)) and len(self.open) < MAX_DEPTH and self.item(probe, m, indent, matched, paragraph is not None and bool(paragraph.parts)):
                cur, matched, whole = probe, len(self.open), True
            else:
                return cur, matched
            if cur.blank():
                return None, matched

    def open_container(self, kind: str, start: int, matched: int) -> Node:
        self.close_to(matched)
        self.end_leaf()
        if kind != ITEM and self.open and self.open[-1].kind in (ORDERED, UNORDERED):
            self.open.pop()
        for parent in self.open:
            parent.filled = True
        node = self.add(kind, start)
        self.extend(node, start + 1)
        self.open.append(node)
        return node

    def heading(self, cur: Cursor, matched: int, m: re.Match) -> None:
        self.close_to(matched)
        leaf = self.begin(HEADING, cur.at)
        leaf.level, leaf.marker = len(m[1]), m[1]
        start, end = m.end(), cur.end
        while end > start and self.text[end - 1] in " \t":
            end -= 1
        close = end
        while close > start and self.text[close - 1] == "#":
            close -= 1
        if close == start or self.text[close - 1] in " \t":
            end = close
        while end > start and self.text[end - 1] in " \t":
            end -= 1
        self.put(leaf, min(start, end), end)
        self.extend(leaf, cur.end)
        self.leaf = None

    def html_start(self, cur: Cursor, in_text: bool) -> tuple | None:
        kinds = HTML_BLOCKS[:-1] if in_text else HTML_BLOCKS
        return next((block for block in kinds if cur.match(block[0])), None)

    def setext(self, leaf: Node, cur: Cursor, m: re.Match) -> bool:
        self.take_definitions(leaf)
        if not leaf.parts:  # definitions only: the line is text
            self.leaf = None
            return False
        leaf.kind, leaf.level, leaf.marker = HEADING, 1 if m[1][0] == "=" else 2, m[1][0]
        self.extend(leaf, cur.end)
        self.leaf = None
        return True

    def table(self, leaf: Node, cur: Cursor) -> bool:
        head = leaf.parts[-1]
        marks = [self.text[a:b] for a, b in cells_of(self.text, cur.at, cur.end)]
        if len(marks) != len(cells_of(self.text, *head)) or "|" not in self.text[head[0] : head[1]] + self.text[cur.at : cur.end]:
            return False
        leaf.parts.pop()
        if leaf.parts:
            leaf.end, leaf.last_line = leaf.parts[-1][1], self.number - 2
            self.end_leaf()
        else:
            self.nodes.pop()  # an open paragraph is the last node
            self.leaf = None
        self.number -= 1
        node = self.begin(TABLE, head[0])
        node.alignment = ["CENTER" if x[0] == x[-1] == ":" and len(x) > 1 else "LEFT" if x[0] == ":" else "RIGHT" if x[-1] == ":" else "NONE" for x in marks]
        node.row = 0
        self.table_row(head)
        self.number += 1
        self.extend(node, cur.end)
        return True

    def table_row(self, part: tuple[int, int]) -> None:
        table = self.leaf
        row = Node(ROW, table, part[0], self.number)
        row.parts, row.row, row.header = [part], table.row, table.row == 0
        self.nodes.append(row)
        self.extend(row, part[1])
        cells = cells_of(self.text, *part)
        for column, alignment in enumerate(table.alignment):
            start, end = cells[column] if column < len(cells) else (part[1], part[1])
            cell = Node(CELL, row, start, self.number)
            cell.parts, cell.end, cell.row, cell.column, cell.alignment, cell.header = [(start, end)], end, row.row, column, alignment, row.header
            self.nodes.append(cell)
        table.row += 1

    def item(self, cur: Cursor, m: re.Match, indent: int, matched: int, interrupts: bool) -> bool:
        """Opens an item, and a list unless one of its kind is open; the cursor goes to the item's content."""
        empty = not self.text[m.end() : cur.end].strip(" \t")
        if interrupts and (empty or m[2] not in (None, "1") and int(m[2] or 0) != 1):
            return False
        kind, mark = (UNORDERED, m[1]) if m[1] else (ORDERED, m[3])
        start, width = cur.at, len(m[0])
        self.close_to(matched)
        self.end_leaf()
        last = self.open[-1] if self.open else None
        if last is None or last.kind != kind or last.marker != mark:
            listed = self.open_container(kind, start, len(self.open))
            listed.marker, listed.ordinal = mark, int(m[2]) if m[2] else None
            listed.row = 0
        listed = self.open[-1]
        node = self.open_container(ITEM, start, len(self.open))
        node.marker = m[0]
        node.ordinal = None if listed.ordinal is None else listed.ordinal + listed.row
        listed.row += 1
        cur.skip(width)
        after = cur.indent()
        taken = 1 if empty or after > 4 else after
        node.offset = indent + width + taken
        cur.eat(taken)
        node.filled = not empty
        return True

    def text_line(self, cur: Cursor) -> None:
        cur.eat_blanks()
        if self.leaf is not None and self.leaf.kind == TABLE:
            self.table_row((cur.at, cur.end))
            return
        if self.leaf is None or self.leaf.kind != PARAGRAPH:
            self.begin(PARAGRAPH, cur.at)
        self.put(self.leaf, cur.at, cur.end)


def markdown_nodes(document_id: int, text: str | None) -> list[tuple]:
    """The rows of NODES of one text. A container's text is its whole source."""
    if not text or not text.strip():
        return []
    nodes = Parser(text).nodes
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    bytes_before = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
    number = {id(n): i for i, n in enumerate(nodes, 1)}
    out, blocks = [], 0
    for i, n in enumerate(nodes, 1):
        top = n.parent is None and n.kind != DEFINITION
        blocks += top
        end = max([n.end, *(b for _, b in n.parts)]) if n.kind not in (ROW, CELL) else n.end
        parts = n.parts if n.kind not in (*CONTAINERS, TABLE) else [(n.start, end)]
        alignment = n.alignment if isinstance(n.alignment, str) else None
        out.append(
            (document_id, i, number[id(n.parent)] if n.parent is not None else 0, n.kind, blocks if top else None, n.level, n.marker, n.ordinal, n.header, alignment, n.row if n.kind in (ROW, CELL) else None, n.column, n.info)
            + (n.line, n.last_line, n.start, end, int(bytes_before[n.start]), int(bytes_before[end]), "\n".join(text[a:b] for a, b in parts), [{"start": a, "end": b} for a, b in parts])
        )
    return out


_ARROW = pa.schema(
    [("document_id", pa.int64()), ("node_no", pa.int32()), ("parent_no", pa.int32()), ("node_type", pa.string()), ("block_no", pa.int32()), ("level", pa.int32()), ("marker", pa.string()), ("ordinal", pa.int32())]
    + [("is_header", pa.bool_()), ("alignment", pa.string()), ("row_no", pa.int32()), ("column_no", pa.int32()), ("info", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())]
    + [(c, pa.int64()) for c in ("char_start", "char_end", "byte_start", "byte_end")]
    + [("text", pa.string()), ("parts", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)
_ROWS = 5000


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            rows += markdown_nodes(key.as_py(), text.as_py())
            while len(rows) >= _ROWS:
                part, rows = rows[:_ROWS], rows[_ROWS:]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _ARROW, strict=True)], schema=_ARROW)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def parse_nodes(docs: DataFrame) -> DataFrame:
    """All nodes of Markdown documents (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_nodes, NODES)


def blocks_of(nodes: DataFrame) -> DataFrame:
    """document_id, block_no, block_type, heading_level, text of the top-level nodes; a table's text is its rows, cells joined by ' | '."""
    kinds = F.create_map(*[F.lit(x) for pair in BLOCK_TYPES.items() for x in pair])
    rows = F.concat_ws("\n", F.transform(F.filter(F.split("text", "\n"), lambda x, i: i != 1), lambda x: F.concat_ws(" | ", F.transform(F.split(F.regexp_replace(x, r"^[ \t>]*\|?|(?<!\\)\|[ \t]*$", ""), r"(?<!\\)\|"), lambda c: F.trim(c)))))
    text = F.when(F.col("node_type") == TABLE, rows).otherwise(F.col("text"))
    return nodes.where("block_no is not null").select("document_id", "block_no", F.coalesce(F.try_element_at(kinds, F.col("node_type")), F.lit("Text")).alias("block_type"), F.col("level").alias("heading_level"), F.trim(text).alias("text")).where("text <> '' or block_type = 'TABLE'")


def cells_with_spans(nodes: DataFrame) -> DataFrame:
    """Every cell of every table: its row's and its own number, its text and where it stands."""
    return nodes.where(F.col("node_type") == CELL).select("document_id", "node_no", "row_no", "column_no", "is_header", "alignment", "text", "start_line", "char_start", "char_end", "byte_start", "byte_end")
