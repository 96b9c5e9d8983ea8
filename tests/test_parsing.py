"""Markdown by container blocks and word segmentation against brute force."""

import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import segmentation as S
from docloom.sources import keyword_index, markdown

FIELDS = [f.split()[0] for f in markdown.NODES.split(", ")]


def nodes(text):
    return [dict(zip(FIELDS, x, strict=True)) for x in markdown.markdown_nodes(1, text)]


def shape(text):
    """(type, text) of all nodes, indented by depth."""
    depth, out = {0: -1}, []
    for n in nodes(text):
        depth[n["node_no"]] = depth[n["parent_no"]] + 1
        out.append((depth[n["node_no"]], n["node_type"], n["text"]))
    return out


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("# A ##\n#\n#x", [(0, "HEADING", "A"), (0, "HEADING", ""), (0, "PARAGRAPH", "#x")]),
        ("a\nb\n===\n---", [(0, "HEADING", "a\nb"), (0, "THEMATIC_BREAK", "---")]),
        ("> a\nb\n\nc", [(0, "BLOCKQUOTE", "> a\nb"), (1, "PARAGRAPH", "a\nb"), (0, "PARAGRAPH", "c")]),
        ("> a\n# b", [(0, "BLOCKQUOTE", "> a"), (1, "PARAGRAPH", "a"), (0, "HEADING", "b")]),
        ("- a\n\n  b\n- c\nlazy", [(0, "UNORDERED_LIST", "- a\n\n  b\n- c\nlazy"), (1, "LIST_ITEM", "- a\n\n  b"), (2, "PARAGRAPH", "a"), (2, "PARAGRAPH", "b"), (1, "LIST_ITEM", "- c\nlazy"), (2, "PARAGRAPH", "c\nlazy")]),
        ("- a\n- b\n+ c", [(0, "UNORDERED_LIST", "- a\n- b"), (1, "LIST_ITEM", "- a"), (2, "PARAGRAPH", "a"), (1, "LIST_ITEM", "- b"), (2, "PARAGRAPH", "b"), (0, "UNORDERED_LIST", "+ c"), (1, "LIST_ITEM", "+ c"), (2, "PARAGRAPH", "c")]),
        ("text\n2. x", [(0, "PARAGRAPH", "text\n2. x")]),
        ("text\n1. x", [(0, "PARAGRAPH", "text"), (0, "ORDERED_LIST", "1. x"), (1, "LIST_ITEM", "1. x"), (2, "PARAGRAPH", "x")]),
        ("- > q\n  > r\n  - n", [(0, "UNORDERED_LIST", "- > q\n  > r\n  - n"), (1, "LIST_ITEM", "- > q\n  > r\n  - n"), (2, "BLOCKQUOTE", "> q\n  > r"), (3, "PARAGRAPH", "q\nr"), (2, "UNORDERED_LIST", "- n"), (3, "LIST_ITEM", "- n"), (4, "PARAGRAPH", "n")]),
        ("-\n\n  x", [(0, "UNORDERED_LIST", "-"), (1, "LIST_ITEM", "-"), (0, "PARAGRAPH", "x")]),
        ("    code\n\n    more\n\nx", [(0, "CODE_BLOCK", "code\n\nmore"), (0, "PARAGRAPH", "x")]),
        ("~~~ py\n```\n~~~~\nx", [(0, "CODE_BLOCK", "```"), (0, "PARAGRAPH", "x")]),
        ("```\nopen", [(0, "CODE_BLOCK", "open")]),
        ("\tcode", [(0, "CODE_BLOCK", "code")]),
        ("<!-- a\n\nb -->\nx", [(0, "HTML_BLOCK", "<!-- a\n\nb -->"), (0, "PARAGRAPH", "x")]),
        ("<div>\nx\n\ny", [(0, "HTML_BLOCK", "<div>\nx"), (0, "PARAGRAPH", "y")]),
        ("[a]: /u 'x'\n[b]:\ny", [(0, "LINK_DEFINITION", "[a]: /u 'x'"), (0, "PARAGRAPH", "[b]:\ny")]),
        ("* * *\n- - -", [(0, "THEMATIC_BREAK", "* * *"), (0, "THEMATIC_BREAK", "- - -")]),
        ("a\r\nb\r\n", [(0, "PARAGRAPH", "a\nb")]),
        ("p\na | b\n- | :-:\n1 | \\| x | 3\n> q", [(0, "PARAGRAPH", "p"), (0, "TABLE", "a | b\n- | :-:\n1 | \\| x | 3"), (1, "TABLE_ROW", "a | b"), (2, "TABLE_CELL", "a"), (2, "TABLE_CELL", "b"), (1, "TABLE_ROW", "1 | \\| x | 3"), (2, "TABLE_CELL", "1"), (2, "TABLE_CELL", "\\| x"), (0, "BLOCKQUOTE", "> q"), (1, "PARAGRAPH", "q")]),
        ("| a |\n| --- | --- |", [(0, "PARAGRAPH", "| a |\n| --- | --- |")]),
        ("", []),
        (" \n\t\n", []),
    ],
)
def test_blocks(text, want):
    assert shape(text) == want


LINES = ["# h", "text", "  two", "> q", ">> r", "- a", "  - b", "1. c", "2) d", "", " ", "    code", "```", "~~~", "***", "===", "---", "| a | b |", "|:-|-:|", "<div>", "<!-- x", "-->", "[l]: /u", "\ttab", "-", "é中😀 |x", ">\t- z", "- \tk"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(LINES), max_size=14), st.sampled_from(["\n", "\r\n"]))
def test_spans_cut_the_source(lines, ending):
    text = ending.join(lines)
    found = nodes(text)
    covered = set()
    for n in found:
        assert n["text"] == "\n".join(text[p["start"] : p["end"]] for p in n["parts"])
        assert text.encode()[n["byte_start"] : n["byte_end"]].decode() == text[n["char_start"] : n["char_end"]]
        assert 1 + text[: n["char_start"]].count("\n") == n["start_line"] and n["char_start"] <= n["char_end"]
        assert 1 + text[: n["char_end"]].count("\n") == n["end_line"] or n["node_type"] == "CODE_BLOCK"
        if n["parent_no"]:
            parent = found[n["parent_no"] - 1]
            assert parent["char_start"] <= n["char_start"] and n["char_end"] <= parent["char_end"]
        else:
            here = set(range(n["char_start"], n["char_end"]))
            assert not covered & here
            covered |= here
    assert {i for i, c in enumerate(text) if not c.isspace()} <= covered


def test_deep_nesting_and_long_lines():
    assert max(x[0] for x in shape(">" * 5000 + " deep")) <= markdown.MAX_DEPTH
    assert len(nodes("x" * 300_000 + "\n" + "|" * 20_000)) == 1


def test_blocks_and_cells_of_documents(spark):
    text = "# T\n\n| a | b |\n|--|:-:|\n| 1 | 2 \\| 3 |\n\n- x\n- y\n\n> z"
    docs = spark.createDataFrame([(1, text), (2, None), (3, " ")], "doc_id long, text string")
    found = markdown.parse_nodes(docs)
    assert [tuple(r) for r in markdown.blocks_of(found).orderBy("block_no").collect()] == [(1, 1, "TITLE", 1, "T"), (1, 2, "TABLE", None, "a | b\n1 | 2 \\| 3"), (1, 3, "LIST", None, "- x\n- y"), (1, 4, "BLOCKQUOTE", None, "> z")]
    cells = markdown.cells_with_spans(found).orderBy("node_no").collect()
    assert [(r["row_no"], r["column_no"], r["is_header"], r["alignment"], r["text"]) for r in cells] == [(0, 0, True, "NONE", "a"), (0, 1, True, "CENTER", "b"), (1, 0, False, "NONE", "1"), (1, 1, False, "CENTER", "2 \\| 3")]
    assert all(text[r["char_start"] : r["char_end"]] == r["text"] for r in cells)


# segmentation


def log_of(words, model):
    return sum(model.words.get(w, model.unseen if len(w) == 1 else -math.inf) for w in words)


def cuts(run):
    for marks in itertools.product([0, 1], repeat=max(0, len(run) - 1)):
        words, start = [], 0
        for i, m in enumerate(marks, 1):
            if m:
                words.append(run[start:i])
                start = i
        yield [*words, run[start:]]


WORDS = [("研究", 8), ("研究生", 3), ("生命", 6), ("命", 2), ("起源", 4), ("的", 20), ("生", 1), ("ab", 5), ("abc", 1), ("bc", 4), ("c", 2)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("研究生命起源的abcx"), min_size=1, max_size=9))
def test_best_path_is_the_most_probable(run):
    model = S.fitted(WORDS)
    path = S.best_path(run, model)
    assert "".join(path) == run
    assert log_of(path, model) == pytest.approx(max(log_of(c, model) for c in cuts(run)))


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("研究生命起源xy"), min_size=1, max_size=6))
def test_best_states_are_the_most_probable(run):
    model = S.fitted(WORDS)
    look = lambda s, c: model.shown.get((s, c), model.bare[s])

    def log(states):
        steps = zip(states, states[1:], strict=False)
        return model.start.get(states[0], -math.inf) + sum(look(s, c) for s, c in zip(states, run, strict=True)) + sum(model.step.get(x, -math.inf) for x in steps)

    every = ["".join(x) for x in itertools.product(S.STATES, repeat=len(run)) if x[-1] in "ES"]
    assert log(S.best_states(run, model)) == pytest.approx(max(map(log, every)))


def test_segmented_text():
    model = S.fitted(WORDS)
    assert S.cut_text("研究生命的起源, Hello 42", model) == ["研究", "生命", "的", "起源", "Hello", "42"]
    assert S.cut_text(None, model) == [] and S.cut_text("abcab", S.fitted(WORDS), S.LETTERS) == ["abc", "ab"]
    assert "".join(S.cut_text("魑魅魍魉", model)) == "魑魅魍魉"
    assert S.cut_text("字", S.fitted([])) == ["字"]


def test_weights_are_learned_from_the_corpus(spark):
    r = random.Random(3)
    truth = ["天气", "今天", "天", "很好", "好", "气候"]
    texts = spark.createDataFrame([("".join(r.choice(["今天天气很好", "天气好", "气候很好"]) for _ in range(5)),) for _ in range(40)] + [(None,)], "text string")
    model = S.learned(texts, "text", spark.createDataFrame([(w,) for w in truth], "word string"))
    assert S.cut_text("今天天气很好", model) == ["今天", "天气", "很好"]
    assert model.words["天气"] > model.words["天"]


def test_tokens_of_an_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "研究生命的起源"), (2, "命的起源"), (3, None)], "chunk_id long, chunk_text string")
    tokens = S.segmented(docs, "chunk_text", S.fitted(WORDS))
    stored = keyword_index.add(keyword_index.create(spark, str(tmp_path / "i")), tokens)
    asked = spark.createDataFrame([(1, "生命")], "question_id long, term string")
    assert [r["chunk_id"] for r in keyword_index.search(stored, asked).collect()] == [1]
    assert tokens.where("chunk_id = 2").select(F.array_join("tokens", "/")).first()[0] == "命/的/起源"
