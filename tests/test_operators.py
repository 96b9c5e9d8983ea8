"""Hand-computed cases of the retrieval engine's operators."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import blocks, chunking, conversation, retrieval, routing
from docloom.plans.options import Channel, Plan
from docloom.sources import parsers


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("column", "value", "expected"),
    [
        (lambda v: T.token_estimate(v), "Hello world 你好", 6),
        (lambda v: T.clip_head(v, 4), "abcdef", "abc…"),
        (lambda v: T.clip_tail(v, 4), "abcdef", "…def"),
        (lambda v: T.compact(v), " a \t b\n", "a b"),
        (lambda v: T.sentences(v), "A. B! C", ["A.", "B!", "C"]),
        (lambda v: T.chinese_number(v), "十", 10),
        (lambda v: T.chinese_number(v), "十五", 15),
        (lambda v: T.chinese_number(v), "二十", 20),
        (lambda v: T.chinese_number(v), "二十五", 25),
        (lambda v: T.chinese_number(v), "7", 7),
        (lambda v: T.chinese_number(v), "x", None),
        (lambda v: parsers.block_type(v), "一、总则", "TITLE"),
        (lambda v: parsers.block_type(v), "概述：", "TITLE"),
        (lambda v: parsers.block_type(v), "plain text", "Text"),
        (lambda v: routing.is_multi_question(v), "a? b?", True),
        (lambda v: routing.is_multi_question(v), "a；b", True),
        (lambda v: routing.is_multi_question(v), "1. x", True),
        (lambda v: routing.is_multi_question(v), "hello", False),
        (lambda v: routing.split_question(v), "a? b; a\nc", ["a", "b", "c"]),
        (lambda v: T.heading_code(v), "3.2.1 Title", "3.2.1"),
        (lambda v: parsers.file_type(v), "A.Md", "MD"),
    ],
)
def test_scalars(spark, column, value, expected):
    assert one(spark, column(F.col("v")), v=value) == expected


def test_jaccard(spark):
    a, b = T.token_set(F.col("a")), T.token_set(F.col("b"))
    assert one(spark, T.jaccard(a, b), a="red fox", b="red dog") == pytest.approx(1 / 3)
    assert one(spark, T.jaccard(a, b), a="", b="xx") == 0


def test_fixed_window(spark):
    docs = spark.createDataFrame([(1, "abcdefghij")], "doc_id long, text string")
    assert [r["chunk_text"] for r in chunking.fixed_windows(docs, 4, 1).orderBy("chunk_no").collect()] == ["abcd", "defg", "ghij"]


def test_recursive_pieces_are_bounded_and_keep_all_text():
    text = "\n\n".join("para %d. " % i + "word " * (i * 20) for i in range(12))
    pieces = chunking.recursive_pieces(text, 200, 20)
    assert max(map(len, pieces)) <= 200
    assert set("".join(text.split())) == set("".join("".join(pieces).split()))


def test_gates_and_fusion(spark):
    v = spark.createDataFrame([(1, "c1", 0.9), (1, "c2", 0.8), (1, "c3", 0.5), (1, "c5", 0.4)], "question_id int, chunk_id string, score double")
    k = spark.createDataFrame([(1, "c2", 12.0), (1, "c4", 6.0), (1, "c6", 3.0)], "question_id int, chunk_id string, score double")
    plan = Plan()
    bag = retrieval.gated_channels({"vector": v, "keyword": k}, plan)
    got = {r["chunk_id"]: (r["fused_score"], r["rrf"], r["channel"]) for r in retrieval.fuse(bag, plan).collect()}
    assert got == {
        "c2": (2.134982, 0.032522, "hybrid"),
        "c1": (1.08, 0.016393, "vector"),
        "c4": (1.023871, 0.016129, "keyword"),
        "c3": (1.012698, 0.015873, "vector"),
    }


def test_disabled_channel_is_left_out(spark):
    v = spark.createDataFrame([(1, 1, 0.9)], "question_id int, chunk_id int, score double")
    plan = Plan(channels=(Channel("vector"), Channel("keyword", enabled=False)))
    assert {r["channel"] for r in retrieval.gated_channels({"vector": v, "keyword": v}, plan).collect()} == {"vector"}
    with pytest.raises(ValueError):
        Plan(channels=(Channel("a"), Channel("a")))


def test_elevation(spark):
    hits = spark.createDataFrame([(1, "vector", 1, 0.9), (1, "vector", 2, 0.7), (1, "keyword", 3, 0.6), (1, "keyword", 9, 0.2)], "question_id int, channel string, chunk_id int, fused_score double")
    parents = spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "chunk_id int, parent_id int")
    got = {r["parent_key"]: (r["score"], r["child_count"], r["best_child"], r["channel"], r["parent_rank"]) for r in retrieval.ranked_parents(retrieval.elevate(hits, parents)).collect()}
    assert got == {"7": (1.206, 3, 1, "hybrid", 1), "orphan-9": (0.2, 1, 9, "keyword", 2)}


def test_route_score_and_confidence(spark):
    rows = spark.createDataFrame([(0.65, 3.0, 1.0)], "s double, l double, r double")
    got = rows.select(routing.route_score(F.col("s"), F.col("l"), F.col("r")).alias("v"), routing.route_source(F.col("s"), F.col("l"), F.col("r")).alias("src")).first()
    assert got["v"] == pytest.approx(35.3) and got["src"] == "COMPOSITE"
    scored = spark.createDataFrame([(1, "a", 22.5), (1, "b", 10.0), (2, "a", 4.0)], "q int, candidate string, score double")
    assert {r["q"]: (r["confidence"], r["status"]) for r in routing.confidence(scored, "q").collect()} == {1: (0.6, "SUCCESS"), 2: (0.4, "LOW_CONFIDENCE")}


def test_budget_stops_a_question_at_its_first_overflow(spark):
    refs = spark.createDataFrame([(1, 0, 0, 4), (1, 0, 1, 3), (1, 0, 2, 2), (1, 1, 0, 5)], "answer_id int, question_no long, position int, size long")
    got = {(r["question_no"], r["position"]): r["rendered"] for r in conversation.evidence_budget(refs, 10, 6).collect()}
    assert got == {(0, 0): True, (0, 1): False, (0, 2): False, (1, 0): True}


def test_overflow_batches(spark):
    turns = spark.createDataFrame([(1, i, "user", "x") for i in range(1, 9)], "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r["batch_no"] for r in conversation.overflow_batches(turns, 3, 3).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1}


def test_structure_tree_nests_by_level(spark):
    rows = [(1, 1, "TITLE", 1, "A"), (1, 2, "TITLE", 2, "B"), (1, 3, "Text", None, "t"), (1, 4, "TITLE", 2, "C")]
    tree = blocks.with_siblings(blocks.structure_tree(spark.createDataFrame(rows, parsers.BLOCKS)))
    got = {r["title"]: (r["parent_no"], r["prev_no"], r["next_no"]) for r in tree.collect()}
    assert got == {"A": (0, None, None), "B": (1, None, 4), "t": (2, None, None), "C": (1, 2, None)}


def test_options_conflict_when_values_differ_or_are_partly_missing(spark):
    stated = spark.createDataFrame([(1, "vectorTopK", "5"), (2, "keywordTopK", "3")], "base_id int, option_key string, option_value string")
    got = {r["option_key"]: (r["option_value"], r["conflict"]) for r in routing.merge_options(stated, {"vectorTopK": "10", "keywordTopK": "10"}).collect()}
    assert got == {"vectorTopK": ("10", 1), "keywordTopK": ("10", 1)}


def test_intent_rules(spark):
    rows = spark.createDataFrame([("3.2 节属于哪个章节",), ("有哪些章节",), ("今天天气",), ("第三步做什么",)], "question string")
    got = [tuple(r) for r in routing.intent_columns(rows).select("query_type", "needs_date", "item_index").collect()]
    assert got == [("STRUCTURE_NAVIGATION", False, None), ("STRUCTURE_NAVIGATION", False, None), ("DOCUMENT_QA", True, None), ("DOCUMENT_QA", False, 3)]


def test_parsers(spark):
    html = "<html><body><h2>Top</h2><p>one <b>two</b></p><script>x()</script><div>Part 1:</div></body></html>"
    assert [x[2:] for x in parsers.html_blocks(1, html)] == [("TITLE", 2, "Top"), ("Text", None, "one two"), ("TITLE", None, "Part 1:")]
    md = spark.createDataFrame([(1, "# A\n\ntext\nmore\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```\ncode\n```\n- x")], "doc_id long, text string")
    got = parsers.parse_markdown(md).orderBy("block_no")
    assert [(x["block_type"], x["text"]) for x in got.collect()] == [("TITLE", "A"), ("Text", "text\nmore"), ("TABLE", "a | b\n1 | 2"), ("CODE", "code"), ("LIST", "- x")]
    cells = parsers.table_cells(got).collect()
    assert [(r["row_no"], r["column_no"], r["cell"], r["is_header"]) for r in cells] == [(0, 0, "a", 1), (0, 1, "b", 1), (1, 0, "1", 0), (1, 1, "2", 0)]
