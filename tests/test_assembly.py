"""Hand-computed cases of assembly, profiles, filters, pages, planning, writers, parsers and the entry functions."""

import pytest
from pyspark.sql import functions as F

from docloom import api
from docloom.functions import text as T
from docloom.operators import assembly, chunking, filters, pages, planning, profiles, retrieval, routing
from docloom.plans import registry
from docloom.plans.options import Channel, Plan
from docloom.sources import index, parsers, vector_index, writers
from docloom.streaming import ingest

BLOCK = "document_id long, block_no long, block_id long, block_type string, text string, section_path string, canonical_path string, page_no int, page_range string, table_html string, image_caption string"


def block(n, kind, text, section="", path="", page=0, pages_="", table=None, caption=None):
    return (1, n, 100 + n, kind, text, section, path, page, pages_, table, caption)


@pytest.fixture(scope="module")
def document(spark):
    rows = [
        block(1, "TITLE", "Intro", "Intro", "/Intro/1", 2), block(2, "TEXT", "a" * 30, "Intro", "", 3), block(3, "TABLE", "x | y", "Intro", "", 0, "", "<t/>"),
        block(4, "TITLE", "## End", "End", "/End/4"), block(5, "IMAGE", "", "End", "", 0, "p9", None, "a cat"), block(6, "TEXT", "One. Two. " * 12, "End"), block(7, "TEXT", " ", "End"),
    ]
    return spark.createDataFrame(rows, BLOCK)


def test_blocks_are_rendered_by_type(document):
    got = {r["block_no"]: r["c"] for r in document.select("block_no", assembly.rendered().alias("c")).collect()}
    assert (got[1], got[3], got[4], got[5], got[7]) == ("# Intro", "[TABLE]\nx | y\n\n<t/>", "## End", "[IMAGE]\na cat", "")


def test_windows_are_packed_greedily(document):
    runs = assembly.with_runs(document, by_section=True)
    got = {r["block_no"]: (r["run_no"], r["window_no"], r["oversize"]) for r in assembly.packed(runs, 59).collect()}
    assert got == {1: (1, 0, False), 2: (1, 0, False), 3: (1, 1, False), 4: (2, 0, False), 5: (2, 0, False), 6: (2, 1, True)}
    whole = {r["block_no"]: r["window_no"] for r in assembly.packed(runs, 1000).collect()}
    assert set(whole.values()) == {0}


def test_parents_carry_what_their_blocks_say(document):
    got = {r["run_no"]: r for r in assembly.parents_of(assembly.with_runs(document, True), ["document_id", "run_no"]).collect()}
    assert (got[1]["title"], got[1]["chunk_type"], got[1]["page_range"], got[1]["page_no"], got[1]["block_ids"]) == ("Intro", "MIXED", "2-3", 2, [101, 102, 103])
    assert (got[2]["title"], got[2]["page_range"], got[2]["canonical_path"], got[2]["block_count"]) == (" End", "p9", "/End/4", 4)


def test_parent_seeds_split_long_blocks_and_keep_order(document):
    seeds = assembly.parent_seeds(document, ["STRUCTURE"], 59).orderBy("position").collect()
    assert [r["first_block"] for r in seeds][:3] == [1, 3, 4] and all(len(r["text"]) <= 59 for r in seeds)
    assert "".join(r["text"] for r in seeds if r["first_block"] == 6).replace(" ", "").replace("\n", "") == "One.Two." * 12
    windows = assembly.parent_seeds(document, ["RECURSIVE"], 60).collect()
    assert min(r["first_block"] for r in windows) == 1 and len(windows) >= 4


def test_pipeline_maps_every_candidate_and_drops_repeats(spark):
    rows = spark.createDataFrame([(1, 1, "s", None, "same text"), (1, 2, "s", None, "same text"), (1, 3, "s", None, " ")], "document_id long, position int, section_path string, item_index int, text string")
    assert [r["text"] for r in assembly.run_pipeline(rows, ["STRUCTURE", "RECURSIVE", "unknown"]).collect()] == ["same text"]


def test_children_inherit_and_fall_back(spark, document):
    parents = spark.createDataFrame([(1, 1, [102, 999, 105], "p", "S", "/P"), (1, 2, [998], " alone ", "S2", "/Q"), (1, 3, [], "", "", "")], "document_id long, parent_no long, block_ids array<long>, text string, section_path string, canonical_path string")
    children = assembly.child_seeds(parents, document)
    got = sorted((r["parent_no"], r["child_no"], r["text"], r["section_path"], r["canonical_path"]) for r in children.collect())
    assert got == [(1, 0, "a" * 30, "Intro", "/P"), (1, 2, "[IMAGE]\na cat", "End", "/P"), (2, 0, "alone", "S2", "/Q"), (3, 0, "", "", "")]
    assert {r["parent_no"] for r in assembly.with_valid_children(parents, children).collect()} == {1, 2}


def test_nodes_are_found_by_path_section_or_title(spark):
    parents = spark.createDataFrame([(1, 1, "/a", "x"), (1, 2, "", "Two"), (1, 3, "", "")], "document_id long, parent_no long, canonical_path string, section_path string")
    nodes = spark.createDataFrame([(1, 5, "/z", "Two", "t"), (1, 6, "/a", "q", "Two")], "document_id long, node_no int, canonical_path string, section_path string, title string")
    assert {r["parent_no"]: r["node_no"] for r in assembly.nodes_of(parents, nodes).collect()} == {1: 6, 2: 5, 3: None}


def test_recursive_chunks_carry_the_tail_of_the_one_before():
    assert chunking.with_overlap(["aaaa", "bbbb", "cc"], 8, 3) == ["aaaa", "aaa\nbbbb", "bbb\ncc"]
    pieces = chunking.recursive_pieces("\n\n".join(f"para {i} " + "w" * 20 for i in range(6)), 60, 10)
    assert all(len(p) <= 60 for p in pieces) and pieces[1].startswith("w")


def test_questions_of_a_chunk(spark):
    rows = spark.createDataFrame([("T", ["k"], "TABLE"), (" ", ["k"], "FIGURE"), ("", [], "TEXT")], "title string, keywords array<string>, chunk_type string")
    assert [r["questions"] for r in chunking.question_seed(rows).collect()] == [["关于T的核心内容是什么？", "T有哪些要求或注意事项？", "这个表格说明了什么？"], ["关于k的核心内容是什么？", "k有哪些要求或注意事项？", "这张图片说明了什么？"], []]


def test_profiles_by_keyword_rules(spark):
    docs = spark.createDataFrame([(1, "故障手册.pdf", "排查步骤"), (2, "a.txt", "plain"), (3, "", "部署 安装")], "document_id long, document_name string, text string")
    nodes = spark.createDataFrame([(1, 1, "SECTION", "1.2 原因"), (1, 2, "SECTION", "处理"), (1, 3, "STEP", "x")], "document_id long, node_no int, node_type string, title string")
    got = {r["document_id"]: r for r in profiles.profiles(docs, nodes).collect()}
    assert (got[1]["document_type"], got[1]["topics"], got[1]["questions"][0], got[1]["graph_friendly"]) == ("troubleshooting", ["原因", "处理", "故障手册"], "原因的可能原因有哪些？", 1)
    assert (got[1]["scope_code"], got[1]["category"]) == ("troubleshooting", "故障排查")
    assert (got[2]["document_type"], got[2]["summary"]) == ("intro", "文档《a.txt》摘要：plain")
    assert (got[3]["document_type"], got[3]["scope_code"], got[3]["category"], got[3]["summary"]) == ("manual", "deployment", "操作手册", "文档《未命名文档》摘要：部署 安装")
    topics = profiles.derived_topics(profiles.profiles(docs, nodes), spark.createDataFrame([(9, 1, 4.0), (9, 2, 5.0)], "question_id long, document_id long, score double"), 2)
    assert [r["topic"] for r in topics.orderBy("score", ascending=False).collect()][0] == "a"


def test_scopes_of_requests(spark):
    bases = spark.createDataFrame([("a",), ("b",), ("c",)], "base_id string")
    docs = spark.createDataFrame([(1, "a", 3, 11, 5), (2, "a", 1, 12, 6), (3, "b", 3, None, 7), (4, "c", 3, 14, 8)], "document_id long, base_id string, index_status int, last_index_task_id long, update_time long")
    allowed = lambda *x: {r["base_id"]: r["allowed"] for r in filters.scope_of(bases, docs, *x).collect()}
    assert allowed("kb", "ALL") == {"a": [1], "c": [4]} and allowed("kb", "SELECTED", ["a", "b", "a"]) == {"a": [1]}
    assert allowed("open_chat", "ALL") == {} == allowed("kb", "NONE")
    with pytest.raises(ValueError):
        allowed("kb", "SELECTED", ["zz"])
    assert [r["document_id"] for r in filters.retrievable(docs).collect()] == [4, 1]


def test_rewrites_split_only_clear_questions(spark):
    rows = spark.createDataFrame([("a? b?", "r", True, [" x ", "x", "y"]), ("a b", "r", True, ["x", "y"]), ("a? b?", " ", True, []), ("a? b?", "r", False, ["x"])], "question string, rewrite string, should_split boolean, sub_questions array<string>")
    assert [(r["rewritten"], r["questions"]) for r in planning.rewrite_plan(rows).collect()] == [("r", ["x", "y"]), ("r", ["r"]), ("a? b?", ["a", "b"]), ("r", ["r"])]


def test_sections_by_number_then_title(spark):
    sections = spark.createDataFrame([(1, 1, "1.2 Start", "Start"), (1, 2, "Set up", "Guide/Set up"), (1, 3, "Other", "")], "document_id long, node_no int, title string, section_path string")
    questions = spark.createDataFrame([(1, 1, "see 9.9 and 1.2 of “Set up”"), (2, 1, "what is “set-up”?"), (3, 1, "nothing")], "question_id long, document_id long, question string")
    assert {r["question_id"]: (r["node_no"], r["found_by"]) for r in planning.resolved_sections(questions, sections).collect()} == {1: (1, "CODE"), 2: (2, "TITLE")}


def test_summary_texts(spark):
    schema = "summary string, goal string, facts array<string>, preferences array<string>, resolved array<string>, pending array<string>, hints array<string>"
    rows = spark.createDataFrame([(" ", " g ", ["f", " f ", ""], [], None, ["p"], [])], schema)
    got = planning.normalised_summary(rows).first()
    assert (got["summary"], got["facts"]) == ("目标：g；事实：f；待跟进：p", ["f"])
    assert got["long_text"] == "【长期会话摘要】\n目标：g；事实：f；待跟进：p\n\n【会话目标】\ng\n\n【已确认事实】\n- f\n\n【待跟进问题】\n- p"


def test_history_keeps_the_end_of_recent_turns(spark):
    rows = spark.createDataFrame([("s" * 50, "r" * 100), ("s" * 50, " "), ("s" * 5, "r" * 10)], "s string, r string")
    got = [r["x"] for r in rows.select(planning.planning_text(F.col("s"), F.col("r"), 40).alias("x")).collect()]
    assert got == ["s" * 11 + "…\n\n…" + "r" * 25, "s" * 39 + "…", "sssss\n\n" + "r" * 10]


def test_dates_and_searches(spark):
    rows = spark.createDataFrame([("今天天气",), ("去年新闻",), ("2024年3月1日天气",), ("周几",), ("普通问题",)], "q string")
    got = [tuple(r) for r in rows.select(routing.needs_date(F.col("q")), routing.needs_search(F.col("q"))).collect()]
    assert got == [(True, True), (False, False), (True, False), (True, False), (False, False)]
    assert rows.select(routing.dated_question(F.lit("今天"), F.to_date(F.lit("2024-05-06"))).alias("x")).first()["x"] == "今天（当前日期：2024-05-06）"


def test_reranker_fills_in_by_position(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "d"), (2, 2, "e")], "question_id int, position int, chunk_id string")
    scores = spark.createDataFrame([(1, 3, 0.9), (1, 1, 0.1)], "question_id int, position int, relevance double")
    got = {(r["question_id"], r["chunk_id"]): r["rerank_score"] for r in retrieval.reranked(rows, scores, 2).collect()}
    assert got == {(1, "c"): 0.9, (1, "a"): 0.1, (2, "d"): None, (2, "e"): None}
    assert retrieval.reranked(rows, scores, 2, enabled=False).count() == 5


def test_files_in_other_codings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿标题".encode())
    (tmp_path / "b.txt").write_bytes("中文内容".encode("gb18030"))
    got = {r["name"][-5]: r["content"] for r in parsers.read_files(spark, str(tmp_path / "*.txt")).collect()}
    assert got == {"a": "标题", "b": "中文内容"}
    assert parsers.decoded(b"\xff\xff\xff") == "ÿÿÿ"
    assert [x[4] for x in parsers.html_blocks(1, "<h1>A</h1><p>b</p>")] == ["A", "b"]
    assert [tuple(r) for r in parsers.line_spans(spark.createDataFrame([(1, "é\nab")], "doc_id long, text string")).collect()] == [(1, 0, 0, 1, 0), (1, 1, 2, 4, 3)]


def test_documents_are_replaced_one_by_one(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    path, schema = str(tmp_path / "chunks"), "document_id long, chunk_text string"
    writers.write_index(spark.createDataFrame([(1, "a"), (2, "b"), (2, " ")], schema), path)
    writers.write_index(spark.createDataFrame([(2, "c"), (3, "d")], schema), path)
    assert sorted((r["document_id"], r["chunk_text"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    rows = spark.createDataFrame([(1, 5, None), (1, 7, 5), (1, 9, 4)], "document_id long, id long, parent_id long")
    assert sorted((r["id"], r["parent_id"]) for r in writers.snapshot(rows, ["parent_id"], 100).collect()) == [(100, None), (101, 100), (102, None)]
    old = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "document_id long, task_id long, text string")
    assert sorted(r["text"] for r in writers.replaced_by_task(old, spark.createDataFrame([(1, 2, "z")], old.schema)).collect()) == ["x", "z"]


def test_phases_go_on_where_they_stopped(spark):
    tasks, done = spark.createDataFrame([(1,), (2,)], "task_id long"), spark.createDataFrame([(1, 1), (1, 2)], "task_id long, phase_no int")
    assert {r["task_id"]: r["next_phase"] for r in ingest.resumable(tasks, done).collect()} == {1: 3, 2: 1}


def test_failed_batches_are_told_and_the_stream_goes_on(spark, tmp_path):
    source, target, failed = (str(tmp_path / x) for x in ("in", "out", "failed"))

    def process(rows):
        raise ValueError("no parser")

    spark.createDataFrame([(1, "a")], "task_id long, text string").write.parquet(source)
    ingest.ingest(ingest.stream(spark, source, "task_id long, text string"), process, target, failed, str(tmp_path / "cp")).awaitTermination()
    assert [(r["task_id"], r["reason"]) for r in spark.read.parquet(failed).collect()] == [(1, "no parser")]


def test_pages(spark):
    chunks = spark.createDataFrame([(1, 0, 0, 2, 10), (1, 1, 0, 1, 11), (1, 2, None, 2, 12)], "document_id long, chunk_no int, parent_no long, vector_status int, tokens long")
    assert pages.chunk_page_stats(chunks).first().asDict() == {"document_id": 1, "parents": 1, "ready": 2, "pending": 1, "avg_tokens": 11}
    assert [(r["parent_no"], r["chunk_nos"], r["group_order"]) for r in pages.chunks_by_parent(chunks).orderBy("group_order").collect()] == [(0, [0, 1], 1), (None, [2], 2)]
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, " "), (1, 3, "a"), (1, 4, "b"), (None, 5, "c")], "k int, at int, v string")
    assert [(r["value"], r["position"]) for r in pages.first_distinct(rows, "k", F.col("v"), [F.col("at")], 0).where("k = 1").orderBy("position").collect()] == [("a", 1), ("b", 2)]
    assert [(r["k"], r["v"]) for r in pages.last_by_key(rows, "k", "v", "at").collect()] == [(1, "b")]


def test_text_tools(spark):
    row = spark.createDataFrame([('x ["a", " ", "b"] y', "- one\n2. two\n", "知识召回abc策略", 166.125, 3.0)], "j string, l string, h string, n double, m double")
    got = row.select(T.tolerant_array(F.col("j")), T.tolerant_array(F.col("l")), T.segmented(F.col("h"), ["知识", "召回"]), T.number_text(F.col("n")), T.number_text(F.col("m")), T.prompt("{a}-{b}", {"a": F.col("m"), "b": F.lit(None)})).first()
    assert list(got) == [["a", "b"], ["one", "two"], ["知识", "召回", "abc", "策", "略"], "166.12", "3", "3.0-"]


def test_entry_functions(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "red fox runs"), (2, "blue whale swims"), (3, "red whale")], "chunk_id long, chunk_text string")
    stored = api.build_index(chunks, str(tmp_path / "index"))
    questions = spark.createDataFrame([(7, "red fox", [1.0, 0.0])], "question_id long, question string, query array<double>")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "chunk_id long, vector array<double>")
    hits = api.search(questions, stored, vectors)
    assert [(r["chunk_id"], r["channel"]) for r in hits.orderBy("final_rank").collect()][0] == (1, "hybrid")
    assert {r["chunk_id"] for r in api.search(questions, stored, None, Plan(channels=(Channel("keyword"),)), chunks.where("chunk_id = 3")).collect()} == {3}
    assert [r["citation_id"] for r in api.answer_context(hits, chunks).orderBy("position").collect()][0] == 1
    scored = spark.createDataFrame([(1, 5, 40.0), (2, 5, 4.0)], "question_id long, candidate int, score double")
    routed = {(r["question_id"], r["candidate"]) for r in api.route(scored, spark.createDataFrame([(5,), (6,)], "candidate int"), 3).collect()}
    assert routed == {(1, 5), (2, 5), (2, 6)}
    assert api.understand(questions).first()["query_type"] == "DOCUMENT_QA"


def test_entry_functions_use_the_registry(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "red fox runs"), (2, "blue whale swims"), (3, "red whale")], "chunk_id long, chunk_text string")
    stored = api.build_index(chunks, str(tmp_path / "keywords"))
    questions = spark.createDataFrame([(7, "xof")], "question_id long, question string")
    keyword = Plan(channels=(Channel("keyword"),))
    assert api.search(questions, stored, None, keyword).count() == 0
    registry.TOKENISERS.add("backwards", lambda x: index.terms_of(F.reverse(x)))
    assert [r["chunk_id"] for r in api.search(questions, stored, None, keyword, tokeniser="backwards").collect()] == [1]
    vectors = chunks.select("chunk_id", registry.hashed_embedding(F.col("chunk_text")).alias("vector"))
    vector_index.write_vector_index(vectors, str(tmp_path / "vectors"), k=1)
    cells = vector_index.read_vector_index(spark, str(tmp_path / "vectors"))
    asked, vector = questions.withColumn("question", F.lit("whale swims blue")), Plan(channels=(Channel("vector"),))
    assert api.search(asked, stored, cells, vector).orderBy("final_rank").first()["chunk_id"] == 2
    assert {r["chunk_id"] for r in api.search(asked, stored, cells, vector, chunks.where("chunk_id <> 2")).collect()} <= {1, 3}
    registry.SCORERS.add("constant", lambda semantic, lexical, relation: F.lit(5.0))
    features = spark.createDataFrame([(1, 2, 0.5, 1.0, 0.0)], "question_id long, candidate int, semantic double, lexical double, relation double")
    assert api.score_routes(features, "constant").first()["score"] == 5 != api.score_routes(features).first()["score"]
    relevance = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.9)], "question_id long, position int, relevance double")
    placed = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "question_id long, chunk_id long, position int")
    assert [r["chunk_id"] for r in api.rerank(placed, relevance, 1).collect()] == [6]


def test_registry(spark):
    with pytest.raises(KeyError):
        registry.EMBEDDERS.get("none")
    with pytest.raises(ValueError):
        registry.SCORERS.add(" ", len)
    assert registry.EMBEDDERS.names() == ["hashed"] and registry.TOKENISERS.get("Latin_Han") is index.terms_of
    vector = spark.createDataFrame([("a word or two",)], "t string").select(registry.hashed_embedding(F.col("t"), 8).alias("v")).first()["v"]
    assert len(vector) == 8 and sum(vector) == 3
    assert registry.told("x", spark.range(1)).count() == 1
