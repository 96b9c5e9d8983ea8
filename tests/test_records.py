"""Checked requests, scopes in the order asked for, traces, and seeds of copied documents."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import assembly, filters, retrieval, routing
from docloom.plans.options import Channel, Plan, Request
from docloom.sources import writers


@pytest.mark.parametrize(
    "wrong",
    [{"question": "  "}, {"document_ids": ()}, {"task_ids": (1,)}, {"document_ids": (1, 0)}, {"task_ids": (1, -2)}, {"plan": Plan(channels=(Channel("vector", enabled=False),))}],
)
def test_requests_are_checked(wrong):
    right = {"question": "what?", "document_ids": (1, 2), "task_ids": (11, 12)}
    assert Request(**right).plan == Plan()
    with pytest.raises(ValueError):
        Request(**right | wrong)


def test_scope_keeps_the_order_asked_for(spark):
    bases = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "base_id string")
    documents = spark.createDataFrame([(1, "a", 3, 1), (2, "b", 3, 1), (3, "c", 3, 1), (4, "c", 1, 1), (5, "d", 3, None)], "document_id long, base_id string, index_status int, last_index_task_id long")
    scope = lambda wanted: [(r["base_id"], r["allowed"]) for r in filters.scope_of(bases, documents, "kb_chat", "SELECTED", wanted).collect()]
    assert scope(["c", "a", "d", "c"]) == [("c", [3]), ("a", [1])]
    with pytest.raises(ValueError, match="'x'"):
        scope(["a", "x"])
    with pytest.raises(ValueError):
        scope([])


def test_traces_of_a_run_are_written_anew(spark, tmp_path):
    rows = spark.createDataFrame([(1, "vector")], "question_id long, channel string")
    for run, found in (("a", rows), ("b", rows), ("b", rows.unionByName(rows))):
        writers.write_trace({"channel_executions": found}, str(tmp_path), run)
    assert {(r["run"], r["count"]) for r in writers.read_trace(spark, str(tmp_path), "channel_executions").groupBy("run").count().collect()} == {("a", 1), ("b", 2)}
    with pytest.raises(ValueError):
        writers.write_trace({"other": rows}, str(tmp_path), "a")


def test_copied_documents_keep_their_seeds(spark):
    one = [(1, "A", "TITLE", ""), (2, "Some text. " * 30, "TEXT", "A"), (3, "Some text. " * 30, "TEXT", "A"), (4, "B", "TITLE", ""), (5, "More words here! " * 20, "TEXT", "B")]
    rows = [(d, n, d * 100 + n, kind, text, path, f"/{path}/{n}", 1, "", "", "") for d in (1, 2, 3) for n, text, kind, path in one]
    blocks = spark.createDataFrame(rows, "document_id long, block_no long, block_id long, block_type string, text string, section_path string, canonical_path string, page_no int, page_range string, table_html string, image_caption string")
    for steps in (["STRUCTURE", "SEMANTIC"], ["RECURSIVE", "SEMANTIC"], ["STRUCTURE"]):
        seeds = lambda rows: sorted((r["document_id"], r["position"], r["text"]) for r in assembly.parent_seeds(rows, steps, 200).collect())  # noqa: B023, E731
        alone = [x[1:] for x in seeds(blocks.where("document_id = 1"))]
        assert alone and seeds(blocks) == sorted((d, *x) for d in (1, 2, 3) for x in alone)


def test_every_document_has_a_seed(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.01"
    filled = spark.read.parquet(f"{d}/documents.parquet").where(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")) != "").count()
    assert entry.queries()["parent_seeds"](spark, d).select("document_id").distinct().count() == filled


def test_citations_by_answer(spark):
    rows = [(1, 1, 1, "x"), (1, 1, 2, "y"), (1, 2, 1, "x"), (1, 2, 2, "z"), (2, 3, 1, "z"), (2, 3, 2, "x"), (2, 4, 1, None)]
    evidence = spark.createDataFrame(rows, "answer_id long, question_id long, position int, citation_key string")
    got = {(r["answer_id"], r["question_id"], r["citation_key"]): r["citation_id"] for r in retrieval.citation_ids(evidence, "answer_id").collect()}
    assert got == {(1, 1, "x"): 1, (1, 1, "y"): 2, (1, 2, "x"): 1, (1, 2, "z"): 3, (2, 3, "z"): 1, (2, 3, "x"): 2}


def test_routes_are_filled_by_name(spark):
    scored = spark.createDataFrame([(1, 3, 20.0), (1, 1, 15.0), (2, 9, 30.0)], "question_id long, candidate int, score double")
    allowed = spark.createDataFrame([(c,) for c in (4, 1, 2, 3, 9, 4)], "candidate int")
    got = sorted(tuple(r) for r in routing.expand_low(scored, allowed, "question_id", 4).select("question_id", "candidate", "score").collect())
    assert got == [(1, 1, 15.0), (1, 2, 0.0), (1, 3, 20.0), (1, 4, 0.0), (2, 1, 0.0), (2, 2, 0.0), (2, 3, 0.0), (2, 9, 30.0)]
    assert routing.expand_low(scored.limit(0), allowed, "question_id", 4).count() == 0
