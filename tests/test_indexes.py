"""The stored indexes: versions, deletes, merges and pruning of the keyword index; cells, bounds and recall of the vector index."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import blocks, retrieval
from docloom.plans.options import BM25_B, BM25_K1
from docloom.sources import index, keyword_index, parsers, section_index, vector_index

CHUNKS = "document_id long, chunk_id long, chunk_text string"


def collection(seed, documents, words=60):
    r = random.Random(seed)
    common = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(words)]
    text = lambda: " ".join(common[min(int(r.expovariate(0.12)), words - 1)] for _ in range(r.randrange(2, 40)))
    return [(d, d * 10 + c, text()) for d in documents for c in range(r.randrange(1, 4))]


def brute(rows, questions, k, allowed=None):
    """BM25 by hand: rows of (document, chunk, text), questions of id -> terms."""
    terms = {c: Counter((t or "").lower().split()) for _, c, t in rows}
    mean = sum(sum(x.values()) for x in terms.values()) / max(1, len(terms))
    df = Counter(t for x in terms.values() for t in x)
    out = {}
    for q, asked in questions.items():
        scores = []
        for c, x in terms.items():
            hit = [t for t in asked if t in x]
            if hit and (allowed is None or c in allowed):
                n = sum(x.values())
                parts = (math.log(1 + (len(terms) - df[t] + 0.5) / (df[t] + 0.5)) * x[t] * (BM25_K1 + 1) / (x[t] + BM25_K1 * (1 - BM25_B + BM25_B * n / mean)) for t in hit)
                scores.append((-round(sum(parts), 6), c))
        out[q] = [(c, -s) for s, c in sorted(scores)[:k]]
    return out


def found(hits):
    out = {}
    for r in hits.collect():
        out.setdefault(r["question_id"], []).append((r["chunk_id"], r["score"]))
    return {q: sorted(x, key=lambda y: (-y[1], y[0])) for q, x in out.items()}


def same(got, want):
    assert {q: [c for c, _ in x] for q, x in got.items()} == {q: [c for c, _ in x] for q, x in want.items() if x}
    assert all(s == pytest.approx(t, abs=2e-6) for q in got for (_, s), (_, t) in zip(got[q], want[q], strict=True))


@pytest.fixture
def questions(spark):
    asked = {1: ["waa", "wba", "wca", "wda"], 2: ["wab", "waa"], 3: ["nothing"], 4: ["wba"]}
    return asked, spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "question_id long, term string")


def test_replaced_and_deleted_documents(spark, tmp_path, questions):
    asked, terms = questions
    frame = lambda rows: spark.createDataFrame(rows, CHUNKS)
    rows = collection(1, range(40)) + [(40, 400, None), (41, 410, "  ")]
    stored = keyword_index.create(spark, str(tmp_path / "i"))
    assert found(keyword_index.search(stored, terms)) == {}
    for part in range(3):
        stored = keyword_index.add(stored, frame([x for x in rows if x[0] % 3 == part]))
    before = stored
    new = [(d, c, f"{t} waa") for d, c, t in collection(2, [3, 4, 50])]
    stored = keyword_index.replace(stored, frame(new))
    stored = keyword_index.delete(stored, spark.createDataFrame([(7,), (8,), (999,)], "document_id long"))
    left = [x for x in rows if x[0] not in (3, 4, 7, 8)] + new
    want = brute(left, asked, 5)
    assert stored.chunks == len(left)
    for hits in (keyword_index.exhaustive(stored, terms, 5), keyword_index.pruned(stored, terms, 5).hits):
        same(found(hits), want)
    allowed = {c for _, c, _ in left if c % 3}
    narrow = spark.createDataFrame([(c,) for c in allowed], "chunk_id long")
    for hits in (keyword_index.exhaustive(stored, terms, 5, narrow), keyword_index.pruned(stored, terms, 5, narrow).hits):
        same(found(hits), brute(left, asked, 5, allowed))
    # merging changes no hit, drops what is deleted, and readers keep their version
    merged = keyword_index.compact(stored)
    assert len(merged.segments) == 1 and merged.deletes == () and merged.forward().count() == len(left)
    same(found(keyword_index.search(merged, terms, 5)), want)
    same(found(keyword_index.search(before, terms, 5)), brute(rows, asked, 5))
    assert set(keyword_index.open_index(spark, stored.folder, before.version).segments) == set(before.segments)
    gone = keyword_index.vacuum(merged, keep=1)
    assert any(x.startswith("tombstones/") for x in gone) and keyword_index.versions(spark, stored.folder) == [merged.version]
    same(found(keyword_index.search(keyword_index.open_index(spark, stored.folder), terms, 5)), want)


def test_levels_are_merged_when_full(spark, tmp_path):
    stored = keyword_index.create(spark, str(tmp_path / "i"))
    for n in range(5):
        stored = keyword_index.add(stored, spark.createDataFrame(collection(n, [n]), CHUNKS))
    assert sorted(s.level for s in stored.segments) == [0, 1]


def test_pruning_reads_fewer_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_index, "BLOCK", 16)
    r = random.Random(5)
    rows = [(i, i, " ".join(["common"] * r.randrange(1, 4) + ["filler"] * r.randrange(1, 60) + (["rare"] * r.randrange(1, 3) if i % 97 == 0 else []))) for i in range(3000)]
    stored = keyword_index.add(keyword_index.create(spark, str(tmp_path / "i")), spark.createDataFrame(rows, CHUNKS))
    asked = {1: ["rare", "common", "filler"], 2: ["common"]}
    for question in (1, 2):
        terms = spark.createDataFrame([(question, t) for t in asked[question]], "question_id long, term string")
        search = keyword_index.pruned(stored, terms, 5)
        same(found(search.hits), brute(rows, {question: asked[question]}, 5))
        assert search.first.count() + search.read.count() < 0.2 * search.asked.count()


def test_other_tokens(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a b", "c"]), (2, ["c"]), (3, None)], "chunk_id long, tokens array<string>")
    stored = keyword_index.add(keyword_index.create(spark, str(tmp_path / "i")), rows)
    terms = spark.createDataFrame([(1, "a b")], "question_id long, term string")
    assert list(found(keyword_index.search(stored, terms))) == [1] and stored.chunks == 3


def test_a_changed_table_gets_a_new_index(spark, tmp_path):
    table, built = str(tmp_path / "t"), []
    spark.range(3).write.parquet(table)
    first = index.stored(spark, "x", table, built.append)
    assert index.stored(spark, "x", table, built.append) == first
    spark.range(4).write.mode("overwrite").parquet(table)
    assert index.stored(spark, "x", table, built.append) != first and len(built) == 2


# vectors


def read_folders(df):
    """Folders that the scans of a query's plan read, as the scan metrics count them."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.nodeName().startswith("Scan parquet") and node.metrics().contains("numPartitions"):
            out.append(int(node.metrics().apply("numPartitions").value()))
        inner = [node.executedPlan()] if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else [node.plan()] if "QueryStage" in node.getClass().getSimpleName() else []
        children = node.children()
        for x in [*inner, *(children.apply(i) for i in range(children.size()))]:
            walk(x)

    walk(plan)
    return out


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    folder = str(tmp_path_factory.mktemp("vectors") / "i")
    vector_index.write_vector_index(rows, folder)
    return rows, vector_index.read_vector_index(spark, folder)


def test_recall_of_the_tuned_probes(vectors):
    rows, stored = vectors
    asked = rows.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("question_id"), F.col("vector").alias("query"))
    pairs = lambda hits: {(r["question_id"], r["chunk_id"]): r["score"] for r in hits.collect()}
    want, got = pairs(retrieval.vector_hits(asked, rows)), pairs(vector_index.vector_search(stored, asked))
    assert stored.probes < len(stored.centres)
    assert len(got.keys() & want.keys()) >= 0.95 * len(want)
    assert pairs(vector_index.vector_search(stored, asked, probes=len(stored.centres))) == want


def test_only_probed_cells_are_read(vectors):
    rows, stored = vectors
    asked = rows.where("chunk_id = 60").select(F.col("chunk_id").alias("question_id"), F.col("vector").alias("query"))
    hits = vector_index.vector_search(stored, asked, probes=3)
    assert {r["chunk_id"] for r in hits.collect()} >= {60}
    assert read_folders(hits) == [3, 3]  # codes, then vectors


def test_odd_vectors_and_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "PIECE_ROWS", 7)
    r = np.random.default_rng(1)
    made = [(i, v.tolist()) for i, v in enumerate(np.concatenate([r.normal(size=(40, 5)), np.tile(r.normal(size=5), (30, 1)), np.zeros((2, 5))]))]
    rows = spark.createDataFrame(made + [(100, None), (101, [None] * 5), (102, [float("nan")] * 5), (103, [float("inf")] * 5)], "chunk_id long, vector array<double>")
    vector_index.write_vector_index(rows, str(tmp_path / "i"), k=4, cells=3)
    stored = vector_index.read_vector_index(spark, str(tmp_path / "i"))
    assert stored.rows.count() == 72 and stored.pieces.max() > 1
    asked = spark.createDataFrame([*made, (200, None)], "question_id long, query array<double>")
    pairs = lambda hits: sorted(map(tuple, hits.select("question_id", "chunk_id", "score").collect()))
    clean = spark.createDataFrame(made, "chunk_id long, vector array<double>")
    assert pairs(vector_index.vector_search(stored, asked, 4, probes=3)) == pairs(retrieval.vector_hits(spark.createDataFrame(made, "question_id long, query array<double>"), clean, 4))
    with pytest.raises(Exception, match="5 dimensions"):
        vector_index.vector_search(stored, spark.createDataFrame([(1, [1.0])], "question_id long, query array<double>"), 4).collect()


def test_empty_vector_index(spark, tmp_path):
    vector_index.write_vector_index(spark.createDataFrame([], "chunk_id long, vector array<double>"), str(tmp_path / "i"))
    stored = vector_index.read_vector_index(spark, str(tmp_path / "i"))
    assert vector_index.vector_search(stored, spark.createDataFrame([(1, [1.0])], "question_id long, query array<double>")).count() == 0


# sections


def test_best_sections_equal_brute_force(spark, tmp_path):
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abAB é中 ") for _ in range(n))
    rows = [(d, n, r.choice([None, "", text(4)]), text(6), r.choice([" ", text(5)]), r.choice([None, text(30)])) for d in range(6) for n in range(1, 12)]
    questions = [(q, q % 7, r.choice([None, " ", text(1), text(2), text(3), text(4)]), r.choice([None, "", text(1)])) for q in range(120)]
    want = {}
    for q, d, question, hint in questions:
        question, hint = (question or "").strip().lower(), (hint or "").strip().lower()
        if not question and not hint:
            continue
        for doc, node, *fields in sorted(rows, key=lambda x: x[1]):
            if doc != d:
                continue
            fields = [(f or "").lower() for f in fields]
            score = sum(w for f, w in zip(fields, (90, 70, 60, 30), strict=True) if f.strip() and question in f) + (25 if hint and any(hint in f for f in fields[:3]) else 0)
            if score >= 30 and score > want.get(q, (0, 0))[1]:
                want[q] = (node, score)
    section_index.write_section_index(spark.createDataFrame(rows, section_index.SECTIONS), str(tmp_path / "i"))
    stored = section_index.read_section_index(spark, str(tmp_path / "i"))
    found = section_index.best_sections(stored, spark.createDataFrame(questions, "question_id long, document_id long, question string, hint string")).collect()
    assert {x["question_id"]: (x["node_no"], x["score"]) for x in found} == want and len(want) > 40


def test_section_fields(spark):
    rows = [(1, 1, "TITLE", 1, "A"), (1, 2, "TITLE", 2, "B"), (1, 3, "Text", None, "t"), (1, 4, "Text", None, "u"), (1, 5, "TITLE", 2, "C")]
    fields = blocks.section_fields(blocks.structure_tree(spark.createDataFrame(rows, parsers.BLOCKS)))
    assert sorted(tuple(x)[1:] for x in fields.collect()) == [(1, "A", "A", "1 A", None), (2, "B", "A/B", "2 B", "t\nu"), (5, "C", "A/C", "5 C", None)]
