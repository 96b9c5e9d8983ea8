"""Searches at size: postings, vectors and hits are dealt in bounded parts and made once."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom import catalogue
from docloom.operators import chunking, retrieval
from docloom.sources import keyword_index, parsers, section_index, vector_index
from tests.test_indexes import CHUNKS, brute, collection, found, same


def test_parts_and_deals_give_the_same_hits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_index, "PART_CHUNKS", 9)
    monkeypatch.setattr(keyword_index, "QUESTIONS", 2)
    monkeypatch.setattr(keyword_index, "BLOCK", 4)
    rows = collection(3, range(40))
    stored = keyword_index.add(keyword_index.create(spark, str(tmp_path / "i")), spark.createDataFrame(rows, CHUNKS))
    stored = keyword_index.delete(stored, spark.createDataFrame([(2,)], "document_id long"))
    left = [x for x in rows if x[0] != 2]
    r = random.Random(4)
    asked = {q: r.sample(["waa", "wba", "wca", "wda", "wea", "wfa"], 3) for q in range(7)}
    terms = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "question_id long, term string")
    allowed = {c for _, c, _ in left if c % 3}
    narrow = spark.createDataFrame([(c,) for c in allowed], "chunk_id long")
    assert stored.segments[0].parts > 5
    same(found(keyword_index.exhaustive(stored, terms, 4, narrow)), brute(left, asked, 4, allowed))
    same(found(keyword_index.pruned(stored, terms, 4, narrow).hits), brute(left, asked, 4, allowed))


def test_more_parts_give_no_more_candidates(spark, tmp_path, monkeypatch):
    r = random.Random(6)
    asked = {1: ["waa", "wba", "wca", "wda"]}
    rows = [(i, i, " ".join([t for t in asked[1] if r.random() < 0.5] + ["filler"] * r.randrange(1, 60))) for i in range(900)]
    terms = spark.createDataFrame([(1, t) for t in asked[1]], "question_id long, term string")
    written = []
    monkeypatch.setattr(keyword_index, "once", lambda rows, made=keyword_index.once: written.append(made(rows)) or written[-1])
    for size in (1000, 30):
        monkeypatch.setattr(keyword_index, "PART_CHUNKS", size)
        stored = keyword_index.add(keyword_index.create(spark, str(tmp_path / str(size))), spark.createDataFrame(rows, CHUNKS))
        same(found(keyword_index.pruned(stored, terms, 5).hits), brute(rows, asked, 5))
    # what is scored from the forward table
    _, many = [x.count() for x in written if x.columns == ["question_id", "segment", "chunk_id"]]
    assert stored.segments[0].parts == 30 and many < 200


def shuffled_bytes(spark):
    """Bytes that tasks have written to shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    every = context.statusStore().executorList(False)
    return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))


def test_a_term_is_not_shuffled_with_each_of_its_chunks(spark, tmp_path, monkeypatch):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(300)]
    rows = [(i, i, " ".join(r.sample(words, 60))) for i in range(3000)]
    asked = {q: r.sample(words, 4) for q in range(3)}
    terms = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "question_id long, term string")
    for parts in (1, 5):
        monkeypatch.setattr(keyword_index, "PART_CHUNKS", 3000 // parts)
        before = shuffled_bytes(spark)
        stored = keyword_index.add(keyword_index.create(spark, str(tmp_path / str(parts))), spark.createDataFrame(rows, CHUNKS).coalesce(2))
        assert shuffled_bytes(spark) - before < 4 * 60 * 3000 and stored.segments[0].parts == parts
        sizes = stored.blocks().select("part", F.explode("postings.chunk_id").alias("c")).groupBy("part").agg(F.count_distinct("c").alias("n")).collect()
        assert len(sizes) == parts and max(x["n"] for x in sizes) < 3000 // parts * 1.1
        same(found(keyword_index.search(stored, terms, 7)), brute(rows, asked, 7))


def test_updates_do_not_shuffle_what_stays(spark, tmp_path):
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(300)]
    rows = [(i // 2, i, " ".join(r.sample(words, 60))) for i in range(3000)]
    asked = {q: r.sample(words, 4) for q in range(3)}
    terms = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "question_id long, term string")
    stored = keyword_index.add(keyword_index.create(spark, str(tmp_path / "i")), spark.createDataFrame(rows, CHUNKS).coalesce(2))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_bytes(spark)
        for rest in (1, 4):
            stored = keyword_index.delete(stored, spark.range(rest, 1500, 30).select(F.col("id").alias("document_id")))
        # the forward rows have 180,000 terms, 12,000 of them in what is deleted
        assert shuffled_bytes(spark) - before < 200_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    left = [x for x in rows if x[0] % 30 not in (1, 4)]
    assert stored.chunks == len(left) and stored.live().count() == len(left)
    same(found(keyword_index.search(stored, terms, 7)), brute(left, asked, 7))


def test_postings_that_are_not_asked_stay_where_they_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_index, "FEW_POSTINGS", 0, raising=False)
    rows = [(i, i, f"rare{'ly' * (i % 50 == 0)} " + " ".join(f"other{i}x{j}" for j in range(40))) for i in range(300)]
    stored = keyword_index.add(keyword_index.create(spark, str(tmp_path / "i")), spark.createDataFrame(rows, CHUNKS))
    terms = spark.createDataFrame([(1, "rarely")], "question_id long, term string")
    plan = keyword_index.search(stored, terms)
    assert plan.count() == 6
    # one exchange of what was asked, by part, after the scan of the postings has met the asked terms
    tree = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in tree and "ShuffledHashJoin" not in tree


def test_every_benchmark_item_is_asked(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = [(i, " ".join(text for _, _, text in collection(i, [i])), "en", "s", 1) for i in range(60)]
    items = [(3, "waa wba wca waa"), (7, "WDA wea"), (20, "wba, wfa"), (33, None), (34, ""), (41, "nothing"), (7, "wga wea"), (None, "waa wha")]
    for name, rows, schema in (("documents", texts, "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        duckdb.execute(f"create or replace temp view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    asked = {3: ["waa", "wba", "wca"], 7: ["wda", "wea", "wga"], 20: ["wba", "wfa"], None: ["waa", "wha"]}
    chunks = [(r["doc_id"], r["chunk_id"], r["chunk_text"]) for r in catalogue.chunks(spark, str(tmp_path)).collect()]
    hits = catalogue.bm25_topk(spark, str(tmp_path))
    same(found(hits), brute(chunks, asked, 10))
    assert Counter(map(tuple, hits.collect())) == Counter(duckdb.execute(catalogue.ORACLES["bm25_topk"]).fetchall())


def test_questions_of_a_term_are_not_shuffled_with_each_block(spark, tmp_path):
    rows = [(i, i, f"common word{i % 7}") for i in range(20_000)]
    stored = keyword_index.add(keyword_index.create(spark, str(tmp_path / "i")), spark.createDataFrame(rows, CHUNKS))
    asked = {f"question {i * 7919 % 10007}": ["common", f"word{i % 9}"] for i in range(500)}
    terms = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "question_id string, term string")
    before = shuffled_bytes(spark)
    hits = found(keyword_index.search(stored, terms, 3))
    assert shuffled_bytes(spark) - before < 20 * len(rows)
    few = list(asked)[:9]
    same({q: hits[q] for q in few}, brute(rows, {q: asked[q] for q in few}, 3))
    assert len(hits) == 500


def test_channels_are_searched_once(spark):
    plan = catalogue.observed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "InArrow" not in plan


def test_routes_are_scored_once_and_terms_are_not_shuffled(spark):
    d = "/root/testdata/sf0.001"
    scored = catalogue.routed(spark, d)
    assert "Join" not in scored._jdf.queryExecution().optimizedPlan().toString()
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = catalogue.routed(spark, d)
        catalogue.MOST_BROADCAST, most = 0, catalogue.MOST_BROADCAST
        try:
            shuffled = catalogue.routed(spark, d)
        finally:
            catalogue.MOST_BROADCAST = most
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    rows = [sorted(map(tuple, x.collect())) for x in (scored, again, shuffled)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) > 50


def test_vectors_meet_in_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(retrieval, "QUESTION_BLOCK", 16)
    monkeypatch.setattr(retrieval, "SLICE", 5, raising=False)
    r = np.random.default_rng(1)
    vectors = r.integers(-2, 3, (300, 3)).astype(float)
    vectors[7] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "chunk_id long, vector array<double>")
    asked = rows.where("chunk_id % 5 = 2").select(F.col("chunk_id").alias("question_id"), F.col("vector").alias("query"))
    hits = retrieval.vector_hits(asked, rows, 6)
    norms = np.linalg.norm(vectors, axis=1)
    for q, got in found(hits).items():
        both = norms * norms[q]
        scores = np.round(np.divide(vectors @ vectors[q], both, out=np.zeros(300), where=both > 0), 6)
        order = np.lexsort((np.arange(300), -scores))[:6]
        assert got == [(i, scores[i]) for i in order.tolist()]
    assert hits.select("question_id").distinct().count() == 60
    assert "NestedLoop" not in hits._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in hits._jdf.queryExecution().executedPlan().toString()


def test_more_vectors_and_questions_are_shuffled_in_proportion(spark):
    def volume(n):
        vectors = np.random.default_rng(3).normal(size=(n, 32)).astype(np.float32)
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "chunk_id long, vector array<float>")
        asked = rows.where("chunk_id % 2 = 0").select(F.col("chunk_id").alias("question_id"), F.col("vector").alias("query"))
        before = shuffled_bytes(spark)
        hits = found(retrieval.vector_hits(asked, rows, 3))
        exact = vectors.astype(np.float64)
        norms = np.linalg.norm(exact, axis=1)
        for q in (0, n // 2 // 2 * 2):
            scores = np.round(exact @ exact[q] / (norms * norms[q]), 6)
            order = np.lexsort((np.arange(n), -scores))[:3]
            assert hits[q] == [(i, scores[i]) for i in order.tolist()]
        return shuffled_bytes(spark) - before

    small, large = volume(3000), volume(12_000)
    assert large < small * 6


def shuffled_rows(df):
    """Rows that the exchanges of a query's plan have written, as their metrics count them."""
    df.collect()

    def walk(node):
        kind = node.getClass().getSimpleName()
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if "QueryStage" in kind else []
        own = int(node.metrics().apply("shuffleRecordsWritten").value()) if kind == "ShuffleExchangeExec" else 0
        children = node.children()
        return own + sum(walk(x) for x in [*inner, *(children.apply(i) for i in range(children.size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def test_cells_meet_questions_in_groups(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(2)
    vectors = np.concatenate([r.normal(size=(1900, 6)), np.tile(r.normal(size=6), (100, 1))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "chunk_id long, vector array<double>")
    asked = rows.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("question_id"), F.col("vector").alias("query"))
    monkeypatch.setattr(vector_index, "PIECE_ROWS", 90)
    vector_index.write_vector_index(rows, str(tmp_path / "i"), k=5, cells=50)
    stored = vector_index.read_vector_index(spark, str(tmp_path / "i"))
    assert stored.pieces.max() > 1 and stored.rows.count() == 2000
    want = found(retrieval.vector_hits(asked, rows, 5))
    search = vector_index.vector_search(stored, asked, 5, probes=50)
    assert found(search) == want
    # 50 cells for each of 200 questions would be 10,000 rows there and 50,000 back
    assert shuffled_rows(search) < 2000 * 3 + 200 * 40
    for group, block, held in ((90, 30, 1000), (10, 1000, 1 << 21)):
        monkeypatch.setattr(vector_index, "GROUP_ROWS", group)
        monkeypatch.setattr(vector_index, "QUESTION_BLOCK", block)
        monkeypatch.setattr(vector_index, "HELD", held)
        assert found(vector_index.vector_search(stored, asked, 5, probes=50)) == want


def test_mean_score_is_added_from_the_best_down(spark):
    for scores in mean_cases():
        rows = spark.createDataFrame([(1, "vector", x, 1, "selected") for x in scores], "question_id long, channel string, score double, accepted int, reason string")
        total = 0.0
        for x in sorted(scores, reverse=True):
            total += x
        want = np.floor(total / len(scores) * 1e6 + 0.5) / 1e6
        assert retrieval.channel_stats(rows.coalesce(1)).first()["avg_score"] == want


def mean_cases(wanted=2):
    """Scores, worst first, whose mean is rounded another way if added in that order."""
    r, out = random.Random(8), []
    while len(out) < wanted:
        scores = sorted(r.randrange(300_000, 700_000) / 1e6 for _ in range(10))
        up, down = (sum_of(x) / 10 for x in (scores, scores[::-1]))
        if np.floor(up * 1e6 + 0.5) != np.floor(down * 1e6 + 0.5):
            out.append(scores)
    return out


def sum_of(scores):
    total = 0.0
    for x in scores:
        total += x
    return total


def test_texts_and_pages_leave_in_small_batches(spark):
    class Rows:
        """The function given to mapInArrow, called by hand."""

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["<p>one</p><p>two</p>"] * 1000)], ["id", "text"])
    for run in (chunking.chunk_by(Rows(), "semantic"), parsers.parse_html(Rows())):
        sizes = [b.num_rows for b in run(iter([batch]))]
        assert sum(sizes) >= 1000 and max(sizes) <= 400


def test_postings_of_sections_are_not_sorted(spark, tmp_path):
    rows = [(d, n, f"title {n}", "path", f"anchor {n}", f"body {d * 7 + n} of section {n}") for d in range(20) for n in range(1, 5)]
    section_index.write_section_index(spark.createDataFrame(rows, section_index.SECTIONS), str(tmp_path / "i"))
    stored = section_index.read_section_index(spark, str(tmp_path / "i"))
    asked = spark.createDataFrame([(d, d, f"body {d * 7 + 3} of", "") for d in range(20)], "question_id long, document_id long, question string, hint string")
    best = section_index.best_sections(stored, asked)
    plan = best._jdf.queryExecution().sparkPlan().toString()
    # grams and candidates are held, postings and texts stream past; postings are read once
    assert "ShuffledHashJoin" in plan and "LeftSemi" not in plan
    assert plan.count("node_no:int,gram:string") == 1
    assert {(r["question_id"], r["node_no"], r["score"]) for r in best.collect()} == {(d, 3, 30) for d in range(20)}
