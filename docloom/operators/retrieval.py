"""Retrieval: keyword and vector channels, gates, fusion, elevation, observation. Many questions at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import vectors as V
from docloom.plans.options import RRF_K, Plan
from docloom.sources import keyword_index


keyword_hits = keyword_index.search


#: Vectors and questions in a block at most; a pair of blocks is multiplied in slices of so many questions, or of HELD scores if that is less.
VECTOR_BLOCK, QUESTION_BLOCK, SLICE, HELD = 65_536, 32_768, 256, 1 << 20
#: Blocks into which vectors are dealt, so that all cores have some, unless these would have less than LEAST of them.
SPREAD, LEAST = 16, 512


def _blocks(rows: DataFrame, size: int, spread: int = 1) -> int:
    n = rows.count()
    return max(1, -(-n // size), min(spread, n // LEAST))


def _as_given(rows: DataFrame, column: str) -> F.Column:
    """Vectors of floats are shuffled as they are; others as doubles."""
    return F.col(column) if rows.schema[column].dataType.simpleString() == "array<float>" else V.doubles(F.col(column))


def _dealt(rows: DataFrame, key: str, own: str, blocks: int, other: str, others: int) -> DataFrame:
    """Rows in blocks of about equal size, once for each block of the other side."""
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long")))
    return rows.withColumn(own, F.pmod(F.xxhash64(key), F.lit(blocks))).withColumn(other, every)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _best_of_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the best k of each row, ties to smaller ids; NaN is above all numbers, as in SQL."""
    value = np.where(np.isnan(scores), np.inf, scores)
    n = value.shape[1]
    row, column = np.nonzero(value >= (np.partition(value, n - k, axis=1)[:, n - k, None] if n > k else -np.inf))
    order = np.lexsort((ids[column], -value[row, column], row))
    row, column = row[order], column[order]
    starts = np.searchsorted(row, np.arange(len(value)))
    kept = np.arange(len(row)) - starts[row] < k
    return row[kept], column[kept]


def vector_hits(queries: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """Exact cosine top-k: question_id, chunk_id, score. queries: (question_id, query), corpus: (chunk_id, vector).

    Questions and vectors meet in blocks; each pair of blocks is a group of its own and gives the best k of every
    question, so no task holds more than a pair, and what is shuffled after that is k rows for each question and block.
    Up to SPREAD * VECTOR_BLOCK vectors and QUESTION_BLOCK questions there are no more blocks with more rows, so the shuffle
    grows as they do; beyond that it grows with their product, by one block's size.
    Vectors of length 0 score 0.
    """
    of_question, of_vector = _blocks(queries, QUESTION_BLOCK), _blocks(corpus, VECTOR_BLOCK, SPREAD)
    q = _dealt(queries.select("question_id", _as_given(queries, "query").alias("query")), "question_id", "of_question", of_question, "of_vector", of_vector)
    c = _dealt(corpus.select("chunk_id", _as_given(corpus, "vector").alias("vector")), "chunk_id", "of_vector", of_vector, "of_question", of_question)

    def best(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found = [pa.table({"question_id": pa.array([], pa.int64()), "chunk_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        if k > 0 and asked.num_rows and rows.num_rows:
            ids, chunks = asked.column("question_id").to_numpy(), rows.column("chunk_id").to_numpy()
            left, right = _matrix(asked.column("query")), _matrix(rows.column("vector"))
            sizes = np.linalg.norm(right, axis=1)
            few = max(1, min(SLICE, HELD // len(chunks)))
            for at in range(0, len(ids), few):
                part = left[at : at + few]
                norms = np.linalg.norm(part, axis=1)[:, None] * sizes[None, :]
                scores = np.round(np.divide(part @ right.T, norms, out=np.zeros(norms.shape), where=norms != 0), 6)
                row, column = _best_of_rows(scores, chunks, k)
                found.append(pa.table({"question_id": ids[at : at + few][row].astype(np.int64), "chunk_id": chunks[column].astype(np.int64), "score": scores[row, column]}))
        return pa.concat_tables(found)

    key = ["of_question", "of_vector"]
    found = q.groupBy(key).cogroup(c.groupBy(key)).applyInArrow(best, "question_id long, chunk_id long, score double")
    return top_k(found, ["question_id"], k)


def top_k(rows: DataFrame, keys: list[str], k: int, order=None) -> DataFrame:
    order = order or [F.col("score").desc(), F.col("chunk_id")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k).drop("rank")


def vector_gate(hits: DataFrame, minimum: float) -> DataFrame:
    return hits.where(F.col("score") >= minimum)


def keyword_gate(hits: DataFrame, floor: float) -> DataFrame:
    """Keeps score >= best * floor of each question; none where the best is not above 0."""
    best = F.max("score").over(Window.partitionBy("question_id"))
    return hits.withColumn("best", best).where((F.col("best") > 0) & (F.col("score") >= F.col("best") * floor)).drop("best")


def gated_channels(hits: dict[str, DataFrame], plan: Plan) -> DataFrame:
    """The enabled channels' gated hits as one bag: question_id, channel, chunk_id, score."""
    out = None
    for channel in plan.enabled():
        if channel.name not in hits:
            continue
        kept = hits[channel.name]
        if channel.minimum_score:
            kept = vector_gate(kept, channel.minimum_score)
        if channel.relative_floor:
            kept = keyword_gate(kept, channel.relative_floor)
        # a sum hides how the channels are partitioned: Spark 4.1 else zips the union's parts, which adaptive execution may have coalesced differently
        kept = kept.select((F.col("question_id") + 0).alias("question_id"), F.lit(channel.name).alias("channel"), "chunk_id", "score")
        out = kept if out is None else out.unionByName(kept)
    if out is None:
        raise ValueError("no enabled channel has hits")
    return out


def fuse(bag: DataFrame, plan: Plan, source_type: DataFrame | None = None) -> DataFrame:
    """Weighted reciprocal-rank fusion: question_id, chunk_id, rrf, fused_score, channel."""
    weights = F.create_map(*[F.lit(x) for c in plan.channels for x in (c.name, max(0.0, c.rank_weight))])
    originals = F.create_map(*[F.lit(x) for c in plan.channels for x in (c.name, max(0.0, c.original_weight))])
    in_channel = Window.partitionBy("question_id", "channel")
    rank0 = F.row_number().over(in_channel.orderBy(F.col("score").desc(), "chunk_id")) - 1
    best = F.greatest(F.lit(0.0), F.max("score").over(in_channel))
    rows = bag.withColumns({"rrf_part": 1.0 / (RRF_K + rank0 + 1), "norm": F.when(best > 0, F.least(F.lit(1.0), F.col("score") / best)).otherwise(0.0)})
    if source_type is None:
        rows = rows.withColumn("boost", F.lit(0.0))
    else:
        kind = F.lower("source_type")
        rows = rows.join(source_type, "chunk_id", "left").withColumn("boost", F.when(kind == "table", 0.03).when(kind.isin("image", "figure"), 0.02).otherwise(0.0))
    found = rows.groupBy("question_id", "chunk_id").agg(
        F.sum("rrf_part").alias("rrf"),
        F.sum(weights[F.col("channel")] * (RRF_K + 1) * F.col("rrf_part")).alias("by_rank"),
        F.sum(originals[F.col("channel")] * F.col("norm")).alias("by_score"),
        F.max("boost").alias("boost"),
        F.array_sort(F.collect_set("channel")).alias("channels"),
    )
    score = F.col("by_rank") + F.col("by_score") + max(0.0, plan.boost_weight) * F.least("boost", F.lit(max(0.0, plan.max_boost)))
    label = F.when(F.size("channels") > 1, "hybrid").otherwise(F.get("channels", 0))
    return found.select("question_id", "chunk_id", F.round("rrf", 6).alias("rrf"), F.round(score, 6).alias("fused_score"), label.alias("channel"))


def candidates(fused: DataFrame, k: int) -> DataFrame:
    """The candidate window: the best k of each question; none for k <= 0."""
    return top_k(fused, ["question_id"], max(0, k), [F.col("fused_score").desc(), F.col("chunk_id")])


def final_hits(candidates: DataFrame, k: int) -> DataFrame:
    """The best k of each question with final_rank from 1."""
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("fused_score").desc(), "chunk_id"))
    return candidates.select("question_id", "chunk_id", "fused_score", "channel", rank.alias("final_rank")).where(F.col("final_rank") <= k)


def elevate(fused: DataFrame, child_parent: DataFrame) -> DataFrame:
    """Fused children (question_id, chunk_id, fused_score, channel) to parents: max * (1 + min(.36, .12 * (n - 1)) + .10 if more than one channel).

    child_parent: chunk_id, parent_id. Children without a parent pass as they are.
    """
    joined = fused.join(child_parent, "chunk_id", "left")
    parent = F.coalesce(F.col("parent_id").cast("string"), F.concat(F.lit("orphan-"), F.col("chunk_id").cast("string")))
    n, channels = F.count("*"), F.count_distinct("channel")
    score = F.max("fused_score") * (1 + F.least(F.lit(0.36), 0.12 * (n - 1)) + F.when(channels > 1, 0.10).otherwise(0.0))
    return joined.withColumn("parent_key", parent).groupBy("question_id", "parent_key").agg(
        F.round(score, 6).alias("score"), n.alias("child_count"), F.max_by("chunk_id", F.struct(F.col("fused_score"), -F.col("chunk_id"))).alias("best_child"),
        F.when(channels > 1, "hybrid").otherwise(F.min("channel")).alias("channel"), F.min("chunk_id").alias("first_child"),
    )


def ranked_parents(parents: DataFrame) -> DataFrame:
    """Adds parent_rank: score descending, then parent (its first chunk) and chunk number ascending."""
    return parents.withColumn("parent_rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("score").desc(), "first_child", "best_child")))


SNIPPET = 140


def parent_evidence(children: DataFrame, limit: int) -> DataFrame:
    """children: question_id, parent_key, parent_text, chunk_no, chunk_text. One text a parent: its own, then its hit children by number."""
    lines = F.array_sort(F.collect_list(F.struct("chunk_no", T.clip_head(F.col("chunk_text"), SNIPPET).alias("snippet"))))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- child#"), x["chunk_no"].cast("string"), F.lit("："), x["snippet"])), "\n")
    whole = F.concat(F.lit("[父块内容]\n"), T.trimmed(F.first("parent_text")), F.lit("\n\n[命中子片段]\n"), listed)
    return children.groupBy("question_id", "parent_key").agg(T.clip_head(whole, max(1, limit)).alias("evidence"))


def reranked(candidates: DataFrame, relevance: DataFrame, top_n: int, enabled: bool = True) -> DataFrame:
    """Candidates with the scores of a reranker (question_id, position -> relevance) filled in by position, the best top_n of each question.

    Without a reranker, or where it gives a question nothing, the order and scores stay; positions it does not name are dropped.
    """
    if not enabled:
        return candidates.withColumn("rerank_score", F.lit(None).cast("double"))
    given = relevance.select("question_id").distinct().withColumn("has", F.lit(True))
    rows = candidates.join(relevance, ["question_id", "position"], "left").join(given, "question_id", "left").where("relevance is not null or has is null")
    order = Window.partitionBy("question_id").orderBy(F.col("relevance").desc_nulls_last(), "position")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n).withColumnRenamed("relevance", "rerank_score").drop("rank", "has")


def observe(bag: DataFrame, gated: DataFrame, fused: DataFrame, final_k: int) -> DataFrame:
    """A row for each raw hit with its ranks and the reason it was dropped or selected."""
    per_channel = F.row_number().over(Window.partitionBy("question_id", "channel").orderBy(F.col("score").desc(), "chunk_id"))
    by_fusion = F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("fused_score").desc(), "chunk_id"))
    ranked = fused.select("question_id", "chunk_id", "fused_score", by_fusion.alias("rrf_rank"))
    kept = gated.select("question_id", "channel", "chunk_id", F.lit(1).alias("accepted"))
    rows = bag.withColumn("channel_rank", per_channel).join(kept, ["question_id", "channel", "chunk_id"], "left").join(ranked, ["question_id", "chunk_id"], "left")
    accepted = F.coalesce("accepted", F.lit(0))
    return rows.select(
        "question_id", "channel", "chunk_id", "score", "channel_rank", accepted.alias("accepted"), F.when(accepted == 1, F.col("rrf_rank")).alias("rrf_rank"),
        F.when((accepted == 1) & (F.col("rrf_rank") <= final_k), F.col("rrf_rank")).alias("final_rank"),
        F.when(accepted == 0, "below_gate").when(F.col("rrf_rank") > final_k, "below_top_k").otherwise("selected").alias("reason"),
    )


def channel_stats(observed: DataFrame) -> DataFrame:
    """Recalled, accepted and selected counts and the score range of each question's channels.

    A mean adds the scores from the best down and is rounded as a number of millionths, as in SQL: of scores with six
    digits every other mean of ten ends in a half, which another order of the sum would round the other way.
    """
    scores = F.sort_array(F.collect_list("score"), asc=False)
    mean = F.try_divide(F.aggregate(scores, F.lit(0.0), lambda total, x: total + x), F.size(scores))
    return observed.groupBy("question_id", "channel").agg(
        F.count("*").alias("recalled"), F.sum("accepted").alias("accepted"), F.count_if(F.col("reason") == "selected").alias("selected"),
        (F.round(mean * 1e6) / 1e6).alias("avg_score"), F.max("score").alias("max_score"), F.min("score").alias("min_score"),
    )


def citation_ids(evidence: DataFrame, answer: str = "question_id") -> DataFrame:
    """Adds citation_id: dense numbers of an answer's citation keys in the order first seen over its questions and their positions.

    answer names the column that tells answers apart; answers are independent. Rows of an answer without a key get none.
    """
    first = evidence.where("citation_key is not null").groupBy(answer, "citation_key").agg(F.min(F.struct("question_id", "position")).alias("first"))
    numbered = first.select(answer, "citation_key", F.row_number().over(Window.partitionBy(answer).orderBy("first", "citation_key")).alias("citation_id"))
    return evidence.join(numbered, [answer, "citation_key"])
