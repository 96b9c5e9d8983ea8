"""Entry functions by area: chat (search and answer context), documents (parse, chunk, index), knowledge (scope and route)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import assembly, blocks, chunking, conversation, filters, planning, profiles, retrieval, routing
from docloom.plans import registry
from docloom.plans.options import QUESTION_BUDGET, TOTAL_BUDGET, Plan
from docloom.plans.registry import told
from docloom.sources import keyword_index, parsers, vector_index, writers


# Chat.


def search(
    questions: DataFrame, stored: keyword_index.KeywordIndex, vectors: DataFrame | vector_index.VectorIndex | None = None, plan: Plan | None = None, allowed: DataFrame | None = None,
    lexical: str = "bm25", tokeniser: str = "latin_han", embedder: str = "hashed",
) -> DataFrame:
    """questions: question_id, question. The final hits of every question over the channels of the plan.

    stored: the keyword index; vectors: chunk_id, vector, or a vector index, which is searched by cells; allowed: the
    chunk_ids of the request's scope. Questions without a `query` get one from the embedder. lexical, tokeniser and embedder are names of the registry.
    """
    plan = plan or Plan()
    terms = questions.select("question_id", F.explode(F.array_distinct(registry.TOKENISERS.get(tokeniser)(F.col("question")))).alias("term"))
    top_k = {c.name: c.top_k for c in plan.channels}
    hits = {"keyword": told("keyword", registry.LEXICAL.get(lexical)(stored, terms, top_k.get("keyword", 10), allowed))}
    if vectors is not None:
        asked = questions if "query" in questions.columns else questions.withColumn("query", registry.EMBEDDERS.get(embedder)(F.col("question")))
        asked, k = asked.select("question_id", "query"), top_k.get("vector", 10)
        if isinstance(vectors, vector_index.VectorIndex):
            # a scope may lie anywhere, so all cells are probed within it
            found = vector_index.vector_search(vectors, asked, k, None if allowed is None else len(vectors.centres), allowed)
        else:
            within = vectors if allowed is None else vectors.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
            found = retrieval.vector_hits(asked, within, k)
        hits["vector"] = told("vector", found)
    fused = retrieval.fuse(retrieval.gated_channels(hits, plan), plan)
    return told("final", retrieval.final_hits(retrieval.candidates(fused, plan.candidates), plan.final_top_k))


def rerank(candidates: DataFrame, relevance: DataFrame, top_n: int, reranker: str = "by_position") -> DataFrame:
    """Candidates in the order of a reranker of the registry."""
    return told("reranked", registry.RERANKERS.get(reranker)(candidates, relevance, top_n))


def answer_context(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The evidence of each question that fits its budget, with citation numbers: question_id, position, chunk_id, citation_id, chunk_text."""
    found = hits.join(chunks.select("chunk_id", "chunk_text"), "chunk_id").withColumn("position", F.col("final_rank"))
    sizes = found.select(F.col("question_id").alias("answer_id"), F.lit(0).cast("long").alias("question_no"), "position", F.char_length("chunk_text").cast("long").alias("size"))
    fits = conversation.evidence_budget(sizes, TOTAL_BUDGET, QUESTION_BUDGET).where("rendered").select(F.col("answer_id").alias("question_id"), "position")
    cited = retrieval.citation_ids(found.join(fits, ["question_id", "position"]).withColumn("citation_key", F.col("chunk_id").cast("string")))
    return cited.select("question_id", "position", "chunk_id", "citation_id", "chunk_text")


def understand(questions: DataFrame, recogniser: str = "rules") -> DataFrame:
    """Questions with their intent, date and search flags, anchors and metadata hints."""
    none = F.array().cast("array<string>")
    return registry.RECOGNISERS.get(recogniser)(questions).withColumns(planning.metadata_hints(F.col("question"), none))


def conversation_memory(turns: DataFrame, keep: int = 3, strategy: str = "window") -> DataFrame:
    return registry.MEMORIES.get(strategy)(turns, keep)


# Documents.


def parse(docs: DataFrame, kind: str) -> DataFrame:
    """Blocks of documents of a file type."""
    return parsers.parser_for(kind)(docs)


def structure(parsed: DataFrame) -> DataFrame:
    return blocks.with_siblings(blocks.structure_tree(parsed))


def plan_strategy(parsed: DataFrame) -> DataFrame:
    return chunking.recommend_strategy(blocks.stats(parsed))


def build_parents(rows: DataFrame, steps: list[str], limit: int = chunking.RECURSIVE_MAX) -> DataFrame:
    return assembly.parent_seeds(rows, steps, limit)


def profile(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    return profiles.profiles(documents, nodes)


def build_index(chunks: DataFrame, folder: str) -> keyword_index.KeywordIndex:
    """Writes the keyword index of chunks (document_id, chunk_id, chunk_text) and opens it."""
    return keyword_index.add(keyword_index.create(chunks.sparkSession, folder), chunks)


def reindex(stored: keyword_index.KeywordIndex, chunks: DataFrame) -> keyword_index.KeywordIndex:
    """The next version of the index, in which these chunks are all that their documents have."""
    return keyword_index.replace(stored, chunks)


def remove_from_index(stored: keyword_index.KeywordIndex, documents: DataFrame) -> keyword_index.KeywordIndex:
    return keyword_index.delete(stored, documents)


def store_chunks(chunks: DataFrame, path: str) -> None:
    writers.write_index(chunks, path)


def delete_documents(tables: dict[str, DataFrame], documents: DataFrame) -> dict[str, DataFrame]:
    return writers.without_documents(tables, documents)


# Knowledge.


def scope(bases: DataFrame, documents: DataFrame, chat_mode: str, selection: str, wanted: list[str] | None = None) -> DataFrame:
    return filters.scope_of(bases, documents, chat_mode, selection, wanted)


def score_routes(features: DataFrame, scorer: str = "weighted") -> DataFrame:
    """features: question_id, candidate, semantic, lexical, relation. The scores of a scorer of the registry: question_id, candidate, score."""
    parts = [F.col(x) for x in ("semantic", "lexical", "relation")]
    return features.select("question_id", "candidate", F.round(registry.SCORERS.get(scorer)(*parts), 6).alias("score"))


def route(scored: DataFrame, allowed: DataFrame, k: int = routing.TOP_DOCUMENTS) -> DataFrame:
    """scored: question_id, candidate, score. The k best candidates; questions below the confidence bound are filled up from allowed (candidate)."""
    best = routing.ranked(scored, k)
    low = routing.confidence(scored, "question_id").where("status <> 'SUCCESS'").select("question_id")
    filled = routing.expand_low(best.join(low, "question_id", "left_semi"), allowed, "question_id", k)
    sure = best.join(low, "question_id", "left_anti").select("question_id", "candidate", "score")
    return sure.unionByName(filled.select("question_id", "candidate", "score"))


def options(configs: DataFrame, defaults: dict[str, str]) -> DataFrame:
    return routing.merge_options(configs, defaults)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return parsers.read_files(spark, path)
