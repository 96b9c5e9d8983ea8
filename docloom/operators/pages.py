"""Relational pages: chunk pages and details, document lists, dashboards, status counts, ordered and distinct lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T


def chunk_page(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """Chunks with their parent's number, title and size; unbound chunks keep nulls."""
    info = parents.select("document_id", "parent_no", F.col("title").alias("parent_title"), F.char_length("text").alias("parent_chars"))
    return chunks.join(info, ["document_id", "parent_no"], "left")


def chunk_detail(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """Each chunk with its parent's text and the ordered numbers of all chunks of that parent."""
    siblings = chunks.groupBy("document_id", "parent_no").agg(F.array_sort(F.collect_list("chunk_no")).alias("siblings"))
    own = chunks.join(parents.select("document_id", "parent_no", F.col("text").alias("parent_text")), ["document_id", "parent_no"], "left")
    return own.join(siblings, ["document_id", "parent_no"], "left")


def chunks_by_parent(chunks: DataFrame) -> DataFrame:
    """Chunk numbers by parent; chunks without a parent are a group of their own, last. Adds group_order in the document."""
    groups = chunks.groupBy("document_id", "parent_no").agg(F.array_sort(F.collect_list("chunk_no")).alias("chunk_nos"), F.count("*").alias("chunks"))
    return groups.withColumn("group_order", F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("parent_no").isNull(), "parent_no")))


def chunk_page_stats(chunks: DataFrame) -> DataFrame:
    """chunks: document_id, parent_no, vector_status, tokens. Distinct parents, vectors ready (status 2) and pending, mean tokens rounded."""
    return chunks.groupBy("document_id").agg(
        F.count_distinct("parent_no").alias("parents"), F.count_if(F.col("vector_status") == 2).alias("ready"), F.count_if(F.coalesce("vector_status", F.lit(0)) != 2).alias("pending"),
        F.floor(F.avg("tokens") + 0.5).cast("long").alias("avg_tokens"),
    )


def route_rows(documents: DataFrame, profiles: DataFrame, relations: DataFrame, topic: Column | int) -> DataFrame:
    """Documents with profile and, for one topic, the relation's score: two left joins."""
    of_topic = relations.where(F.col("topic_id") == topic).select("document_id", "relation_score")
    return documents.join(profiles, "document_id", "left").join(of_topic, "document_id", "left").withColumn("relation_score", F.coalesce("relation_score", F.lit(0.0)))


def preferred_topics(topics: DataFrame, scopes: DataFrame) -> DataFrame:
    """Topics with preferred = 1 where their scope is among the scopes."""
    flag = scopes.select("scope_id").distinct().withColumn("preferred", F.lit(1))
    return topics.join(flag, "scope_id", "left").withColumn("preferred", F.coalesce("preferred", F.lit(0)))


def relation_documents(relations: DataFrame, documents: DataFrame) -> DataFrame:
    """Relations with their document's fields, best first within a topic (score, then id, descending)."""
    order = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.col("relation_score").desc(), F.col("relation_id").desc()))
    return relations.join(documents, "document_id", "left").withColumn("position", order)


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    """COUNT(*) by keys: tasks by type and status, nodes or blocks by document, topics by scope, relations by topic."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def distinct_values(rows: DataFrame, key: str, value: str, where: Column | None = None) -> DataFrame:
    """Sorted distinct values of a key: object names, page numbers of tables or blocks."""
    rows = rows if where is None else rows.where(where)
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"))


def dashboard(documents: DataFrame) -> DataFrame:
    """One row: all documents and those with parse, strategy and index done (status 3)."""
    done = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(0)) == 3)
    return documents.agg(F.count("*").alias("documents"), done("parse_status").alias("parsed"), done("strategy_status").alias("planned"), done("index_status").alias("indexed"))


def document_page(documents: DataFrame, keyword: str, number: int = 1, size: int = 20) -> DataFrame:
    """A page of documents whose name or original file name holds the keyword, newest first."""
    from docloom.operators.admin import page

    found = documents if not keyword.strip() else documents.where(F.col("document_name").contains(keyword.strip()) | F.col("original_name").contains(keyword.strip()))
    return page(found, [F.col("update_time").desc(), F.col("document_id").desc()], number, size)


def ready_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles that are done (status 2)."""
    return profiles.where("profile_status = 2")


def trace_page(traces: DataFrame, session: int | None = None, mode: str | None = None, status: str | None = None) -> DataFrame:
    """Route traces filtered by the given ones of session, mode and status; what is null or blank filters nothing."""
    if session is not None:
        traces = traces.where(F.col("user_id") == session)
    if mode and mode.strip():
        traces = traces.where(F.col("mode") == mode)
    return traces.where(F.col("status") == status) if status and status.strip() else traces


def ordered(rows: DataFrame, key: str, order: list[Column], limit: int = 0) -> DataFrame:
    """Rows with their position in the key's list, at most `limit` of a key if it is above 0."""
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return rows.where(F.col("position") <= limit) if limit > 0 else rows


def first_distinct(rows: DataFrame, key: str, value: Column, order: list[Column], k: int) -> DataFrame:
    """The first k distinct non-blank values of each key in order; all for k <= 0: key, value, position."""
    firsts = rows.select(key, value.alias("value"), F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("at")).where(~T.is_blank(F.col("value")))
    return ordered(firsts.groupBy(key, "value").agg(F.min("at").alias("at")), key, [F.col("at")], k).select(key, "value", "position")


def last_by_key(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Map by key: the last value in order wins; rows without a key are dropped."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value))


def results_by_question(results: DataFrame) -> DataFrame:
    """Observed results grouped by question, then by channel: counts, best score and the chunks in rank order."""
    chunks = F.transform(F.array_sort(F.collect_list(F.struct("channel_rank", "chunk_id"))), lambda x: x["chunk_id"])
    return results.groupBy("question_id", "channel").agg(F.count("*").alias("n"), F.max("score").alias("best"), chunks.alias("chunks"))


def accepted_questions(results: DataFrame) -> DataFrame:
    """One row: questions with at least one selected result."""
    return results.where("reason = 'selected'").agg(F.count_distinct("question_id").alias("accepted"))


def graph_result(tree: DataFrame) -> DataFrame:
    """Each section with its parent's title, its neighbours' titles and its children in order."""
    title = tree.select("document_id", F.col("node_no").alias("other"), F.col("title").alias("other_title"))
    rows = tree.where("node_type = 'SECTION'")
    for name in ("parent", "prev", "next"):
        found = title.withColumnRenamed("other", f"{name}_no").withColumnRenamed("other_title", f"{name}_title")
        rows = rows.join(found, ["document_id", f"{name}_no"], "left")
    children = tree.groupBy("document_id", F.col("parent_no").alias("node_no")).agg(F.transform(F.array_sort(F.collect_list(F.struct("node_no", "title"))), lambda x: x["title"]).alias("children"))
    rows = rows.join(children, ["document_id", "node_no"], "left")
    return rows.select("document_id", "node_no", "title", "parent_title", "prev_title", "next_title", F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def with_node_ids(tree: DataFrame, first_id: int) -> DataFrame:
    """New ids for a document's nodes and, through them, the ids of parent, previous and next node (null where there is none)."""
    ids = tree.select("document_id", "node_no", (F.lit(first_id) + F.row_number().over(Window.partitionBy("document_id").orderBy("node_no")) - 1).alias("id"))
    rows = tree.join(ids.withColumnRenamed("id", "node_id"), ["document_id", "node_no"])
    for name in ("parent", "prev", "next"):
        rows = rows.join(ids.select("document_id", F.col("node_no").alias(f"{name}_no"), F.col("id").alias(f"{name}_id")), ["document_id", f"{name}_no"], "left")
    return rows
