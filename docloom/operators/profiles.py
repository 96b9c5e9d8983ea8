"""Document profiles: section titles, topics, sample questions, summary, type, category and scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T

TITLES, TOPICS, EXCERPT, SUMMARY_TITLES = 8, 6, 180, 4
# Words that tell a document's type, in the order they are looked for, and its sample question.
TYPES = [("faq", ["faq", "常见问题"]), ("troubleshooting", ["故障", "排查", "检查顺序"]), ("rule", ["规则", "制度"]), ("spec", ["规格", "参数"])]
MANUAL = ["手册", "指南", "部署"]
QUESTIONS = {"troubleshooting": "的可能原因有哪些？", "manual": "的步骤是什么？", "rule": "有哪些规则？"}
OTHER_QUESTION = "是什么意思？"
# Words that tell a document's scope, in the order they are looked for.
SCOPES = [
    ("operation_rule", ["上线观察", "值班规则", "观察时长", "运营"]),
    ("robot_strategy", ["机器人", "知识召回", "意图识别", "策略设计"]),
    ("deployment", ["安装", "部署", "默认密码", "访问地址"]),
    ("troubleshooting", ["故障", "排查", "异常", "检查顺序"]),
    ("product", ["产品简介", "核心特性", "技术规格", "产品概述"]),
]
CATEGORIES = {"troubleshooting": "故障排查", "rule": "规则", "spec": "规格说明"}
STEPS = ["步骤", "操作", "部署"]


def document_type(text: Column, has_items: Column) -> Column:
    out = F.when(T.contains_any(text, TYPES[0][1]), TYPES[0][0])
    for name, found in TYPES[1:]:
        out = out.when(T.contains_any(text, found), name)
    return out.when(has_items | T.contains_any(text, MANUAL), "manual").otherwise("intro")


def scope_code(text: Column) -> Column:
    out = F.when(T.contains_any(text, SCOPES[0][1]), SCOPES[0][0])
    for name, found in SCOPES[1:]:
        out = out.when(T.contains_any(text, found), name)
    return out.otherwise("general")


def business_category(kind: Column, text: Column) -> Column:
    out = F.when(kind == "manual", F.when(T.contains_any(text, STEPS), "操作手册").otherwise("手册"))
    for name, category in CATEGORIES.items():
        out = out.when(kind == name, category)
    return out.otherwise("介绍")


def sample_question(kind: Column, topic: Column) -> Column:
    ending = F.create_map(*[F.lit(x) for pair in QUESTIONS.items() for x in pair])
    return F.concat(topic, F.coalesce(ending[kind], F.lit(OTHER_QUESTION)))


def profiles(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """documents: document_id, document_name, text. nodes: document_id, node_no, node_type, title. One profile a document."""
    titled = nodes.where("node_type = 'SECTION'").select("document_id", "node_no", T.trimmed(F.col("title")).alias("title")).where("title <> ''")
    titles = titled.groupBy("document_id").agg(F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("node_no", "title"))), lambda x: x["title"])), 1, TITLES).alias("titles"))
    items = nodes.groupBy("document_id").agg(F.max(F.col("node_type").isin("STEP", "LIST_ITEM").cast("int")).alias("items"))
    rows = documents.join(titles, "document_id", "left").join(items, "document_id", "left")
    rows = rows.withColumn("titles", F.coalesce("titles", F.array().cast("array<string>"))).withColumn("items", F.coalesce("items", F.lit(0)))
    name = T.trimmed(F.coalesce("document_name", F.lit("")))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    topics = F.transform(F.filter(F.concat("titles", F.array(stem)), lambda x: x != ""), lambda x: T.trimmed(F.regexp_replace(x, r"^[0-9]+(\.[0-9]+)*[.、\s]*", "")))
    rows = rows.withColumn("topics", F.slice(F.array_distinct(topics), 1, TOPICS)).withColumn("body", F.concat(name, F.array_join("titles", " "), T.trimmed(F.coalesce("text", F.lit("")))))
    rows = rows.withColumn("document_type", document_type(F.col("body"), F.col("items") > 0))
    excerpt = F.substring(T.compact(F.coalesce("text", F.lit(""))), 1, EXCERPT)
    covered = F.when(F.size("titles") > 0, F.concat(F.lit("主要涵盖："), F.array_join(F.slice("titles", 1, SUMMARY_TITLES), "、"), F.lit("。"))).otherwise("")
    summary = F.concat(F.lit("文档《"), T.blank_to_default(name, F.lit("未命名文档")), F.lit("》"), covered, F.when(excerpt != "", F.concat(F.lit("摘要："), excerpt)).otherwise(""))
    return rows.select(
        "document_id", "document_type", "topics", F.transform("topics", lambda x: sample_question(F.col("document_type"), x)).alias("questions"), T.trimmed(summary).alias("summary"),
        scope_code(F.col("body")).alias("scope_code"), business_category(F.col("document_type"), F.col("body")).alias("category"),
        (F.size("titles") >= 2).cast("int").alias("supports_outline"), F.col("items").alias("supports_items"), ((F.size("titles") >= 2) & (F.col("items") > 0)).cast("int").alias("graph_friendly"),
    )


def derived_topics(found: DataFrame, scores: DataFrame, k: int = 8) -> DataFrame:
    """Topics taken from profiles when no topic is set up: question_id, topic, score - the best of the documents that name it, the k best of a question.

    scores: question_id, document_id, score.
    """
    from docloom.operators.retrieval import top_k

    named = found.select("document_id", F.explode("topics").alias("topic"))
    best = named.join(scores, "document_id").groupBy("question_id", "topic").agg(F.max("score").alias("score"))
    return top_k(best, ["question_id"], k, [F.col("score").desc(), F.col("topic")])
