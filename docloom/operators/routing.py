"""Routing and query understanding: scores, confidence, splitting, intent rules, option merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

# Weights and bounds of the route score.
SEMANTIC_BASE, SEMANTIC_SCALE = 0.20, 50
LEXICAL_SCALE, LEXICAL_BOUND = 1.6, 10
RELATION_WEIGHT, DOCUMENT_RELATION_WEIGHT = 8, 20
LOW_CONFIDENCE = 0.55
# Phrases of structure navigation and of dates.
ADJACENT = ["上一节", "下一节", "前一节", "后一节", "上一章", "下一章", "相邻章节", "同一一级章节"]
LOCATION = ["属于哪个章节", "哪个章节", "哪个小节", "哪一节", "哪一章", "章节位置"]
OUTLINE = ["包含哪些章节", "都包含哪些章节", "有哪些章节", "有哪些小节", "包含哪些小节", "章节列表", "小节列表", "子章节", "子小节", "下级章节", "展开目录", "列出目录"]
SECTION_CODE = r"[0-9]+(?:\.[0-9]+)+"
CHINESE_SECTION = r"第\s*[0-9一二三四五六七八九十百]+\s*(?:章|节|小节)"
QUOTED = "[“\"']([^”\"']{2,40})[”\"']"
EXPLICIT_DATE = r"([0-9]{4}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}日?)|([0-9]{1,2}月[0-9]{1,2}日)"
RELATIVE_TIME = ["今天", "今日", "明天", "明日", "昨天", "昨日", "后天", "前天", "现在", "当前", "目前", "此刻", "实时", "最新", "刚刚", "本周", "这周", "本月", "这个月", "今年", "本年度", "本季度", "周几", "星期几", "几号", "日期", "几月几号"]
REAL_TIME = [
    "天气", "气温", "温度", "降雨", "下雨", "下雪", "空气质量", "aqi", "限号", "限行", "尾号限行", "汇率", "金价", "黄金价格", "银价", "油价", "股价", "行情", "大盘", "指数",
    "新闻", "头条", "热搜", "热榜", "路况", "拥堵", "票房", "排片", "航班", "班次", "列车", "高铁", "火车", "地铁运营", "比分", "赛果", "赛程", "比赛结果", "预警", "台风",
]
CALENDAR = ["周几", "星期几", "几号", "日期", "几月几号", "星期", "周"]
HISTORICAL = ["历史", "过去", "去年", "前年", "上周", "上个月", "上月", "上一周", "上一月", "往年", "历年", "当时", "之前", "回顾", "曾经"]
NOW = ["最新", "实时", "当前", "现在", "目前", "刚刚"]
# How many scopes, derived topics and documents a route keeps.
TOP_SCOPES, TOP_DERIVED, TOP_DOCUMENTS = 5, 8, 5


def route_score(semantic: Column, lexical: Column, relation: Column, weight: float = RELATION_WEIGHT) -> Column:
    main = F.when(semantic > SEMANTIC_BASE, (semantic - SEMANTIC_BASE) * SEMANTIC_SCALE).otherwise(0.0)
    assist = F.when(lexical > 0, F.least(lexical * LEXICAL_SCALE, F.lit(float(LEXICAL_BOUND)))).otherwise(0.0)
    return main + assist + relation * weight


def route_source(semantic: Column, lexical: Column, relation: Column) -> Column:
    parts = F.array_compact(F.array(F.when(semantic > SEMANTIC_BASE, F.lit("SEMANTIC")), F.when(lexical > 0, F.lit("LEXICAL")), F.when(relation > 0, F.lit("RELATION"))))
    return F.when(F.size(parts) > 1, "COMPOSITE").when(F.size(parts) == 1, F.get(parts, 0)).otherwise("NONE")


def confidence(scored: DataFrame, key: str) -> DataFrame:
    """Confidence of each key's best candidate and the route status."""
    ranked = scored.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "candidate"))).where("n <= 2")
    tops = ranked.groupBy(key).agg(F.max(F.when(F.col("n") == 1, F.col("score"))).alias("top1"), F.coalesce(F.max(F.when(F.col("n") == 2, F.col("score"))), F.lit(0.0)).alias("top2"))
    value = F.when(F.col("top1") <= 0, 0.0).otherwise(F.col("top1") / F.greatest(F.lit(10.0), F.col("top1") + F.col("top2") + 5))
    return tops.withColumn("confidence", F.round(value, 6)).withColumn("status", F.when(F.col("confidence") <= 0, "FAILED").when(F.col("confidence") < LOW_CONFIDENCE, "LOW_CONFIDENCE").otherwise("SUCCESS"))


def expand_low(scored: DataFrame, allowed: DataFrame, key: str, limit: int) -> DataFrame:
    """Fills up each key's candidates to `limit` with allowed ones at score 0, by name.

    A key that has m candidates finds what it lacks among the first limit + m allowed ones, so it meets only these.
    """
    own = scored.groupBy(key).agg(F.count_distinct("candidate").alias("has"))
    most = (own.agg(F.max("has")).first()[0] or 0) + limit
    named = allowed.select("candidate").distinct().orderBy("candidate").limit(most)
    numbered = named.select("candidate", F.row_number().over(Window.orderBy("candidate")).alias("at"))  # `most` rows
    wanted = own.select(key, F.explode(F.sequence(F.lit(1), F.col("has").cast("int") + limit)).alias("at"))
    rest = wanted.join(numbered, "at").join(scored.select(key, "candidate"), [key, "candidate"], "left_anti").select(key, "candidate", F.lit(0.0).alias("score"))
    every = scored.select(key, "candidate", "score").unionByName(rest)
    return every.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "candidate"))).where(F.col("n") <= limit).drop("n")


def is_multi_question(x: Column) -> Column:
    marks = F.regexp_count(x, F.lit("[?？]"))
    lines = F.size(F.filter(F.split(x, "\n"), lambda y: ~T.is_blank(y)))
    return (marks >= 2) | x.rlike("[;；]") | (lines >= 2) | x.rlike(r"(?m)^\s*[0-9]+[.、)]\s*\S") | x.contains("分别")


def split_question(x: Column, most: int = 5) -> Column:
    parts = F.filter(F.transform(F.split(x, "[?？;；\n]"), T.trimmed), lambda y: y != "")
    return F.slice(F.array_distinct(parts), 1, most)


def needs_rewrite(x: Column, has_history: Column) -> Column:
    return (F.char_length(T.trimmed(x)) < F.when(has_history, 18).otherwise(8)) | is_multi_question(x)


def needs_date(question: Column) -> Column:
    """Whether today's date must be given with the question: it speaks of now, of news or of the calendar, and not of the past alone."""
    q = F.lower(T.trimmed(question))
    relative, calendar = T.contains_any(q, RELATIVE_TIME), T.contains_any(q, CALENDAR)
    return (q != "") & ~(T.contains_any(q, HISTORICAL) & ~relative & ~calendar) & (relative | T.contains_any(q, REAL_TIME) | calendar)


def needs_search(question: Column) -> Column:
    """Whether the answer must be looked up as it is now: news or words of now, no past, no stated date, no calendar question."""
    q = F.lower(T.trimmed(question))
    return (q != "") & ~(T.contains_any(q, HISTORICAL) | q.rlike(EXPLICIT_DATE) | T.contains_any(q, CALENDAR)) & (T.contains_any(q, REAL_TIME) | T.contains_any(q, NOW))


def dated_question(question: Column, today: Column) -> Column:
    """The question with the current date behind it where it needs one."""
    return F.when(needs_date(question), F.concat(question, F.lit("（当前日期："), F.date_format(today, "yyyy-MM-dd"), F.lit("）"))).otherwise(question)


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """The mean vector of all vectors (v) of a key: key, cv."""
    means = vectors.select(key, F.posexplode("v").alias("at", "x")).groupBy(key, "at").agg(F.avg("x").alias("x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda y: y["x"]).alias("cv"))


def key_terms(members: DataFrame, key: str, k: int) -> DataFrame:
    """members: key, terms (distinct, of one document). The k terms of a key found in most of its documents: key, term."""
    counts = members.select(key, F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    return counts.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), "term"))).where(F.col("at") <= k).select(key, "term")


def lexical_hits(questions: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """questions: question_id, terms. ln(1 + terms in common) with each key that shares one: question_id, key, lexical."""
    asked = questions.select("question_id", F.explode("terms").alias("term"))
    return asked.join(terms, "term").groupBy("question_id", key).agg(F.round(F.log(1 + F.count("*").cast("double")), 6).alias("lexical"))


def ranked(scored: DataFrame, k: int = 0) -> DataFrame:
    """Candidates with a score above 0, best first: adds position; the best k of a question if k is above 0."""
    order = F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("score").desc(), "candidate"))
    rows = scored.where("score > 0").withColumn("position", order)
    return rows.where(F.col("position") <= k) if k > 0 else rows


def intent_columns(questions: DataFrame) -> DataFrame:
    """Deterministic intent of questions (question): type, confidence, anchors, date flags."""
    q = F.col("question")
    anchored = q.rlike(SECTION_CODE) | q.rlike(CHINESE_SECTION) | q.rlike(QUOTED)
    strict = T.contains_any(q, ADJACENT) | (T.contains_any(q, LOCATION) & anchored)
    navigation = strict | T.contains_any(q, OUTLINE)
    quoted = F.when(strict, F.regexp_extract_all(q, F.lit(QUOTED), F.lit(1))).otherwise(F.array().cast("array<string>"))
    anchors = F.concat(F.regexp_extract_all(q, F.lit(SECTION_CODE), F.lit(0)), F.regexp_extract_all(q, F.lit(CHINESE_SECTION), F.lit(0)), quoted)
    return questions.withColumns(
        {
            "query_type": F.when(navigation, "STRUCTURE_NAVIGATION").otherwise("DOCUMENT_QA"),
            "confidence": F.when(navigation, 0.86).otherwise(0.55),
            "anchors": F.slice(F.array_distinct(F.filter(anchors, lambda x: ~T.is_blank(x))), 1, 8),
            "needs_date": needs_date(q),
            "needs_search": needs_search(q),
            "item_index": T.chinese_number(F.regexp_extract(q, "第([0-9一二三四五六七八九十]+)[步条点项个]", 1)),
        }
    )


def merge_options(configs: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """configs: base_id, option_key, option_value. One row a key: the agreed value or the default, and whether bases conflict.

    A key conflicts if its values differ or only some of the bases state it.
    """
    spark = configs.sparkSession
    bases = configs.agg(F.count_distinct("base_id").alias("bases"))
    stated = configs.groupBy("option_key").agg(F.count_distinct("option_value").alias("kinds"), F.count_distinct("base_id").alias("stating"), F.min("option_value").alias("value"))
    known = spark.createDataFrame(sorted(defaults.items()), "option_key string, default_value string")
    conflict = F.coalesce((F.col("kinds") > 1) | (F.col("stating") < F.col("bases")), F.lit(False))
    return known.join(stated, "option_key", "left").crossJoin(F.broadcast(bases)).select(
        "option_key", F.when(F.col("value").isNull() | conflict, F.col("default_value")).otherwise(F.col("value")).alias("option_value"), conflict.cast("int").alias("conflict")
    )
