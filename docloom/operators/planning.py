"""Question plans: rewrites, intent merge, navigation, hints, anchors, summaries, history budgets and route decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.routing import is_multi_question, split_question

# Thresholds of the advisor and of structure navigation; bounds of lists.
ADVISOR, NAVIGATION = 0.72, 0.65
MOST_HINTS, MOST_QUESTIONS, MOST_ANCHORS, MOST_NOTES = 8, 5, 5, 4
RECENT_SHARE = 0.65
# Patterns of years and sections.
YEAR, DECIMAL_SECTION, NAMED_SECTION = r"20[0-9]{2}", r"[0-9]+(?:\.[0-9]+)+", r"第\s*[0-9一二三四五六七八九十百]+\s*(?:章|节|小节)"
# Retrieval intents by query type, and in the order in which channels name one.
INTENTS = {"STRUCTURE_NAVIGATION": "STRUCTURE", "TABLE_QUERY": "TABLE", "GRAPH_RELATION": "GRAPH_RAG", "GLOBAL_SUMMARY": "RAPTOR"}
# Navigation actions by the operations that ask for them, the first in this order that is asked for.
ACTIONS = [
    ("CHILD_SECTION_DESCEND", ["SECTION_WITH_CHILDREN", "DIRECT_CHILDREN"]),
    ("SECTION_ADJACENCY_LOOKUP", ["SECTION_WITH_SIBLINGS", "PREVIOUS_SIBLING", "NEXT_SIBLING"]),
    ("ANCESTOR_SECTION_RETURN", ["PARENT_SECTION"]),
    ("FRESH_TOPIC", ["CURRENT_SECTION"]),
]
# Bounds and titles of conversation summaries.
GOAL_CHARS, ITEM_CHARS, ITEMS = 120, 80, 6
SECTIONS = [("已确认事实", "facts"), ("用户偏好与约束", "preferences"), ("已解决问题", "resolved"), ("待跟进问题", "pending"), ("检索提示", "hints")]


def distinct_limited(xs: Column, k: int) -> Column:
    """Trimmed, filled, distinct, the first k."""
    return F.slice(F.array_distinct(F.filter(F.transform(xs, T.trimmed), lambda x: x != "")), 1, k)


def normalised_confidence(x: Column) -> Column:
    """Percentages above 1 as a share, nothing below 0."""
    return F.when(x > 1, x / 100).otherwise(F.greatest(F.lit(0.0), x))


def rewrite_plan(rows: DataFrame, most: int = MOST_QUESTIONS) -> DataFrame:
    """rows: question, rewrite, should_split, sub_questions (a model's answer). Adds rewritten and questions.

    Sub-questions stay only if the model asks for a split and the question itself is clearly several; a split
    without any falls back to the rules.
    """
    rewritten = T.trimmed(T.blank_to_default(F.col("rewrite"), F.col("question")))
    given = distinct_limited(F.coalesce("sub_questions", F.array().cast("array<string>")), most)
    by_rule = split_question(F.col("question"), most)
    split = F.coalesce("should_split", F.lit(False)) & is_multi_question(F.col("question"))
    one = F.array(rewritten)
    return rows.withColumn("rewritten", rewritten).withColumn("questions", F.when(~split, one).when(F.size(given) > 0, given).when(F.size(by_rule) > 1, by_rule).otherwise(one))


def merged_intent(rows: DataFrame) -> DataFrame:
    """A model's advice (advised_*) over the rules' result (own_*): query_type, confidence, channels, anchors.

    Advice counts from ADVISOR on; rules that are sure of structure navigation always win; navigation without
    operations falls back, without the STRUCTURE channel (fail closed). No advice leaves the rules' result.
    """
    sure = normalised_confidence(F.col("advised_confidence"))
    high = sure >= ADVISOR
    own_type = T.blank_to_default(F.col("own_type"), F.lit("DOCUMENT_QA"))
    advised_type = T.blank_to_default(F.col("advised_type"), F.lit("DOCUMENT_QA"))
    own_sure = normalised_confidence(F.col("own_confidence"))
    fixed = (own_type == "STRUCTURE_NAVIGATION") & (F.size("own_operations") > 0) & (own_sure >= NAVIGATION)
    kind = F.when(fixed, "STRUCTURE_NAVIGATION").when(high, advised_type).otherwise(own_type)
    value = F.when(fixed, own_sure).when(high, sure).otherwise(F.col("own_confidence"))
    none = F.array().cast("array<string>")
    channels = F.array_distinct(F.concat(F.array(F.lit("GENERAL")), "own_channels", F.when(high, F.col("advised_channels")).otherwise(none)))
    has_operations = fixed | (high & (F.size("advised_operations") > 0)) | (F.size("own_operations") > 0)
    closed = (kind == "STRUCTURE_NAVIGATION") & ~((value >= NAVIGATION) & has_operations)
    back = F.when(own_type == "STRUCTURE_NAVIGATION", "DOCUMENT_QA").otherwise(own_type)
    advised = F.col("advised_confidence").isNotNull()
    pick = lambda mine, own: F.when(advised, mine).otherwise(own)
    return rows.withColumns(
        {
            "query_type": pick(F.when(closed, back).otherwise(kind), own_type),
            "confidence": pick(F.when(closed, own_sure).otherwise(value), F.col("own_confidence")),
            "channels": pick(F.when(closed, F.filter(channels, lambda c: c != "STRUCTURE")).otherwise(channels), F.col("own_channels")),
            "anchors": distinct_limited(F.col("own_anchors"), MOST_HINTS),
            "fail_closed": F.coalesce(advised & closed, F.lit(False)),
        }
    )


def primary_intent(query_type: Column, channels: Column) -> Column:
    """The retrieval intent: by query type, else the first special channel, else GENERAL."""
    by_type = F.create_map(*[F.lit(x) for pair in INTENTS.items() for x in pair])
    special = F.get(F.filter(channels, lambda c: c.isin(*INTENTS.values())), 0)
    return F.coalesce(by_type[T.blank_to_default(query_type, F.lit("DOCUMENT_QA"))], special, F.lit("GENERAL"))


def navigation_action(operations: Column, confidence: Column, threshold: float = NAVIGATION) -> Column:
    """The action for a set of operations; empty below the threshold."""
    sure = (F.size(operations) > 0) & (normalised_confidence(confidence) >= threshold)
    out = F.when(~sure, F.lit(""))
    for name, asked in ACTIONS:
        out = out.when(F.arrays_overlap(operations, F.array(*[F.lit(x) for x in asked])), name)
    return out.otherwise("")


def resolved_sections(questions: DataFrame, sections: DataFrame) -> DataFrame:
    """questions: question_id, document_id, question. sections: document_id, node_no, title, section_path.

    The section a question means: by number at the head of a title, else by a quoted title (equal, or the end of
    the path), else none here (the section search takes over). Earlier mentions win, then earlier sections.
    """
    quoted = F.regexp_extract_all("question", F.lit("[“\"']([^”\"']{2,40})[”\"']"), F.lit(1))
    asked = questions.select("question_id", "document_id", F.regexp_extract_all("question", F.lit(DECIMAL_SECTION), F.lit(0)).alias("codes"), F.transform(quoted, T.title_key).alias("phrases"))
    known = sections.select("document_id", "node_no", T.heading_code(F.col("title")).alias("code"), T.title_key(F.col("title")).alias("title_key"), T.title_key(F.coalesce("section_path", F.lit(""))).alias("path_key"))
    by_code = asked.select("question_id", "document_id", F.posexplode("codes").alias("at", "code")).join(known, ["document_id", "code"]).select("question_id", F.lit(0).alias("way"), "at", "node_no")
    phrases = asked.select("question_id", "document_id", F.posexplode("phrases").alias("at", "phrase")).where(F.char_length("phrase") >= 2)
    by_title = phrases.join(known, "document_id").where((F.col("title_key") == F.col("phrase")) | F.col("path_key").endswith(F.col("phrase"))).select("question_id", F.lit(1).alias("way"), "at", "node_no")
    best = by_code.unionByName(by_title).groupBy("question_id").agg(F.min(F.struct("way", "at", "node_no")).alias("best"))
    return best.select("question_id", "best.node_no", F.when(F.col("best.way") == 0, "CODE").otherwise("TITLE").alias("found_by"))


def metadata_hints(question: Column, entities: Column) -> dict[str, Column]:
    """Years, sections and entities that a question names, at most MOST_HINTS each."""
    found = lambda p: F.regexp_extract_all(question, F.lit(p), F.lit(0))
    return {
        "year_hints": distinct_limited(found(YEAR), MOST_HINTS),
        "section_hints": distinct_limited(F.concat(found(DECIMAL_SECTION), found(NAMED_SECTION)), MOST_HINTS),
        "entity_hints": distinct_limited(entities, MOST_HINTS),
    }


def question_plan(rows: DataFrame) -> DataFrame:
    """rows: question, rewritten, sub_questions, query_type, anchors (hints of recent evidence). Adds the retrieval question, sub-questions and inherited anchors."""
    current, rewritten = T.compact(F.coalesce("question", F.lit(""))), T.compact(F.coalesce("rewritten", F.lit("")))
    retrieval = F.when(rewritten == "", current).otherwise(rewritten)
    subs = F.slice(F.array_distinct(F.filter(F.transform("sub_questions", T.compact), lambda x: x != "")), 1, MOST_QUESTIONS)
    inherited = F.when(F.col("query_type") == "FOLLOW_UP", distinct_limited(F.col("anchors"), MOST_ANCHORS)).otherwise(F.array().cast("array<string>"))
    return rows.withColumns(
        {
            "retrieval_question": retrieval,
            "questions": F.when((F.size(subs) == 0) & (retrieval != ""), F.array(retrieval)).otherwise(subs),
            "inherited": inherited,
            "inheritance": F.when(F.size(inherited) > 0, "FINAL_EVIDENCE_ANCHOR").otherwise("NONE"),
        }
    )


def anchor_hint(fields: dict[str, Column]) -> Column:
    """`name=value` of the filled fields, joined by '; '."""
    return F.array_join(F.array_compact(F.array(*[F.when(~T.is_blank(c.cast("string")), F.concat(F.lit(f"{n}="), T.trimmed(c.cast("string")))) for n, c in fields.items()])), "; ")


def evidence_anchors(exchanges: DataFrame, limit: int) -> DataFrame:
    """exchanges: conv_id, exchange_no, completed, references (JSON array of documentId, sectionPath, chunkId). The newest anchors of a conversation, at most limit."""
    refs = F.from_json("references", "array<struct<documentId: long, sectionPath: string, structureNodeId: long, parentBlockId: long, chunkId: long>>")
    rows = exchanges.where("completed").select("conv_id", "exchange_no", F.posexplode(F.coalesce(refs, F.array().cast("array<struct<documentId: long, sectionPath: string, structureNodeId: long, parentBlockId: long, chunkId: long>>"))).alias("at", "x"))
    rows = rows.where("x.documentId is not null")
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("exchange_no").desc(), "at"))
    hint = anchor_hint({n: F.col(f"x.{n}") for n in ("documentId", "sectionPath", "structureNodeId", "parentBlockId", "chunkId")})
    return rows.select("conv_id", order.alias("position"), F.col("x.documentId").alias("document_id"), F.col("x.chunkId").alias("chunk_id"), hint.alias("hint")).where(F.col("position") <= limit)


def normalised_summary(rows: DataFrame, limit: int = 2000) -> DataFrame:
    """rows: summary, goal, facts, preferences, resolved, pending, hints. Cleans every field and adds long_text. The titles."""
    clip = lambda x: T.clip_tail(T.trimmed(x), ITEM_CHARS)
    lists = {c: F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), clip), lambda x: x != "")), 1, ITEMS) for _, c in SECTIONS}
    rows = rows.withColumns(lists | {"goal": T.clip_tail(T.trimmed(F.coalesce("goal", F.lit(""))), GOAL_CHARS), "summary": T.clip_tail(T.trimmed(F.coalesce("summary", F.lit(""))), limit)})
    made = F.array_compact(
        F.array(
            F.when(F.col("goal") != "", F.concat(F.lit("目标："), T.clip_tail(F.col("goal"), ITEM_CHARS))),
            F.when(F.size("facts") > 0, F.concat(F.lit("事实："), F.array_join("facts", "；"))),
            F.when(F.size("pending") > 0, F.concat(F.lit("待跟进："), F.array_join("pending", "；"))),
        )
    )
    rows = rows.withColumn("summary", F.when(F.col("summary") == "", F.array_join(made, "；")).otherwise(F.col("summary")))
    text = [F.when(F.col(c) != "", F.concat(F.lit(f"【{title}】\n"), F.col(c), F.lit("\n"))) for title, c in (("长期会话摘要", "summary"), ("会话目标", "goal"))]
    text += [F.when(F.size(c) > 0, F.concat(F.lit(f"【{title}】\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""))) for title, c in SECTIONS]
    return rows.withColumn("long_text", T.clip_tail(T.trimmed(F.array_join(F.array_compact(F.array(*text)), "\n")), limit))


def planning_text(structured: Column, recent: Column, limit: int) -> Column:
    """History within a budget: the end of the recent turns in RECENT_SHARE of it, the head of the structured part in the rest."""
    late = T.clip_tail(recent, round(limit * RECENT_SHARE))
    room = F.greatest(F.lit(0), F.lit(limit - 2) - F.char_length(late))
    early = F.when(F.char_length(structured) > room, F.when(room == 0, "").otherwise(F.concat(F.left(structured, room - 1), F.lit("…")))).otherwise(structured)
    return F.when(T.is_blank(recent), T.clip_head(structured, limit)).otherwise(T.join_non_blank(F.array(early, late), "\n\n"))


def graph_notes(rows: DataFrame) -> DataFrame:
    """rows: question_id, position, priority, note. The MOST_NOTES of highest priority, then earliest, joined."""
    order = F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("priority").desc(), "position"))
    top = rows.withColumn("n", order).where(F.col("n") <= MOST_NOTES)
    return top.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "note"))), lambda x: x["note"]), "；").alias("notes"))


def hit_in_top(candidates: DataFrame, selected: DataFrame, k: int = 3) -> DataFrame:
    """1 where the selected document is among the k best candidates of its question, else 0: question_id, hit."""
    top = candidates.withColumn("n", F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("score").desc(), "candidate"))).where(F.col("n") <= k)
    found = top.select("question_id", F.col("candidate").alias("selected"), F.lit(1).alias("hit"))
    return selected.join(found, ["question_id", "selected"], "left").select("question_id", "selected", F.coalesce("hit", F.lit(0)).alias("hit"))


def recommended(decisions: DataFrame, threshold: float) -> DataFrame:
    """decisions: question_id, status, confidence, top_candidate, chosen. The candidate to recommend: SUCCESS, confidence from threshold to 1, still the top one."""
    ok = (F.col("status") == "SUCCESS") & F.col("confidence").between(threshold, 1.0) & (F.col("top_candidate") == F.col("chosen"))
    return decisions.withColumn("recommended", F.when(ok, F.col("chosen")))


def shadow_trace(decisions: DataFrame, enabled: bool = True) -> DataFrame:
    """The same route decisions recorded in mode shadow, which changes no answer."""
    return decisions.where(F.lit(enabled)).withColumn("mode", F.lit("shadow"))
