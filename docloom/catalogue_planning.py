"""Queries of question planning, intents, summaries and anchors, with their SQL.

What a language model would answer is derived from the given tables by the fixtures, in the same words for Spark and for SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.catalogue import BAG, PLAN, ROUTE, fused_hits, query, routed, t
from docloom.catalogue_documents import BLOCKS, block_rows
from docloom.functions import text as T
from docloom.operators import filters, planning, retrieval, routing

TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
MULTI = r"(len(regexp_extract_all(text, '[?？]')) >= 2 or regexp_matches(text, '[;；]') or len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) >= 2 or regexp_matches(text, '(?m)^\s*[0-9]+[.、)]\s*\S') or contains(text, '分别'))"
RULE = r"list_slice(list_filter(rule, lambda x, i: list_position(rule, x) = i), 1, 5)"


def turns(spark, d):
    return t(spark, d, "conversations").where("text is not null")


@query(
    f"""with x as (select conv_id, turn, text, {TRIM.format("case when turn % 3 = 0 then text else text || ' !' end")} as rewritten, turn % 2 = 0 and {MULTI} as split,
   case when turn % 5 = 0 then [] else list_filter(list_transform(string_split(text, '. '), lambda x: {TRIM.format('x')}), lambda x: x <> '') end as given,
   list_filter(list_transform(string_split_regex(text, '[?？;；\\n]'), lambda x: {TRIM.format('x')}), lambda x: x <> '') as rule from conversations)
 select conv_id, turn, rewritten, array_to_string(case when not split then [rewritten] when len(given) > 0 then list_slice(list_filter(given, lambda x, i: list_position(given, x) = i), 1, 5) when len({RULE}) > 1 then {RULE} else [rewritten] end, '|') as questions from x"""
)
def rewrite_plans(spark, d):
    rows = turns(spark, d).select(
        "conv_id", "turn", F.col("text").alias("question"), F.when(F.col("turn") % 3 == 0, F.lit(" ")).otherwise(F.concat("text", F.lit(" !"))).alias("rewrite"), (F.col("turn") % 2 == 0).alias("should_split"),
        F.when(F.col("turn") % 5 == 0, F.array().cast("array<string>")).otherwise(F.split("text", r"\. ")).alias("sub_questions"),
    )
    return planning.rewrite_plan(rows).select("conv_id", "turn", "rewritten", F.array_join("questions", "|").alias("questions"))


ADVICE_COLUMNS = [
    "item_id", "case item_id % 4 when 0 then 'STRUCTURE_NAVIGATION' when 1 then 'TABLE_QUERY' when 2 then '' else 'GRAPH_RELATION' end as advised_type",
    "case when item_id % 10 = 9 then null when item_id % 10 = 8 then 90.0 else (item_id * 13 % 100) / 100.0 end as advised_confidence",
    "case item_id % 3 when 0 then 'STRUCTURE_NAVIGATION' when 1 then 'DOCUMENT_QA' else '' end as own_type", "case when item_id % 3 = 0 then 0.86 else 0.55 end as own_confidence",
]
ADVICE = f"""a as (select {', '.join(ADVICE_COLUMNS)}, item_id % 2 = 0 as ops, item_id % 6 = 0 as own_ops from benchmark),
 b as (select *, case when own_type = '' then 'DOCUMENT_QA' else own_type end as ot, case when advised_type = '' then 'DOCUMENT_QA' else advised_type end as adt, case when advised_confidence > 1 then advised_confidence / 100 else advised_confidence end as sure from a),
 c as (select *, sure >= 0.72 as high, ot = 'STRUCTURE_NAVIGATION' and own_ops and own_confidence >= 0.65 as fixed from b),
 e as (select *, case when fixed then 'STRUCTURE_NAVIGATION' when high then adt else ot end as kind, case when fixed then own_confidence when high then sure else own_confidence end as val, fixed or (coalesce(high, false) and ops) or own_ops as has from c),
 f as (select *, kind = 'STRUCTURE_NAVIGATION' and not (val >= 0.65 and has) as closed from e)"""


@query(
    f"""with {ADVICE} select item_id, case when sure is null then ot when closed then 'DOCUMENT_QA' else kind end as query_type, round(case when sure is null then own_confidence when closed then own_confidence else val end, 6) as confidence,
 case when sure is null then 'STRUCTURE' when closed then case when high then 'GENERAL,TABLE' else 'GENERAL' end when high then 'GENERAL,STRUCTURE,TABLE' else 'GENERAL,STRUCTURE' end as channels, sure is not null and closed as fail_closed from f"""
)
def merged_intents(spark, d):
    names = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    rows = t(spark, d, "benchmark").selectExpr(*ADVICE_COLUMNS).withColumns({c: F.col(c).cast("double") for c in ("advised_confidence", "own_confidence")})
    rows = rows.withColumns(
        {
            "advised_channels": names("TABLE", "GENERAL"), "own_channels": names("STRUCTURE"), "own_anchors": names(" 3.1 ", "", "3.1"),
            "advised_operations": F.when(F.col("item_id") % 2 == 0, names("DIRECT_CHILDREN")).otherwise(names()), "own_operations": F.when(F.col("item_id") % 6 == 0, names("PARENT_SECTION")).otherwise(names()),
        }
    )
    return planning.merged_intent(rows).select("item_id", "query_type", F.round("confidence", 6).alias("confidence"), F.array_join("channels", ",").alias("channels"), "fail_closed")


@query(
    """select conv_id, turn, case when turn % 5 = 0 then 'TABLE' when turn % 5 = 1 then 'RAPTOR' when conv_id % 2 = 0 then 'GRAPH_RAG' else 'GENERAL' end as intent,
 case when turn % 4 = 0 or conv_id % 3 = 0 then '' when turn % 4 = 1 then 'CHILD_SECTION_DESCEND' when turn % 4 = 2 then 'SECTION_ADJACENCY_LOOKUP' else 'ANCESTOR_SECTION_RETURN' end as action from conversations"""
)
def intents_and_actions(spark, d):
    names = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    turn, conv = F.col("turn"), F.col("conv_id")
    kind = F.when(turn % 5 == 0, "TABLE_QUERY").when(turn % 5 == 1, "GLOBAL_SUMMARY").otherwise("")
    channels = F.when(conv % 2 == 0, names("GENERAL", "GRAPH_RAG", "TABLE")).otherwise(names("GENERAL"))
    operations = F.when(turn % 4 == 0, names()).when(turn % 4 == 1, names("PARENT_SECTION", "DIRECT_CHILDREN")).when(turn % 4 == 2, names("NEXT_SIBLING", "CURRENT_SECTION")).otherwise(names("CURRENT_SECTION", "PARENT_SECTION"))
    sure = F.when(conv % 3 == 0, 60.0).otherwise(80.0)
    return t(spark, d, "conversations").select("conv_id", "turn", planning.primary_intent(kind, channels).alias("intent"), planning.navigation_action(operations, sure).alias("action"))


@query(
    r"with x as (select doc_id, lang, source, regexp_extract_all(text, '20[0-9]{2}') as y, regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)+') as s from documents) select doc_id, array_to_string(list_slice(list_filter(y, lambda x, i: list_position(y, x) = i), 1, 8), ',') as years, array_to_string(list_slice(list_filter(s, lambda x, i: list_position(s, x) = i), 1, 8), ',') as sections, lang || ',' || source as entities from x"
)
def metadata_hints(spark, d):
    rows = t(spark, d, "documents").select("doc_id", *[F.array_join(c, ",").alias(n) for n, c in zip(("years", "sections", "entities"), planning.metadata_hints(F.col("text"), F.array("lang", F.lit(" "), "source", "lang")).values(), strict=True)])
    return rows


SPACE = r"regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"


@query(
    f"""with x as (select conv_id, turn, {SPACE.format('text')} as current, case when turn % 2 = 0 then '' else {SPACE.format("text || '  again '")} end as rewritten, list_filter(list_transform(string_split(text, '. '), lambda x: {SPACE.format('x')}), lambda x: x <> '') as subs from conversations),
 y as (select *, case when rewritten = '' then current else rewritten end as retrieval_question from x)
 select conv_id, turn, retrieval_question, array_to_string(case when len(subs) = 0 and retrieval_question <> '' then [retrieval_question] else list_slice(list_filter(subs, lambda x, i: list_position(subs, x) = i), 1, 5) end, '|') as questions,
 case when turn % 3 = 0 then 'documentId=' || conv_id::varchar else '' end as inherited, case when turn % 3 = 0 then 'FINAL_EVIDENCE_ANCHOR' else 'NONE' end as inheritance from y"""
)
def question_plans(spark, d):
    hint = planning.anchor_hint({"documentId": F.col("conv_id"), "sectionPath": F.lit(" ")})
    rows = turns(spark, d).select(
        "conv_id", "turn", F.col("text").alias("question"), F.when(F.col("turn") % 2 == 0, F.lit(None).cast("string")).otherwise(F.concat("text", F.lit("  again "))).alias("rewritten"), F.split("text", r"\. ").alias("sub_questions"),
        F.when(F.col("turn") % 3 == 0, "FOLLOW_UP").otherwise("DOCUMENT_QA").alias("query_type"), F.array(hint, hint, F.lit("")).alias("anchors"),
    )
    found = planning.question_plan(rows)
    return found.select("conv_id", "turn", "retrieval_question", F.array_join("questions", "|").alias("questions"), F.array_join("inherited", "|").alias("inherited"), "inheritance")


KEY = r"lower(regexp_replace({0}, '[\s\p{{P}}\p{{S}}]+', '', 'g'))"


@query(
    f"""with {BLOCKS}, sec as (select document_id, block_no as node_no, trim(text) as title, {KEY.format('trim(text)')} as k, {KEY.format('section_path')} as p from block where block_type = 'TITLE' and length(trim(text)) between 2 and 40),
 q as (select document_id as question_id, document_id, title from sec where not regexp_matches(title, '[“"”''0-9]') qualify row_number() over (partition by document_id order by node_no desc) = 1)
 select question_id, min(node_no) as node_no, 'TITLE' as found_by from q join sec using (document_id) where length({KEY.format('q.title')}) >= 2 and (k = {KEY.format('q.title')} or ends_with(p, {KEY.format('q.title')})) group by question_id"""
)
def resolved_sections(spark, d):
    from pyspark.sql import Window

    rows = block_rows(spark, d).where("block_type = 'TITLE' and char_length(trim(text)) between 2 and 40")
    sections = rows.select("document_id", F.col("block_no").alias("node_no"), F.trim("text").alias("title"), "section_path")
    last = sections.where(~F.col("title").rlike("[“\"”'0-9]")).withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("node_no").desc()))).where("n = 1")
    asked = last.select(F.col("document_id").alias("question_id"), "document_id", F.concat(F.lit("what does “"), "title", F.lit("” say?")).alias("question"))
    return planning.resolved_sections(asked, sections)


@query(
    """with r as (select conv_id, turn, unnest([0, 1]) as nth from conversations where role = 'assistant'),
 a as (select conv_id, turn * 2 + nth as document_id, turn * 100 + nth as chunk_id, row_number() over (partition by conv_id order by turn desc, nth)::int as position from r)
 select conv_id, position, document_id, chunk_id, 'documentId=' || document_id::varchar || '; sectionPath=part ' || (document_id - document_id // 2 * 2)::varchar || '; chunkId=' || chunk_id::varchar as hint from a where position <= 5 and document_id in (1, 2, 3, 4, 5, 6, 7, 8)"""
)
def evidence_anchors(spark, d):
    entry = lambda at: F.concat(F.lit('{"documentId": '), (F.col("turn") * 2 + at).cast("string"), F.lit(f', "sectionPath": "part {at}", "chunkId": '), (F.col("turn") * 100 + at).cast("string"), F.lit("}"))
    rows = t(spark, d, "conversations").select("conv_id", F.col("turn").alias("exchange_no"), (F.col("role") == "assistant").alias("completed"), F.concat(F.lit("["), entry(0), F.lit(', {"sectionPath": "lost"}, '), entry(1), F.lit("]")).alias("references"))
    return filters.anchors_in_scope(planning.evidence_anchors(rows, 5), [1, 2, 3, 4, 5, 6, 7, 8])


@query(
    f"""with x as (select doc_id, {TRIM.format('text')} as g, list_transform(string_split(text, chr(10)), lambda x: {TRIM.format('x')}) as ls from documents),
 y as (select doc_id, case when length(g) > 120 then '…' || right(g, 119) else g end as goal, list_transform(list_filter(ls, lambda x: x <> ''), lambda x: case when length(x) > 80 then '…' || right(x, 79) else x end) as f from x),
 z as (select doc_id, goal, list_slice(list_filter(f, lambda x, i: list_position(f, x) = i), 1, 6) as facts from y),
 s as (select *, case when goal = '' then '' else '目标：' || case when length(goal) > 80 then '…' || right(goal, 79) else goal end end as gs from z),
 w as (select *, case when len(facts) > 0 then gs || case when gs <> '' then '；' else '' end || '事实：' || array_to_string(facts, '；') else gs end as summary from s)
 select doc_id, goal, array_to_string(facts, '|') as facts, summary from w"""
)
def normalised_summaries(spark, d):
    none = F.array().cast("array<string>")
    rows = t(spark, d, "documents").select("doc_id", F.lit(" ").alias("summary"), F.col("text").alias("goal"), F.split("text", "\n").alias("facts"), *[none.alias(c) for c in ("preferences", "resolved", "pending", "hints")])
    return planning.normalised_summary(rows).select("doc_id", "goal", F.array_join("facts", "|").alias("facts"), "summary")


def dealt_lines(part: int):
    """Every fifth line of a text, from `part` on."""
    return F.filter(F.split("text", "\n"), lambda x, i: i % 5 == part)


@query(None)
def summary_texts(spark, d):
    """Every line of a document goes to one of the five lists."""
    rows = t(spark, d, "documents").select("doc_id", F.lit(None).cast("string").alias("summary"), F.col("source").alias("goal"), *[dealt_lines(i).alias(c) for i, c in enumerate(("facts", "preferences", "resolved", "pending", "hints"))])
    return planning.normalised_summary(rows).select("doc_id", "long_text")


@query(
    """with x as (select doc_id, '会话目标：' || lang || source || repeat('h', 300) as s, case when doc_id % 6 = 0 then ' ' else text end as r from documents),
 y as (select doc_id, s, r, case when length(r) > 195 then '…' || right(r, 194) else r end as late from x), z as (select *, greatest(0, 298 - length(late)) as room from y)
 select doc_id, case when trim(r, ' ' || chr(9) || chr(10) || chr(13)) = '' then case when length(s) > 300 then left(s, 299) || '…' else s end
  else array_to_string(list_filter([case when length(s) > room then case when room = 0 then '' else left(s, (room - 1)::int) || '…' end else s end, late], lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> ''), chr(10) || chr(10)) end as history from z"""
)
def history_budget(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.concat(F.lit("会话目标："), "lang", "source", F.repeat(F.lit("h"), F.lit(300))).alias("s"), F.when(F.col("doc_id") % 6 == 0, " ").otherwise(F.col("text")).alias("r"))
    return rows.select("doc_id", planning.planning_text(F.col("s"), F.col("r"), 300).alias("history"))


@query("with n as (select conv_id as question_id, turn as position, length(text) % 7 as priority, role || turn::varchar as note from conversations), r as (select *, row_number() over (partition by question_id order by priority desc, position) as k from n) select question_id, string_agg(note, '；' order by k) as notes from r where k <= 4 group by question_id")
def graph_notes(spark, d):
    rows = t(spark, d, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("position"), (F.char_length("text") % 7).alias("priority"), F.concat("role", F.col("turn").cast("string")).alias("note"))
    return planning.graph_notes(rows)


CHOSEN = f"""{ROUTE}, n as (select question_id, candidate, score, row_number() over (partition by question_id order by score desc, candidate) as k from scored),
 tops as (select question_id, max(score) filter (where k = 1) as top1, coalesce(max(score) filter (where k = 2), 0) as top2, max(candidate) filter (where k = 1) as top_candidate from n group by question_id),
 dec as (select question_id, top_candidate, question_id // 20 % 10 as chosen, round(case when top1 <= 0 then 0 else top1 / greatest(10, top1 + top2 + 5) end, 6) as confidence from tops),
 st as (select *, case when confidence <= 0 then 'FAILED' when confidence < 0.55 then 'LOW_CONFIDENCE' else 'SUCCESS' end as status from dec)"""


def decisions(spark, d):
    scored = routed(spark, d)
    best = scored.groupBy("question_id").agg(F.max_by("candidate", F.struct("score", -F.col("candidate"))).alias("top_candidate"))
    rows = routing.confidence(scored, "question_id").join(best, "question_id")
    return rows.select("question_id", "top_candidate", F.expr("question_id div 20 % 10").alias("chosen"), "confidence", "status")


@query(f"with {CHOSEN} select question_id, top_candidate, chosen, status, case when status = 'SUCCESS' and confidence between 0.3 and 1 and top_candidate = chosen then chosen end as recommended, 'shadow' as mode from st")
def route_decisions(spark, d):
    return planning.shadow_trace(planning.recommended(decisions(spark, d), 0.3)).select("question_id", "top_candidate", "chosen", "status", "recommended", "mode")


@query(f"with {CHOSEN} select s.question_id, chosen as selected, case when k <= 3 then 1 else 0 end as hit from st s left join n on n.question_id = s.question_id and candidate = chosen")
def hit_in_top(spark, d):
    return planning.hit_in_top(routed(spark, d), decisions(spark, d).select("question_id", F.col("chosen").alias("selected")))


@query(
    f"""with {BAG}, pos as (select *, row_number() over (partition by question_id order by fused_score desc, chunk_id)::int as position from fused),
 rel as (select question_id, chunk_id, position, case when question_id % 40 = 0 then null when position % 3 = 0 then null else (position * 37 % 11) / 11.0::double end as rerank_score from pos where position <= 24)
 select question_id, chunk_id, position, rerank_score from rel where question_id % 40 = 0 or rerank_score is not null qualify row_number() over (partition by question_id order by rerank_score desc nulls last, position) <= 5"""
)
def reranked(spark, d):
    from pyspark.sql import Window

    position = F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("fused_score").desc(), "chunk_id"))
    rows = retrieval.candidates(fused_hits(spark, d), PLAN.candidates).withColumn("position", position).where("position <= 24")
    scores = rows.where("question_id % 40 <> 0 and position % 3 <> 0").select("question_id", "position", (F.col("position") * 37 % 11 / 11.0).cast("double").alias("relevance"))
    return retrieval.reranked(rows, scores, 5).select("question_id", "chunk_id", "position", "rerank_score")


@query(
    r"""select doc_id, 'Q: ' || source || ' / ' || lang as prompt, regexp_replace(regexp_replace(printf('%.2f', n_chars / 8.0), '(\.[0-9]*?)0+$', '\1'), '\.$', '') as shown,
 len(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s*([-*•]|[0-9]+[.)、])\s*', ''), '^\s+|\s+$', '', 'g')), lambda x: x <> ''))::int as items from documents"""
)
def text_tools(spark, d):
    return t(spark, d, "documents").select("doc_id", T.prompt("Q: {source} / {lang}", {"source": F.col("source"), "lang": F.col("lang")}).alias("prompt"), T.number_text(F.col("n_chars") / 8.0).alias("shown"), F.size(T.tolerant_array(F.col("text"))).alias("items"))


@query(
    "select conv_id, turn, c as needs_date, s as needs_search from (select conv_id, turn, regexp_matches(lower(text), '今天|现在|最新|天气|新闻|aqi|周') as c, regexp_matches(lower(text), '最新|现在|天气|新闻|aqi') and not contains(text, '周') as s from conversations)"
)
def date_and_search(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", routing.needs_date(F.col("text")).alias("needs_date"), routing.needs_search(F.col("text")).alias("needs_search"))
