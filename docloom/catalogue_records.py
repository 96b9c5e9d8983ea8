"""Queries of parsers' text rules, record keeping and requests, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from docloom.catalogue import BAG, OBSERVED, PLAN, TOKENS, fused_hits, observed, query, raw_hits, t
from docloom.catalogue_documents import BLOCKS, block_rows
from docloom.operators import admin, blocks, conversation, retrieval, routing
from docloom.sources import index, parsers, writers
from docloom.streaming import summary

TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
TITLE = r"({0} <> '' and length({0}) <= 80 and (regexp_matches({0}, '^([一二三四五六七八九十]+、|第[一二三四五六七八九十0-9]+[章节条]|[0-9]+(\.[0-9]+)*[、.])') or regexp_matches({0}, '(章|节|：|:)$')))"


def spaced(spark, d):
    """Documents whose sentences stand in paragraphs of their own, with Windows line ends and headings in part."""
    text = F.regexp_replace("text", r"(\. )", ".\r\n\r\n")
    return t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("## 1. Head\n\n"), text)).otherwise(text).alias("text"))


@query(
    rf"""with x as (select doc_id, case when doc_id % 3 = 0 then '## 1. Head' || chr(10) || chr(10) else '' end || replace(text, '. ', '.' || chr(13) || chr(10) || chr(13) || chr(10)) as text from documents),
 c as (select doc_id, {TRIM.format("translate(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(9), ' ')")} as text from x),
 p as (select doc_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n+'), lambda y: {TRIM.format('y')}), lambda y: y <> '') as ps from c),
 u as (select doc_id, unnest(range(len(ps))) as pos, unnest(ps) as raw from p)
 select doc_id as document_id, (pos + 1)::int as block_no, case when regexp_matches(raw, '^#{{1,6}}\s+') or {TITLE.format('raw')} then 'TITLE' else 'Text' end as block_type,
  case when regexp_matches(raw, '^#{{1,6}}\s') then length(regexp_extract(raw, '^(#{{1,6}})\s', 1))::int end as heading_level, regexp_replace(raw, '^#{{1,6}}\s+', '') as text from u"""
)
def text_paragraphs(spark, d):
    return parsers.parse_text(spaced(spark, d))


@query("select doc_id, case doc_id % 5 when 0 then 'MD' when 1 then 'HTML' when 2 then 'PDF' when 3 then 'TXT' else 'UNKNOWN' end as file_type from documents")
def file_types(spark, d):
    name = F.concat(F.col("source"), F.lit("."), F.element_at(F.array(*map(F.lit, ("Markdown", "HTM", "Pdf", "txt", "bin"))), (F.col("doc_id") % 5 + 1).cast("int")))
    return t(spark, d, "documents").select("doc_id", parsers.file_type(name).alias("file_type"))


@query("select doc_id, text as content from documents where text <> ''")
def decoded_texts(spark, d):
    """Texts encoded as UTF-8 with a byte-order mark, without one, or as GB18030, and decoded again."""

    @F.pandas_udf("binary")
    def gb18030(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: x.encode("gb18030"))

    utf8 = F.encode("text", "UTF-8")
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).when(F.col("doc_id") % 3 == 1, utf8).otherwise(gb18030("text"))
    return t(spark, d, "documents").where("text <> ''").select("doc_id", parsers.decode(content).alias("content"))


@query(
    rf"""with b as (select document_id, block_no, block_type, {TRIM.format("replace(text, chr(9), ' ')")} as text, case when block_no % 4 = 0 then 'own ' || block_type else ' ' end as given from (with {BLOCKS} select * from block)),
 n as (select *, row_number() over (partition by document_id order by block_no) as k from b where text <> ''),
 f as (select document_id, k, text, case when trim(given) = '' then coalesce(last_value(case when block_type = 'TITLE' then text end ignore nulls) over (partition by document_id order by k rows between unbounded preceding and current row), '') else given end as section_path from n)
 select document_id, k::int as block_no, text, section_path, '/' || regexp_replace(regexp_replace(section_path, '[^0-9a-zA-Z\p{{Han}}]+', '-', 'g'), '^-+|-+$', '', 'g') || '/' || k as canonical_path from f"""
)
def normalised_blocks(spark, d):
    rows = block_rows(spark, d).withColumn("section_path", F.when(F.col("block_no") % 4 == 0, F.concat(F.lit("own "), "block_type")).otherwise(" "))
    return blocks.normalise(rows).select("document_id", F.col("block_no").cast("int").alias("block_no"), "text", "section_path", "canonical_path")


BOOSTED = BAG.replace("'hybrid' else min(channel) end as channel from ranked", "'hybrid' else min(channel) end as channel, case chunk_id % 3 when 0 then 0.03::double when 1 then 0.02::double else 0 end as boost from ranked")


@query(f"with {BOOSTED} select question_id, chunk_id, rrf, round(sum_score, 6) as fused_score, channel from (select *, fused_score + 0.04::double * least(boost, 1) as sum_score from fused)")
def boosted_fusion(spark, d):
    hits = retrieval.gated_channels(raw_hits(spark, d), PLAN)
    kinds = hits.select("chunk_id").distinct().select("chunk_id", F.element_at(F.array(*map(F.lit, ("table", "Image", "text"))), (F.col("chunk_id") % 3 + 1).cast("int")).alias("source_type"))
    return retrieval.fuse(hits, PLAN, kinds)


@query(None)
def conversation_digests(spark, d):
    """The summary that `streaming.summary` keeps of each conversation, from the whole table at once: tests hold the stream against it."""
    found = summary.batch_summaries(summary.exchanges(t(spark, d, "conversations")), 1, 2)
    return found.withColumn("questions", F.array_join("questions", "|"))


@query(
    """with s as (select distinct conv_id, 'Chat ' || (conv_id * 37)::varchar as name, case when conv_id % 2 = 0 then 'kb' else 'open' end as mode from conversations)
 select conv_id, name, mode from s where mode = 'kb' and (contains(conv_id::varchar, '1') or contains(lower(name), '1') or exists (select 1 from conversations c where c.conv_id = s.conv_id and contains(lower(c.text), '1')))"""
)
def session_list(spark, d):
    turns = t(spark, d, "conversations")
    rows = turns.select("conv_id").distinct().select("conv_id", F.concat(F.lit("Chat "), (F.col("conv_id") * 37).cast("string")).alias("name"), F.when(F.col("conv_id") % 2 == 0, "kb").otherwise("open").alias("mode"))
    return conversation.sessions(rows, turns, "kb", " 1 ")


@query(
    """with e as (select conv_id, turn, text as question, lead(role) over w as nr, lead(text) over w as answer, role from conversations window w as (partition by conv_id order by turn)),
 x as (select conv_id, turn, question, case when nr = 'assistant' then answer end as answer, case when nr = 'assistant' and turn % 5 <> 4 then 'COMPLETED' else 'RUNNING' end as status from e where role = 'user'),
 f as (select * from x qualify row_number() over (partition by conv_id order by turn desc) <= 6),
 k as (select * from f where status <> 'RUNNING' qualify row_number() over (partition by conv_id order by turn desc) <= 2)
 select conv_id, turn, question, answer, row_number() over (partition by conv_id order by turn)::int as place from k"""
)
def memory_turns(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t(spark, d, "conversations").withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)}).where("role = 'user'")
    answered = F.coalesce(F.col("next_role") == "assistant", F.lit(False))
    status = F.when(answered & (F.col("turn") % 5 != 4), "COMPLETED").otherwise("RUNNING")
    rows = rows.select("conv_id", "turn", F.col("text").alias("question"), F.when(answered, F.col("next_text")).alias("answer"), status.alias("status"))
    return conversation.memory_turns(rows, 2).select("conv_id", "turn", "question", "answer", "place")


@query("select n_nationkey, n_name, o.s_suppkey as latest_supplier, o.s_name as latest_name from nation left join (select * from supplier where s_suppkey % 3 = 0 qualify row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey desc) = 1) o on n_nationkey = s_nationkey")
def latest_of_each(spark, d):
    """All nations with their supplier of the highest balance, if they have one."""
    others = t(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", "s_name", "s_acctbal")
    rows = conversation.with_latest(t(spark, d, "nation").select("n_nationkey", "n_name"), others, "n_nationkey", ["s_acctbal", "s_suppkey"])
    return rows.select("n_nationkey", "n_name", F.col("latest.s_suppkey").alias("latest_supplier"), F.col("latest.s_name").alias("latest_name"))


@query(f"with u as (select conv_id, case when turn % 3 = 0 then length(text) end as stated, {TOKENS.format('text')}::bigint as own from conversations) select conv_id, sum(coalesce(stated, own))::bigint as tokens, count(stated) as stated, round(sum(coalesce(stated, own)) * 0.002::double / 1000, 6) as cost from u group by conv_id")
def model_usage(spark, d):
    return conversation.token_usage(t(spark, d, "conversations").withColumn("tokens", F.when(F.col("turn") % 3 == 0, F.char_length("text"))))


@query("select o_orderkey, o_orderstatus from orders where o_orderkey % 5 <> 0")
def live_rows(spark, d):
    return admin.live(t(spark, d, "orders").withColumn("deleted", (F.col("o_orderkey") % 5 == 0).cast("int"))).select("o_orderkey", "o_orderstatus")


@query("select event_type, user_id, max_by(event_id, (value, event_id)) as event_id from events group by event_type, user_id")
def newest_versions(spark, d):
    rows = t(spark, d, "events").select("event_id", F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("name"), "event_type", "user_id", F.struct("value", "event_id").alias("version"))
    return admin.newest_version(rows, "name", "version").select("event_type", "user_id", "event_id")


@query("select c_custkey, case when c_custkey % 4 = 0 then 'new' else c_name end as c_name from customer union all select c_custkey + 1000000000, 'added' from customer where c_custkey % 10 = 0")
def upserted_rows(spark, d):
    old = t(spark, d, "customer").select("c_custkey", "c_name")
    new = old.where("c_custkey % 4 = 0").withColumn("c_name", F.lit("new")).unionByName(old.where("c_custkey % 10 = 0").select((F.col("c_custkey") + 1_000_000_000).cast(old.schema["c_custkey"].dataType).alias("c_custkey"), F.lit("added").alias("c_name")))
    return writers.upserted(old, new, ["c_custkey"])


@query("select n_nationkey, case when n_nationkey = 7 then 1 else 0 end as is_default from nation")
def default_flags(spark, d):
    rows = t(spark, d, "nation").select("n_nationkey", F.lit(1).alias("is_default"))
    return writers.cleared_defaults(rows, "n_nationkey", 7)


@query("select conv_id as document_id, turn as task_id, role as text from conversations where turn % 3 <> 0 union all select conv_id, turn, 'anew' from conversations where turn % 3 = 0")
def replaced_tasks(spark, d):
    old = t(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("task_id"), F.col("role").alias("text"))
    return writers.replaced_by_task(old, old.where("task_id % 3 = 0").withColumn("text", F.lit("anew")))


@query("with x as (select conv_id as document_id, turn as id, case when turn > 0 then turn - 1 end as parent_id, 100 + row_number() over (partition by conv_id order by turn) - 1 as new_id from conversations) select x.document_id, x.new_id as id, p.new_id as parent_id from x left join x p on p.document_id = x.document_id and p.id = x.parent_id")
def document_snapshots(spark, d):
    rows = t(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("id"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent_id"))
    return writers.snapshot(rows, ["parent_id"], 100).select("document_id", F.col("id").cast("long").alias("id"), F.col("parent_id").cast("long").alias("parent_id"))


@query("select 'documents' as table_name, count(*) as n from documents where doc_id % 7 <> 0 union all select 'labels', count(*) from labels where doc_id % 7 <> 0")
def cascade_deleted(spark, d):
    tables = {name: t(spark, d, name).withColumnRenamed("doc_id", "document_id") for name in ("documents", "labels")}
    left = writers.without_documents(tables, tables["documents"].where("document_id % 7 = 0").select("document_id"))
    out = None
    for name, rows in left.items():
        counted = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = counted if out is None else out.unionByName(counted)
    return out


@query(f"with {OBSERVED} select question_id, channel, count(*) as recalled, sum(accepted)::bigint as accepted, count(*) filter (where reason = 'selected') as selected, 'b' as run from seen group by question_id, channel")
def search_traces(spark, d):
    """Two runs are traced, one of them twice; the trace of the second is read back."""

    def build(folder):
        rows = index.once(observed(spark, d))
        trace = {"retrieval_results": rows, "channel_executions": retrieval.channel_stats(rows)}
        for run in ("a", "b", "b"):
            writers.write_trace(trace, folder, run)

    folder = index.stored(spark, "traces", f"{d}/documents.parquet", build)
    return writers.read_trace(spark, folder, "channel_executions").where("run = 'b'").select("question_id", "channel", "recalled", "accepted", "selected", "run")


@query(
    f"""with {BAG}, cand as (select * from fused qualify row_number() over (partition by question_id order by fused_score desc, chunk_id) <= 40),
 r as (select *, row_number() over (partition by question_id order by fused_score desc, chunk_id) as position from cand)
 select question_id, count(*) as fused, count(distinct chunk_id // 1048576 * 1048576 + chunk_id % 1048576 // 4) as parents, least(5, count(*) filter (where position % 3 <> 0)) as reranked from r group by question_id"""
)
def question_evidence(spark, d):
    """Evidence of each question after fusion, elevation and reranking."""
    from pyspark.sql import Window

    from docloom.catalogue import child_parents

    cut = retrieval.candidates(fused_hits(spark, d), PLAN.candidates)
    parents = retrieval.elevate(cut, child_parents(cut)).groupBy("question_id").agg(F.count("*").alias("parents"))
    placed = cut.withColumn("position", F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("fused_score").desc(), "chunk_id")))
    scores = placed.where("position % 3 <> 0").select("question_id", "position", (1.0 / F.col("position")).cast("double").alias("relevance"))
    best = retrieval.reranked(placed, scores, 5).groupBy("question_id").agg(F.count("*").alias("reranked"))
    return cut.groupBy("question_id").agg(F.count("*").alias("fused")).join(parents, "question_id").join(best, "question_id", "left").fillna(0, ["reranked"])


@query(
    """with s as (select s_nationkey % 3 as base_id, 'option' || (s_suppkey % 4)::varchar as option_key, case when s_suppkey % 4 = 1 then 'same' when s_suppkey % 4 = 3 and s_nationkey % 3 = 0 then null else (s_nationkey % 3)::varchar end as option_value from supplier),
 g as (select option_key, count(distinct option_value) as kinds, count(distinct base_id) as stating, min(option_value) as v from s where option_value is not null group by option_key),
 k as (select * from (values ('option0', 'd0'), ('option1', 'd1'), ('option3', 'd3'), ('option9', 'd9')) t(option_key, def))
 select option_key, case when v is null or kinds > 1 or stating < n then def else v end as option_value, coalesce(kinds > 1 or stating < n, false)::int as conflict from k left join g using (option_key), (select count(distinct base_id) as n from s where option_value is not null)"""
)
def merged_options(spark, d):
    key = F.concat(F.lit("option"), (F.col("s_suppkey") % 4).cast("string"))
    base = F.col("s_nationkey") % 3
    value = F.when(F.col("s_suppkey") % 4 == 1, "same").when((F.col("s_suppkey") % 4 == 3) & (base == 0), F.lit(None)).otherwise(base.cast("string"))
    stated = t(spark, d, "supplier").select(base.alias("base_id"), key.alias("option_key"), value.alias("option_value")).where("option_value is not null")
    return routing.merge_options(stated, {f"option{i}": f"d{i}" for i in (0, 1, 3, 9)})
