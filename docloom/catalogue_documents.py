"""Queries of document assembly, profiles, pages and scopes, with their SQL.

The relations of a knowledge base that the given tables lack (task ids, states, blocks of a page) are derived
from `documents` by the fixtures below, in the same words for Spark and for SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.catalogue import PLAN, SPAN, WINDOWS, chunks, fused_hits, observed, query, question_terms, stored_keywords, t
from docloom.catalogue import BM25, GROUP, OBSERVED
from docloom.functions import text as T
from docloom.operators import assembly, blocks, chunking, filters, pages, profiles, retrieval
from docloom.sources import parsers

# Fixtures.
META_COLUMNS = [
    "doc_id as document_id", "source as base_id", "concat(lang, '-', source, '-', cast(doc_id as string), '.txt') as document_name", "case when doc_id % 7 = 0 then '' else concat(source, '.md') end as original_name",
    "case when doc_id % 4 = 0 then 2 else 3 end as parse_status", "case when doc_id % 5 = 0 then null else 3 end as strategy_status", "case when doc_id % 3 = 0 then 1 else 3 end as index_status",
    "case when doc_id % 11 = 0 then null else doc_id * 10 + 1 end as last_index_task_id", "cast(doc_id * 7919 % 1009 as bigint) as update_time",
]
META = f"meta as (select {', '.join(META_COLUMNS)} from documents)"
BLOCK_COLUMNS = [
    "document_id", "block_no", f"document_id * {SPAN} + block_no as block_id", "block_type", "text", "section_path", "concat('/', section_path, '/', cast(block_no as string)) as canonical_path",
    "case when document_id % 3 = 0 then 0 else cast((block_no - 1) div 5 + 1 as int) end as page_no", "case when document_id % 3 = 0 and block_no % 2 = 0 then 'p1' else '' end as page_range",
    "case when block_type = 'TABLE' then '<table/>' else '' end as table_html", "case when block_type = 'IMAGE' then concat('figure ', cast(block_no as string)) else '' end as image_caption",
]
KIND = "case when length(text) <= 40 then 'TITLE' when block_no % 13 = 0 then 'TABLE' when block_no % 17 = 0 then 'IMAGE' else 'TEXT' end"
NUMBERED = f"numbered as (select doc_id as document_id, row_number() over (partition by doc_id order by pos) as block_no, line as text from (select doc_id, unnest(range(len(ls))) as pos, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from documents)) where trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '')"
BLOCKS = f"""{NUMBERED}, typed as (select *, {KIND} as block_type from numbered),
 filled as (select *, coalesce(last_value(case when block_type = 'TITLE' then trim(text) end ignore nulls) over (partition by document_id order by block_no rows between unbounded preceding and current row), '') as section_path from typed),
 block as (select {', '.join(BLOCK_COLUMNS).replace(' div ', ' // ')} from filled)"""
RENDERED = """case when trim(text) = '' then '' when block_type = 'TITLE' and not starts_with(ltrim(text), '#') then '# ' || text when block_type = 'TABLE' and not contains(text, table_html) then '[TABLE]' || chr(10) || text || chr(10) || chr(10) || table_html
 when block_type = 'IMAGE' then '[IMAGE]' || chr(10) || image_caption else text end"""
CONTENT = f"shown as (select *, regexp_replace({RENDERED}, '^\\s+|\\s+$', '', 'g') as content from block)"
LIMIT = 800


def metadata(spark, d):
    return t(spark, d, "documents").selectExpr(*META_COLUMNS)


def block_rows(spark, d):
    from pyspark.sql import Window

    lines = t(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text")).where(F.btrim("text", F.lit(" \t\x0b\x0c\r")) != "")
    rows = lines.withColumn("block_no", F.row_number().over(Window.partitionBy("document_id").orderBy("pos")).cast("long")).withColumn("block_type", F.expr(KIND))
    return blocks.filled_sections(rows).selectExpr(*BLOCK_COLUMNS)


@query(f"with {BLOCKS}, {CONTENT} select document_id, block_no, block_type, content from shown")
def rendered_blocks(spark, d):
    return block_rows(spark, d).select("document_id", "block_no", "block_type", T.trimmed(assembly.rendered()).alias("content"))


@query(f"with {BLOCKS} select document_id, string_agg(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) order by block_no) as parsed_text from block group by document_id")
def parsed_texts(spark, d):
    return assembly.parsed_text(block_rows(spark, d))


RUNS = f"""{BLOCKS}, {CONTENT}, changed as (select *, case when lag(section_path) over (partition by document_id order by block_no) = section_path then 0 else 1 end as c from shown),
 run as (select *, sum(c) over (partition by document_id order by block_no rows unbounded preceding)::bigint as run_no from changed)"""
PARENTS = f"""{RUNS}, parent as (select document_id, run_no, string_agg(content, chr(10) || chr(10) order by block_no) filter (where content <> '') as text,
 case when count(distinct block_type) = 1 then min(block_type) else 'MIXED' end as chunk_type,
 case when max(page_no) = 0 then coalesce(arg_min(page_range, block_no) filter (where page_range <> ''), '') when min(page_no) = max(page_no) then min(page_no)::varchar else min(page_no)::varchar || '-' || max(page_no)::varchar end as page_range,
 max(section_path) as section_path, arg_min(canonical_path, block_no) as canonical_path, list(block_id order by block_no) as block_ids, count(*) as block_count, min(block_no) as first_block, max(block_no) as last_block from run group by document_id, run_no)"""


def section_parents_of(spark, d):
    rows = assembly.with_runs(block_rows(spark, d), True)
    return assembly.parents_of(rows, ["document_id", "run_no"])


@query(f"with {PARENTS} select document_id, run_no, text, chunk_type, page_range, section_path, canonical_path, array_to_string(block_ids, ',') as block_ids, block_count, first_block, last_block from parent")
def section_parents(spark, d):
    rows = section_parents_of(spark, d).drop("title", "page_no")
    return rows.withColumn("block_ids", F.array_join(F.col("block_ids").cast("array<string>"), ","))


@query(
    f"""with recursive {RUNS}, size as (select document_id, run_no, block_no, length(content) as size, row_number() over (partition by document_id, run_no order by block_no) as k from run where content <> ''),
 fits as (select document_id, run_no, sum(size) + 2 * (count(*) - 1) <= {LIMIT} as whole from size group by document_id, run_no),
 walk as (select document_id, run_no, block_no, k, 0 as window_no, size > {LIMIT} as oversize, case when size > {LIMIT} then 1000000000 else size + 2 end as used from size where k = 1
  union all select s.document_id, s.run_no, s.block_no, s.k, case when f.whole or (s.size <= {LIMIT} and w.used + s.size + 2 <= {LIMIT}) then w.window_no else w.window_no + 1 end, s.size > {LIMIT},
   case when s.size > {LIMIT} then 1000000000 when f.whole or w.used + s.size + 2 <= {LIMIT} then w.used + s.size + 2 else s.size + 2 end
   from walk w join size s on s.document_id = w.document_id and s.run_no = w.run_no and s.k = w.k + 1 join fits f on f.document_id = s.document_id and f.run_no = s.run_no)
 select document_id, run_no, block_no, window_no, oversize from walk"""
)
def packed_blocks(spark, d):
    return assembly.packed(assembly.with_runs(block_rows(spark, d), True), LIMIT)


@query(None)
def parent_seeds(spark, d):
    return assembly.parent_seeds(block_rows(spark, d), ["STRUCTURE", "SEMANTIC"], LIMIT).drop("item_index", "block_ids")


@query(f"with {PARENTS} select document_id, run_no as parent_no, (row_number() over (partition by document_id, run_no order by r.block_no) - 1)::int as child_no, block_id, content as text, r.section_path, r.canonical_path from run r join parent p using (document_id, run_no)")
def child_seeds(spark, d):
    parents = section_parents_of(spark, d).withColumnRenamed("run_no", "parent_no")
    return assembly.child_seeds(parents, block_rows(spark, d))


@query(f"with {PARENTS} select document_id, run_no as parent_no, block_count from parent p where exists (select 1 from run r where r.document_id = p.document_id and r.run_no = p.run_no and r.content <> '')")
def valid_parents(spark, d):
    parents = section_parents_of(spark, d).withColumnRenamed("run_no", "parent_no")
    return assembly.with_valid_children(parents, assembly.child_seeds(parents, block_rows(spark, d))).select("document_id", "parent_no", "block_count")


@query(f"with {PARENTS}, node as (select document_id, block_no as node_no, canonical_path, section_path, trim(text) as title from block where block_type = 'TITLE') select document_id, run_no as parent_no, (select min(node_no) from node n where n.document_id = p.document_id and (n.canonical_path = p.canonical_path or (p.section_path <> '' and (n.section_path = p.section_path or n.title = p.section_path)))) as node_no from parent p")
def parent_nodes(spark, d):
    rows = block_rows(spark, d)
    nodes = rows.where("block_type = 'TITLE'").select("document_id", F.col("block_no").alias("node_no"), "canonical_path", "section_path", F.trim("text").alias("title"))
    return assembly.nodes_of(section_parents_of(spark, d).withColumnRenamed("run_no", "parent_no"), nodes).select("document_id", "parent_no", "node_no")


QUESTIONED = f"""{PARENTS}, asked as (select document_id, run_no, text, section_path, chunk_type, list_distinct([section_path, chunk_type]) as kw,
 list_filter([case when section_path <> '' then '关于' || section_path || '的核心内容是什么？' when chunk_type <> '' then '关于' || chunk_type || '的核心内容是什么？' end,
  coalesce(nullif(section_path, ''), chunk_type) || '有哪些要求或注意事项？', case chunk_type when 'TABLE' then '这个表格说明了什么？' when 'IMAGE' then '这张图片说明了什么？' end], lambda x: x is not null) as qs from parent)"""


def questioned(spark, d):
    rows = section_parents_of(spark, d).withColumn("title", F.col("section_path")).withColumn("keywords", F.filter(F.array("section_path", "chunk_type"), lambda x: x != ""))
    return chunking.question_seed(rows)


@query(f"with {QUESTIONED} select document_id, run_no, array_to_string(qs, '|') as questions from asked")
def question_seeds(spark, d):
    return questioned(spark, d).select("document_id", "run_no", F.array_join("questions", "|").alias("questions"))


@query(
    f"""with {QUESTIONED} select document_id, run_no, case when section_path <> '' then '[TITLE]' || chr(10) || section_path || chr(10) || chr(10) || '[SECTION]' || chr(10) || section_path || chr(10) || chr(10) else '' end
 || '[CHUNK_TYPE]' || chr(10) || chunk_type || chr(10) || chr(10) || '[KEYWORDS]' || chr(10) || case when section_path <> '' then section_path || ';' else '' end || chunk_type || chr(10) || chr(10)
 || '[QUESTIONS]' || chr(10) || array_to_string(qs, ';') || chr(10) || chr(10) || '[CONTENT]' || chr(10) || text as weighted from asked"""
)
def weighted_content(spark, d):
    rows = questioned(spark, d).withColumn("weighted_body", F.lit(""))
    return assembly.weighted_content(rows).select("document_id", "run_no", "weighted")


@query(
    f"""with {BLOCKS}, {META}, tit as (select document_id, list(title order by k) as ts from (select document_id, title, k, row_number() over (partition by document_id order by k) as n from (select document_id, trim(text) as title, min(block_no) as k from block where block_type = 'TITLE' group by document_id, trim(text))) where n <= 8 group by document_id),
 p as (select m.document_id, m.document_name, coalesce(ts, []) as ts, d.text from meta m left join tit using (document_id) join documents d on d.doc_id = m.document_id),
 q as (select *, list_transform(list_concat(ts, [regexp_replace(document_name, '\\.[^.]*$', '')]), lambda x: trim(regexp_replace(x, '^[0-9]+(\\.[0-9]+)*[.、\\s]*', ''))) as raw, document_name || array_to_string(ts, ' ') || regexp_replace(text, '^\\s+|\\s+$', '', 'g') as body from p),
 r as (select *, list_slice(list_filter(raw, lambda x, i: list_position(raw, x) = i), 1, 6) as topics, case when contains(body, 'faq') then 'faq' else 'intro' end as document_type from q)
 select document_id, document_type, array_to_string(topics, '|') as topics, array_to_string(list_transform(topics, lambda x: x || '是什么意思？'), '|') as questions,
 regexp_replace('文档《' || document_name || '》' || case when len(ts) > 0 then '主要涵盖：' || array_to_string(list_slice(ts, 1, 4), '、') || '。' else '' end || '摘要：' || substring(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), 1, 180), '\\s+$', '') as summary,
 'general' as scope_code, '介绍' as category, (len(ts) >= 2)::int as supports_outline, 0 as supports_items, 0 as graph_friendly from r"""
)
def document_profiles(spark, d):
    rows = block_rows(spark, d)
    nodes = rows.select("document_id", F.col("block_no").alias("node_no"), F.when(F.col("block_type") == "TITLE", "SECTION").otherwise("CONTENT").alias("node_type"), F.trim("text").alias("title"))
    named = metadata(spark, d).select("document_id", "document_name").join(t(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text"), "document_id")
    found = profiles.profiles(named, nodes)
    return found.withColumn("topics", F.array_join("topics", "|")).withColumn("questions", F.array_join("questions", "|"))


STEPS = "step as (select doc_id as plan_id, case when i <= 2 then 'PARENT' when doc_id % 2 = 0 then '' else 'CHILD' end as pipeline, i as step_no, case (doc_id + i) % 4 when 0 then 'STRUCTURE' when 1 then 'RECURSIVE' when 2 then 'SEMANTIC' else 'LLM' end as strategy from documents, unnest(range(1, 5)) u(i))"


def steps(spark, d):
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("plan_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("step_no"))
    return rows.selectExpr("plan_id", "case when step_no <= 2 then 'PARENT' when plan_id % 2 = 0 then '' else 'CHILD' end as pipeline", "step_no", "case (plan_id + step_no) % 4 when 0 then 'STRUCTURE' when 1 then 'RECURSIVE' when 2 then 'SEMANTIC' else 'LLM' end as strategy")


@query(f"with {STEPS} select *, case when row_number() over (partition by plan_id, pipeline order by step_no) = 1 then 'PRIMARY' when strategy = 'RECURSIVE' then 'FALLBACK' when strategy = 'LLM' then 'ENHANCE' else 'OPTIMIZE' end as role from step")
def step_roles(spark, d):
    return assembly.step_roles(steps(spark, d))


@query(f"with {STEPS} select plan_id, coalesce(array_to_string(list(strategy order by step_no) filter (where strategy <> 'RECURSIVE'), ','), '') as strategies, max((strategy = 'STRUCTURE')::int) as has_structure from step where case when pipeline = '' then 'CHILD' else pipeline end = 'CHILD' group by plan_id")
def child_steps(spark, d):
    return assembly.steps_of(steps(spark, d), "CHILD", "RECURSIVE").withColumn("strategies", F.array_join("strategies", ","))


@query(f"with {STEPS}, a as (select plan_id, list(pipeline || strategy order by pipeline || strategy) as x from step group by plan_id), b as (select plan_id - 4 as plan_id, x from a) select plan_id, a.x = b.x as same from a join b using (plan_id)")
def same_steps(spark, d):
    rows = steps(spark, d)
    return assembly.same_steps(rows, rows.withColumn("plan_id", F.col("plan_id") - 4))


@query(f"with {META} select document_id, base_id, update_time from meta where index_status = 3 and last_index_task_id is not null")
def retrievable_documents(spark, d):
    return filters.retrievable(metadata(spark, d)).select("document_id", "base_id", "update_time")


@query(f"with {META} select base_id, count(*) as allowed from meta where index_status = 3 and last_index_task_id is not null and base_id in ('src1', 'src2') group by base_id")
def selected_scope(spark, d):
    rows = metadata(spark, d)
    return filters.scope_of(rows.select("base_id").distinct(), rows, "kb_chat", "SELECTED", ["src2", "src1", "src2"]).select("base_id", F.size("allowed").cast("long").alias("allowed"))


SCOPED = f"""{META}, cm as (select doc_id * {SPAN} + chunk_no as chunk_id, doc_id as document_id, last_index_task_id as task_id, lower(base_id || '/part ' || (chunk_no // 4)::varchar) as section_path, chunk_no // 4 as structure_node_id,
 '/' || base_id || '/' || chunk_no::varchar as canonical_path, (chunk_no % 5)::int as item_index from ({WINDOWS}) join meta on document_id = doc_id)"""


def scoped_chunks_of(spark, d):
    rows = chunks(spark, d).withColumnRenamed("doc_id", "document_id").join(metadata(spark, d).select("document_id", "base_id", F.col("last_index_task_id").alias("task_id")), "document_id")
    return rows.selectExpr("chunk_id", "document_id", "task_id", "lower(concat(base_id, '/part ', cast(chunk_no div 4 as string))) as section_path", "chunk_no div 4 as structure_node_id", "concat('/', base_id, '/', cast(chunk_no as string)) as canonical_path", "cast(chunk_no % 5 as int) as item_index")


DOCUMENTS, TASKS = tuple(range(1, 120)), tuple(x * 10 + 1 for x in range(1, 100))


@query(f"with {SCOPED} select chunk_id, document_id, section_path from cm where document_id in {DOCUMENTS} and task_id in {TASKS} and (section_path like '%part 1%' or section_path like '%part 2%') and structure_node_id in (1, 2, 10) and (canonical_path like '%/src1%' or canonical_path like '%/src2%') and item_index in (0, 1, 2, 3)")
def filtered_chunks(spark, d):
    hints = filters.Hints(DOCUMENTS, TASKS, ("Part 1", "Part 2"), (1, 2, 10), ("/SRC1", "/src2"), (0, 1, 2, 3))
    return filters.in_scope(scoped_chunks_of(spark, d), hints).select("chunk_id", "document_id", "section_path")


@query(
    f"""with {BM25}, {SCOPED}, ok as (select chunk_id from cm where document_id in {DOCUMENTS} and task_id in {TASKS} and (section_path like '%part 0%' or section_path like '%part 1%'))
 select question_id, chunk_id, round(sum(part), 6) as score from part where chunk_id in (select chunk_id from ok) group by question_id, chunk_id qualify row_number() over (partition by question_id order by score desc, chunk_id) <= 10"""
)
def scoped_search(spark, d):
    hints = filters.Hints(DOCUMENTS, TASKS, ("part 0", "part 1"), (3,), (), (9,)).forwarded()
    return retrieval.keyword_hits(stored_keywords(spark, d), question_terms(spark, d), 10, filters.in_scope(scoped_chunks_of(spark, d), hints))


@query(f"with {META} select document_id, case when document_id % 2 = 0 then 'given' else document_name end as document_name, coalesce(nullif(original_name, ''), '') as original_name from meta")
def metadata_fill(spark, d):
    rows = metadata(spark, d)
    candidates = rows.select("document_id", F.when(F.col("document_id") % 2 == 0, "given").otherwise(" ").alias("document_name"), F.lit(None).cast("string").alias("original_name"))
    return filters.filled_metadata(candidates, rows, ["document_name", "original_name"])


@query(f"with {META} select document_id, base_id from meta where base_id in ('src1', 'src3') and parse_status = 3")
def dynamic_where(spark, d):
    return filters.where_equal(metadata(spark, d), {"base_id": ["src1", "src3"], "parse_status": 3}).select("document_id", "base_id")


CHUNKS = f"chunk as (select doc_id as document_id, chunk_no, chunk_text, case when doc_id % 9 = 0 then null else chunk_no // {GROUP} end as parent_no, case when chunk_no % 3 = 0 then 1 else 2 end as vector_status, length(chunk_text) % 50 as tokens from ({WINDOWS})), par as (select document_id, parent_no, string_agg(chunk_text, chr(10) || chr(10) order by chunk_no) as text, 'part ' || parent_no::varchar as title from chunk where parent_no is not null group by document_id, parent_no)"


def chunk_rows(spark, d):
    found = chunking.fixed_windows(t(spark, d, "documents")).withColumnRenamed("doc_id", "document_id")
    return found.selectExpr("document_id", "chunk_no", "chunk_text", f"case when document_id % 9 = 0 then null else chunk_no div {GROUP} end as parent_no", "case when chunk_no % 3 = 0 then 1 else 2 end as vector_status", "char_length(chunk_text) % 50 as tokens")


def parent_rows(spark, d):
    rows = chunk_rows(spark, d).where("parent_no is not null").withColumnRenamed("document_id", "doc_id")
    return chunking.parents_and_children(rows, GROUP).select(F.col("doc_id").alias("document_id"), F.col("parent_no").cast("long").alias("parent_no"), F.col("parent_text").alias("text"), F.concat(F.lit("part "), F.col("parent_no").cast("string")).alias("title"))


@query(f"with {CHUNKS} select document_id, chunk_no, parent_no, title as parent_title, length(p.text) as parent_chars from chunk left join par p using (document_id, parent_no)")
def chunk_page(spark, d):
    return pages.chunk_page(chunk_rows(spark, d), parent_rows(spark, d)).select("document_id", "chunk_no", "parent_no", "parent_title", "parent_chars")


@query(f"with {CHUNKS}, sib as (select document_id, parent_no, string_agg(chunk_no::varchar, ',' order by chunk_no) as siblings from chunk group by document_id, parent_no) select document_id, chunk_no, sha256(p.text) as parent_hash, case when parent_no is not null then siblings end as siblings from chunk c left join par p using (document_id, parent_no) left join sib using (document_id, parent_no)")
def chunk_detail(spark, d):
    rows = pages.chunk_detail(chunk_rows(spark, d), parent_rows(spark, d))
    return rows.select("document_id", "chunk_no", F.sha2("parent_text", 256).alias("parent_hash"), F.array_join(F.col("siblings").cast("array<string>"), ",").alias("siblings"))


@query(f"with {CHUNKS} select document_id, parent_no, string_agg(chunk_no::varchar, ',' order by chunk_no) as chunk_nos, count(*) as chunks, row_number() over (partition by document_id order by parent_no nulls last)::int as group_order from chunk group by document_id, parent_no")
def grouped_chunks(spark, d):
    return pages.chunks_by_parent(chunk_rows(spark, d)).withColumn("chunk_nos", F.array_join(F.col("chunk_nos").cast("array<string>"), ","))


@query(f"with {CHUNKS} select document_id, count(distinct parent_no) as parents, count(*) filter (where vector_status = 2) as ready, count(*) filter (where vector_status <> 2) as pending, floor(avg(tokens) + 0.5)::bigint as avg_tokens from chunk group by document_id")
def chunk_page_stats(spark, d):
    return pages.chunk_page_stats(chunk_rows(spark, d))


RELATIONS = "rel as (select doc_id as relation_id, doc_id as document_id, quality as topic_id, round((doc_id * 37 % 100) / 100.0::double, 6) as relation_score from labels)"


def relations(spark, d):
    return t(spark, d, "labels").select(F.col("doc_id").alias("relation_id"), F.col("doc_id").alias("document_id"), F.col("quality").alias("topic_id"), F.round((F.col("doc_id") * 37 % 100) / 100.0, 6).alias("relation_score"))


@query(f"with {META}, {RELATIONS} select m.document_id, n_chars, coalesce(relation_score, 0) as relation_score from meta m left join documents d on d.doc_id = m.document_id left join rel r on r.document_id = m.document_id and topic_id = 1")
def document_route_rows(spark, d):
    profile = t(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "n_chars")
    return pages.route_rows(metadata(spark, d).select("document_id"), profile, relations(spark, d), 1)


@query(f"with {META}, {RELATIONS} select relation_id, topic_id, document_name, relation_score, row_number() over (partition by topic_id order by relation_score desc, relation_id desc)::int as position from rel left join meta using (document_id)")
def relation_documents(spark, d):
    return pages.relation_documents(relations(spark, d), metadata(spark, d).select("document_id", "document_name")).select("relation_id", "topic_id", "document_name", "relation_score", "position")


@query("select n_nationkey as topic_id, n_regionkey as scope_id, case when n_regionkey in (1, 3) then 1 else 0 end as preferred from nation")
def preferred_topics(spark, d):
    topics = t(spark, d, "nation").select(F.col("n_nationkey").alias("topic_id"), F.col("n_regionkey").alias("scope_id"))
    scopes = t(spark, d, "region").where("r_regionkey in (1, 3)").select(F.col("r_regionkey").alias("scope_id"))
    return pages.preferred_topics(topics, scopes).select("topic_id", "scope_id", "preferred")


@query(f"with {META} select parse_status, index_status, count(*) as n from meta group by all")
def status_counts(spark, d):
    return pages.counts_by(metadata(spark, d), "parse_status", "index_status")


@query(f"with {BLOCKS} select document_id, string_agg(distinct page_no::varchar, ',' order by page_no::varchar) as pages from block where block_type = 'TABLE' group by document_id")
def table_pages(spark, d):
    rows = block_rows(spark, d).withColumn("page", F.col("page_no").cast("string"))
    return pages.distinct_values(rows, "document_id", "page", F.col("block_type") == "TABLE").select("document_id", F.array_join("values", ",").alias("pages"))


@query(f"with {META} select count(*) as documents, count(*) filter (where parse_status = 3) as parsed, count(*) filter (where strategy_status = 3) as planned, count(*) filter (where index_status = 3) as indexed from meta")
def dashboard(spark, d):
    return pages.dashboard(metadata(spark, d))


@query(f"with {META} select document_id, document_name, update_time from meta where contains(document_name, 'src1') or contains(original_name, 'src1') order by update_time desc, document_id desc limit 20 offset 20")
def document_page(spark, d):
    return pages.document_page(metadata(spark, d), " src1 ", 2).select("document_id", "document_name", "update_time")


@query(f"with {META} select document_id from meta where case when document_id % 3 = 0 then 1 else 2 end = 2")
def ready_profiles(spark, d):
    return pages.ready_profiles(metadata(spark, d).withColumn("profile_status", F.when(F.col("document_id") % 3 == 0, 1).otherwise(2))).select("document_id")


@query("select event_id, user_id from events where case when event_id % 3 = 0 then 'shadow' else 'auto' end = 'auto' and event_type = 'click'")
def trace_page(spark, d):
    rows = t(spark, d, "events").withColumn("mode", F.when(F.col("event_id") % 3 == 0, "shadow").otherwise("auto")).withColumn("status", F.col("event_type"))
    return pages.trace_page(rows, None, "auto", "click").select("event_id", "user_id")


@query("select user_id, event_id, position from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id)::int as position from events) where position <= 10")
def ordered_list(spark, d):
    return pages.ordered(t(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], 10).select("user_id", "event_id", "position")


@query("select user_id, value, row_number() over (partition by user_id order by first)::int as position from (select user_id, event_type as value, min(k) as first from (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as k from events) group by user_id, event_type) qualify position <= 3")
def first_distinct(spark, d):
    return pages.first_distinct(t(spark, d, "events"), "user_id", F.col("event_type"), [F.col("ts"), F.col("event_id")], 3)


@query("select user_id, arg_max(value, event_id) as value from events where user_id is not null group by user_id")
def last_by_key(spark, d):
    return pages.last_by_key(t(spark, d, "events"), "user_id", "value", "event_id")


@query(f"with {OBSERVED} select question_id, channel, count(*) as n, max(score) as best, string_agg(chunk_id::varchar, ',' order by channel_rank) as chunks from seen group by question_id, channel")
def results_by_question(spark, d):
    return pages.results_by_question(observed(spark, d)).withColumn("chunks", F.array_join(F.col("chunks").cast("array<string>"), ","))


@query(f"with {OBSERVED} select count(distinct question_id) as accepted from seen where reason = 'selected'")
def accepted_questions(spark, d):
    return pages.accepted_questions(observed(spark, d))


TREE = f"""{BLOCKS}, tree as (select document_id, block_no::int as node_no, case when block_type = 'TITLE' then 'SECTION' else 'CONTENT' end as node_type, text as title,
 case when block_type = 'TITLE' then 0 else coalesce(last_value(case when block_type = 'TITLE' then block_no end ignore nulls) over (partition by document_id order by block_no rows between unbounded preceding and current row), 0) end::int as parent_no from block),
 sib as (select *, lag(node_no) over w as prev_no, lead(node_no) over w as next_no from tree window w as (partition by document_id, parent_no order by node_no))"""


def tree_of(spark, d):
    return blocks.with_siblings(blocks.structure_tree(block_rows(spark, d).withColumn("heading_level", F.lit(1))))


@query(
    f"""with {TREE}, kid as (select document_id, parent_no as node_no, string_agg(title, '|' order by node_no) as children from tree group by document_id, parent_no)
 select s.document_id, s.node_no, s.title, p.title as parent_title, v.title as prev_title, n.title as next_title, coalesce(children, '') as children from sib s left join tree p on p.document_id = s.document_id and p.node_no = s.parent_no
 left join tree v on v.document_id = s.document_id and v.node_no = s.prev_no left join tree n on n.document_id = s.document_id and n.node_no = s.next_no left join kid k on k.document_id = s.document_id and k.node_no = s.node_no where s.node_type = 'SECTION'"""
)
def graph_result(spark, d):
    return pages.graph_result(tree_of(spark, d)).withColumn("children", F.array_join("children", "|"))


@query(f"with {TREE} select document_id, node_no, 999 + node_no as node_id, case when parent_no > 0 then 999 + parent_no end as parent_id, 999 + prev_no as prev_id, 999 + next_no as next_id from sib")
def node_ids(spark, d):
    return pages.with_node_ids(tree_of(spark, d), 1000).select("document_id", "node_no", "node_id", "parent_id", "prev_id", "next_id")


@query(
    "select doc_id, i::int as line_no, pos as char_start, pos + length(line) as char_end, octet_length(encode(substring(text, 1, pos))) as byte_start from (select doc_id, text, i, line, coalesce(sum(length(line) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as pos from (select doc_id, text, unnest(range(len(string_split(text, chr(10))))) as i, unnest(string_split(text, chr(10))) as line from documents))"
)
def line_spans(spark, d):
    return parsers.line_spans(t(spark, d, "documents"))


@query(f"with {WINDOWS.replace('select doc_id', 'w as (select doc_id', 1)}) select doc_id as document_id, chunk_no // 4 as parent_no, count(*) as child_count, min(chunk_no) as start_chunk_no, max(chunk_no) as end_chunk_no from w group by doc_id, chunk_no // 4")
def parent_numbers(spark, d):
    return chunking.parents_and_children(chunking.fixed_windows(t(spark, d, "documents")), 4).select(F.col("doc_id").alias("document_id"), "parent_no", "child_count", "start_chunk_no", "end_chunk_no")


@query(None)
def parent_evidence(spark, d):
    hits = retrieval.candidates(fused_hits(spark, d), PLAN.candidates).withColumn("parent_key", F.expr(f"chunk_id div {SPAN} * {SPAN} + (chunk_id % {SPAN}) div {GROUP}"))
    rows = chunks(spark, d).withColumn("parent_key", F.expr(f"chunk_id div {SPAN} * {SPAN} + (chunk_id % {SPAN}) div {GROUP}"))
    texts = rows.groupBy("parent_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk_text"))), lambda x: x["chunk_text"]), "\n\n").alias("parent_text"))
    return retrieval.parent_evidence(hits.join(rows.select("chunk_id", "chunk_no", "chunk_text"), "chunk_id").join(texts, "parent_key"), 2200)
