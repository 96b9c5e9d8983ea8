"""All queries of the retrieval engine by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import vectors as V
from docloom.operators import admin, blocks, chunking, conversation, retrieval, routing
from docloom.plans.options import Plan
from docloom.sources import index, keyword_index, parsers

QUERIES: dict = {}
ORACLES: dict = {}
PLAN = Plan()
#: Questions are all benchmark items and vectors whose id is divisible by this, against all chunks and vectors; bm25_topk asks all benchmark items.
ASKED = 20
#: Chunk numbers of a document lie below this, so (document, chunk) is one number; GROUP chunks are a parent.
SPAN, GROUP = 1 << 20, 4
#: Key terms of a topic that a route looks for; topics of documents up to which they are broadcast to the documents' terms.
KEY_TERMS, MOST_BROADCAST = 200, 1_000_000


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WINDOWS = "select doc_id, cast(n as int) as chunk_no, substring(text, n * 360 + 1, 400) as chunk_text from (select doc_id, text, unnest(range(0, greatest(0, (length(text) - 41) // 360) + 1)) as n from documents where length(text) > 0)"


def chunks(spark, d):
    return chunks_of(t(spark, d, "documents"))


def chunks_of(documents):
    found = chunking.fixed_windows(documents)
    return found.select((F.col("doc_id") * SPAN + F.col("chunk_no")).alias("chunk_id"), "doc_id", "chunk_no", "chunk_text")


@query(WINDOWS)
def chunk_fixed_window(spark, d):
    return chunking.fixed_windows(t(spark, d, "documents"))


@query(
    "with c as (select doc_id, cast(n as int) as chunk_no, substring(text, n * 300 + 1, 300) as chunk_text from (select doc_id, text, unnest(range(0, (length(text) - 1) // 300 + 1)) as n from documents where length(text) > 0)),"
    " p as (select *, coalesce(right(lag(chunk_text) over (partition by doc_id order by chunk_no), greatest(0, least(60, 340 - length(chunk_text) - 1))), '') as prefix from c)"
    " select doc_id, chunk_no, prefix, case when prefix = '' then chunk_text else prefix || chr(10) || chunk_text end as chunk_text from p"
)
def chunk_overlap_prefix(spark, d):
    return chunking.overlap_prefixes(chunking.fixed_windows(t(spark, d, "documents"), 300, 0), 340, 60)


TOKENS = r"(len(regexp_extract_all({0}, '\p{{Han}}')) + len(regexp_extract_all({0}, '[^ \t\n\f\r]*[A-Za-z][^ \t\n\f\r]*')) + greatest(1, (length({0}) - len(regexp_extract_all({0}, '\p{{Han}}')) - len(regexp_extract_all({0}, '[^ \t\n\f\r]*[A-Za-z][^ \t\n\f\r]*'))) // 4))"


@query(f"select doc_id, {TOKENS.format('text')}::bigint as tokens from documents")
def token_estimate(spark, d):
    return t(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


LINE_BLOCKS = "select doc_id as document_id, line as text, case when length(line) <= 80 and (line like '%:' or line like '%：') then 'TITLE' else 'Text' end as block_type from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where trim(line) <> ''"


def line_blocks(spark, d):
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.explode(F.split("text", "\n")).alias("text")).where(F.trim("text") != "")
    return rows.withColumn("block_type", F.when((F.char_length("text") <= 80) & (F.col("text").endswith(":") | F.col("text").endswith("：")), "TITLE").otherwise("Text"))


STATS = f"""select document_id, count(*) as block_count, count(*) filter (where block_type = 'TITLE') as heading_count, count(*) filter (where block_type <> 'TITLE') as paragraph_count,
 coalesce(max(length(text)) filter (where block_type <> 'TITLE'), 0) as max_paragraph, sum(length(text))::bigint as char_count from ({LINE_BLOCKS}) group by document_id"""
LEVELS = f"""select *, case when heading_count >= 10 or block_count >= 30 then 3 when heading_count >= 3 or block_count >= 10 then 2 when heading_count >= 1 or block_count >= 5 then 1 else 0 end as structure_level,
 case when char_count >= 5000 and block_count >= 10 and max_paragraph >= 100 then 3 when char_count >= 1000 and block_count >= 3 then 2 when char_count >= 100 then 1 else 0 end as quality_level from ({STATS})"""


@query(LEVELS)
def doc_stats_levels(spark, d):
    return blocks.stats(line_blocks(spark, d))


@query(
    f"""select document_id, use_structure, use_recursive, use_semantic, 'PARENT:' || case when use_structure then 'STRUCTURE' else 'RECURSIVE' end || ';CHILD:' ||
 case when use_semantic and use_recursive then 'SEMANTIC>RECURSIVE' when use_semantic then 'SEMANTIC' else 'RECURSIVE' end as snapshot
 from (select document_id, structure_level >= 2 or heading_count >= 2 as use_structure, char_count >= 800 or max_paragraph > 800 as use_recursive, char_count >= 240 and paragraph_count >= 3 and quality_level >= 2 as use_semantic from ({LEVELS}))"""
)
def strategy_recommendation(spark, d):
    return chunking.recommend_strategy(blocks.stats(line_blocks(spark, d))).select("document_id", "use_structure", "use_recursive", "use_semantic", "snapshot")


@query(
    "with x as (select doc_id, list_filter(list_concat([source], list_concat(string_split(lang || '/' || source, '/'), regexp_extract_all(text, '[A-Za-z0-9]+'))), lambda x: octet_length(encode(x)) >= 2) as k from documents),"
    " u as (select doc_id, word, min(i) as i from (select doc_id, unnest(k) as word, generate_subscripts(k, 1) as i from x) group by doc_id, word),"
    " r as (select *, row_number() over (partition by doc_id order by i) as n from u)"
    " select doc_id, string_agg(word, ',' order by i) as keywords from r where n <= 12 group by doc_id"
)
def keyword_seed(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.concat_ws("/", "lang", "source").alias("section_path"), "text")
    return chunking.keyword_seed(rows).where(F.size("keywords") > 0).select("doc_id", F.array_join("keywords", ",").alias("keywords"))


@query(
    "with l as (select doc_id, unnest(range(len(ls))) as n, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from documents)),"
    r" s as (select doc_id, n, list_distinct(regexp_extract_all(lower(line), '[a-z0-9]{2,}|\p{Han}')) as a, lag(list_distinct(regexp_extract_all(lower(line), '[a-z0-9]{2,}|\p{Han}'))) over (partition by doc_id order by n) as b from l)"
    " select doc_id, n::int as line_no, round(case when len(a) = 0 or len(b) = 0 then 0 else len(list_intersect(a, b))::double / (len(a) + len(b) - len(list_intersect(a, b))) end, 6) as similarity from s where b is not null"
)
def jaccard_adjacent(spark, d):
    from pyspark.sql import Window

    rows = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("a", T.token_set(F.col("line")))
    rows = rows.withColumn("b", F.lag("a").over(Window.partitionBy("doc_id").orderBy("line_no"))).where("b is not null")
    return rows.select("doc_id", "line_no", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


def item_terms(items):
    return items.select(F.col("item_id").alias("question_id"), F.explode(F.array_distinct(index.terms_of(F.col("text")))).alias("term"))


def question_terms(spark, d):
    return item_terms(t(spark, d, "benchmark").where(F.col("item_id") % ASKED == 0))


BM25 = rf"""chunk as (select doc_id * {SPAN} + chunk_no as chunk_id, lower(chunk_text) as x from ({WINDOWS})),
 terms as (select chunk_id, regexp_extract_all(x, '[a-z0-9]{{2,}}|\p{{Han}}') as ts from chunk),
 st as (select count(*) as n, avg(len(ts)) as al from terms),
 qt as (select distinct item_id as question_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}|\p{{Han}}')) as term from benchmark where item_id % {ASKED} = 0),
 post as (select chunk_id, dl, term, count(*) as tf from (select chunk_id, len(ts) as dl, unnest(ts) as term from terms) where term in (select term from qt) group by all),
 df as (select term, count(*) as df from post group by term),
 part as (select question_id, chunk_id, ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / al)) as part from qt join post using (term) join df using (term), st),
 kw as (select question_id, chunk_id, round(sum(part), 6) as score from part group by question_id, chunk_id qualify row_number() over (partition by question_id order by score desc, chunk_id) <= 10)"""


def stored_keywords(spark, d):
    def build(folder):
        keyword_index.add(keyword_index.create(spark, folder), chunks(spark, d).withColumnRenamed("doc_id", "document_id"))

    return keyword_index.open_index(spark, index.stored(spark, "keywords", f"{d}/documents.parquet", build))


def keyword_channel(spark, d):
    return retrieval.keyword_hits(stored_keywords(spark, d), question_terms(spark, d))


@query(f"with {BM25.replace(f' where item_id % {ASKED} = 0', '')} select * from kw")
def bm25_topk(spark, d):
    """Every benchmark item is a question."""
    return retrieval.keyword_hits(stored_keywords(spark, d), item_terms(t(spark, d, "benchmark")))


@query(f"with {BM25}, m as (select *, max(score) over (partition by question_id) as best from kw) select question_id, chunk_id, score from m where best > 0 and score >= best * 0.35")
def bm25_gate(spark, d):
    return retrieval.keyword_gate(keyword_channel(spark, d), 0.35)


COSINE = f"""vec as (select vec_id, cast(embedding as double[]) as v from embeddings),
 dot as (select q.vec_id as question_id, c.vec_id * {SPAN} as chunk_id, list_inner_product(q.v, c.v) as p, sqrt(list_inner_product(q.v, q.v)) as nq, sqrt(list_inner_product(c.v, c.v)) as nc from vec q, vec c where q.vec_id % {ASKED} = 0),
 vh as (select question_id, chunk_id, round(case when nq = 0 or nc = 0 then 0 else p / (nq * nc) end, 6) as score from dot qualify row_number() over (partition by question_id order by score desc, chunk_id) <= 10)"""


def vector_channel(spark, d):
    e = t(spark, d, "embeddings")
    return retrieval.vector_hits(e.where(F.col("vec_id") % ASKED == 0).select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("query")), e.select((F.col("vec_id") * SPAN).alias("chunk_id"), F.col("embedding").alias("vector")))


@query(f"with {COSINE} select * from vh")
def cosine_topk(spark, d):
    return vector_channel(spark, d)


@query(f"with {COSINE} select * from vh where score >= 0.45")
def cosine_gate(spark, d):
    return retrieval.vector_gate(vector_channel(spark, d), 0.45)


BAG = f"""{BM25}, {COSINE}, raw as (select question_id, 'keyword' as channel, chunk_id, score from kw union all select question_id, 'vector', chunk_id, score from vh),
 kept as (select question_id, channel, chunk_id, score from (select *, max(score) over (partition by question_id, channel) as best from raw) where (channel = 'vector' and score >= 0.45) or (channel = 'keyword' and best > 0 and score >= best * 0.35)),
 ranked as (select *, 1.0::double / (60 + row_number() over (partition by question_id, channel order by score desc, chunk_id)) as part, greatest(0, max(score) over (partition by question_id, channel)) as best from kept),
 fused as (select question_id, chunk_id, round(sum(part), 6) as rrf, round(sum(61 * part) + sum(0.08::double * case when best > 0 then least(1, score / best) else 0 end), 6) as fused_score,
   case when count(distinct channel) > 1 then 'hybrid' else min(channel) end as channel from ranked group by question_id, chunk_id)"""


def raw_hits(spark, d):
    """Every channel is searched once, however often its hits are read."""
    return {"keyword": index.once(keyword_channel(spark, d)), "vector": index.once(vector_channel(spark, d))}


def fused_hits(spark, d):
    return retrieval.fuse(retrieval.gated_channels(raw_hits(spark, d), PLAN), PLAN)


@query(f"with {BAG} select * from fused")
def rrf_fusion(spark, d):
    return fused_hits(spark, d)


HYBRID = "select question_id, chunk_id, fused_score, channel, row_number() over (partition by question_id order by fused_score desc, chunk_id)::int as final_rank from fused qualify final_rank <= 6"


@query(f"with {BAG} {HYBRID}")
def hybrid_search(spark, d):
    return retrieval.final_hits(retrieval.candidates(fused_hits(spark, d), PLAN.candidates), PLAN.final_top_k)


UP = f"""{BAG}, cand as (select * from fused qualify row_number() over (partition by question_id order by fused_score desc, chunk_id) <= 40),
 up as (select *, chunk_id // {SPAN} * {SPAN} + chunk_id % {SPAN} // {GROUP} as parent from cand),
 par as (select question_id, parent::varchar as parent_key, round(max(fused_score) * (1 + least(0.36::double, 0.12::double * (count(*) - 1)) + case when count(distinct channel) > 1 then 0.10::double else 0 end), 6) as score,
   count(*) as child_count, arg_max(chunk_id, (fused_score, -chunk_id)) as best_child, case when count(distinct channel) > 1 then 'hybrid' else min(channel) end as channel, min(chunk_id) as first_child from up group by question_id, parent)"""


def child_parents(hits):
    return hits.select("chunk_id").distinct().withColumn("parent_id", F.expr(f"chunk_id div {SPAN} * {SPAN} + (chunk_id % {SPAN}) div {GROUP}"))


def elevated(spark, d):
    cut = retrieval.candidates(fused_hits(spark, d), PLAN.candidates)
    return retrieval.elevate(cut, child_parents(cut))


@query(f"with {UP} select *, row_number() over (partition by question_id order by score desc, first_child, best_child)::int as parent_rank from par")
def parent_elevation(spark, d):
    return retrieval.ranked_parents(elevated(spark, d))


OBSERVED = f"""{BAG}, o as (select r.question_id, r.channel, r.chunk_id, r.score, row_number() over (partition by r.question_id, r.channel order by r.score desc, r.chunk_id)::int as channel_rank,
   case when k.chunk_id is null then 0 else 1 end as accepted, f.rk from raw r left join kept k using (question_id, channel, chunk_id)
   left join (select question_id, chunk_id, row_number() over (partition by question_id order by fused_score desc, chunk_id)::int as rk from fused) f using (question_id, chunk_id)),
 seen as (select question_id, channel, chunk_id, score, channel_rank, accepted, case when accepted = 1 then rk end as rrf_rank, case when accepted = 1 and rk <= 6 then rk end as final_rank,
   case when accepted = 0 then 'below_gate' when rk > 6 then 'below_top_k' else 'selected' end as reason from o)"""


def observed(spark, d):
    hits = raw_hits(spark, d)
    bag = None
    for name, rows in hits.items():
        rows = rows.select("question_id", F.lit(name).alias("channel"), "chunk_id", "score")
        bag = rows if bag is None else bag.unionByName(rows)
    gated = retrieval.gated_channels(hits, PLAN)
    return retrieval.observe(bag, gated, retrieval.fuse(gated, PLAN), PLAN.final_top_k)


@query(f"with {OBSERVED} select question_id, channel, chunk_id, score, channel_rank, accepted, coalesce(rrf_rank, 0) as rrf_rank, coalesce(final_rank, 0) as final_rank, reason from seen")
def observation_rows(spark, d):
    return observed(spark, d).fillna(0, ["rrf_rank", "final_rank"])


@query(f"with {OBSERVED} select question_id, channel, count(*) as recalled, sum(accepted)::bigint as accepted, count(*) filter (where reason = 'selected') as selected, round(avg(score), 6) as avg_score, max(score) as max_score, min(score) as min_score from seen group by question_id, channel")
def channel_stats(spark, d):
    return retrieval.channel_stats(observed(spark, d))


@query(
    f"""with {BAG}, ev as (select question_id, final_rank as position, 'D' || (chunk_id // {SPAN})::varchar as citation_key from ({HYBRID})),
 num as (select answer_id, citation_key, row_number() over (partition by answer_id order by q, p, citation_key)::int as citation_id
   from (select question_id // 60 as answer_id, citation_key, min(question_id) as q, arg_min(position, (question_id, position)) as p from ev group by all))
 select question_id, position, ev.citation_key, citation_id from ev join num on answer_id = question_id // 60 and num.citation_key = ev.citation_key"""
)
def citation_ids(spark, d):
    """An answer has the questions with numbers up to the next multiple of 60."""
    ev = hybrid_search(spark, d).select("question_id", F.col("final_rank").alias("position"), F.concat(F.lit("D"), F.expr(f"chunk_id div {SPAN}").cast("string")).alias("citation_key"))
    return retrieval.citation_ids(ev.withColumn("answer_id", F.expr("question_id div 60")), "answer_id").select("question_id", "position", "citation_key", "citation_id")


@query("select conv_id, turn, role, text from conversations qualify row_number() over (partition by conv_id order by turn desc) = 1")
def latest_turn(spark, d):
    return conversation.latest(t(spark, d, "conversations"), "conv_id", ["turn"]).select("conv_id", "turn", "role", "text")


@query("select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn desc)::int as age from conversations qualify age <= 3")
def recent_turns(spark, d):
    return conversation.recent(t(spark, d, "conversations"), 3)


@query(
    r"select conv_id, turn, (n - 1) // 2 as batch_no from (select conv_id, turn, row_number() over (partition by conv_id order by turn desc) as age, row_number() over (partition by conv_id order by turn) as n from conversations where trim(text) <> '') where age > 2"
)
def overflow_batches(spark, d):
    return conversation.overflow_batches(t(spark, d, "conversations"), 2, 2)


@query("select conv_id, turn, string_agg(text, chr(10)) over (partition by conv_id order by turn rows between 2 preceding and current row) as window_text from conversations")
def memory_window(spark, d):
    return conversation.memory_window(t(spark, d, "conversations"), 3)


@query(
    "select conv_id, turn, answer_turn, question, answer from (select conv_id, turn, role, text as question, lead(role) over w as nr, lead(text) over w as answer, lead(turn) over w as answer_turn from conversations window w as (partition by conv_id order by turn)) where role = 'user' and nr = 'assistant'"
)
def turn_pairs(spark, d):
    return conversation.turn_pairs(t(spark, d, "conversations"))


@query("select conv_id, count(*) as turns from conversations c where exists (select 1 from conversations x where x.conv_id = c.conv_id and contains(lower(x.text), 'the')) group by conv_id")
def session_search_exists(spark, d):
    return conversation.search(t(spark, d, "conversations"), "the")


@query("select conv_id, turn as last_turn from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) where n = 1 and role = 'assistant'")
def latest_status_filter(spark, d):
    return conversation.with_latest_role(t(spark, d, "conversations"), "assistant")


@query("select conv_id, count(*) filter (where role = 'user') as questions, count(*) filter (where role = 'assistant') as answers, count(*) filter (where role in ('user', 'assistant')) as messages from (select conv_id, case when trim(text) <> '' then role end as role from conversations) group by conv_id")
def message_counts(spark, d):
    return conversation.message_counts(t(spark, d, "conversations"))


@query(f"select conv_id, sum(k)::bigint as tokens, round(sum(k) * 0.002::double / 1000, 6) as cost, max(k) as longest from (select conv_id, {TOKENS.format('text')}::bigint as k from conversations) group by conv_id")
def token_cost(spark, d):
    return conversation.token_cost(t(spark, d, "conversations"))


@query(
    r"""with u as (select conv_id, turn, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') as x from conversations where role = 'user' and regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''),
 c as (select conv_id, turn, case when length(x) > 80 then left(x, 79) || '…' else x end as item from u),
 n as (select conv_id, item, max(turn) as newest from c group by conv_id, item qualify row_number() over (partition by conv_id order by max(turn) desc) <= 4),
 h as (select conv_id, string_agg(item, '|' order by newest desc) as highlights from n group by conv_id)
 select conv_id, arg_min(item, turn) as goal, any_value(highlights) as highlights, max(turn) as covered_turn, count(*)::int as covered_count from c join h using (conv_id) group by conv_id"""
)
def conversation_summary(spark, d):
    found = conversation.merged_summary(t(spark, d, "conversations"))
    return found.withColumn("highlights", F.array_join("highlights", "|"))


ROUTE = rf"""cen as (select label, list(x order by i) as v from (select label, i, avg(x) as x from (select label, unnest(cast(embedding as double[])) as x, generate_subscripts(embedding, 1) as i from embeddings) group by label, i) group by label),
 doc as (select vec_id, label, source, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}|\p{{Han}}')) as ts from embeddings join documents on doc_id = vec_id),
 kt as (select label, term from (select label, term, count(*) as n from (select label, unnest(ts) as term from doc) group by label, term) qualify row_number() over (partition by label order by n desc, term) <= {KEY_TERMS}),
 top_src as (select label, source from (select label, source, count(*) as n from doc group by label, source) qualify row_number() over (partition by label order by n desc, source) = 1),
 q as (select vec_id as question_id, cast(embedding as double[]) as v from embeddings where vec_id % {ASKED} = 0),
 sc as (select question_id, label as candidate, round(list_inner_product(q.v, cen.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(cen.v, cen.v))), 6) as sem from q, cen),
 lx as (select vec_id as question_id, kt.label as candidate, round(ln(1 + count(*)::double), 6) as lexical from (select vec_id, unnest(ts) as term from doc where vec_id % {ASKED} = 0) join kt using (term) group by vec_id, kt.label),
 rl as (select vec_id as question_id, s.label as candidate, 1.0::double as relation from doc join top_src s using (source) where vec_id % {ASKED} = 0),
 feat as (select question_id, candidate, sem, coalesce(lexical, 0) as lexical, coalesce(relation, 0) as relation from sc left join lx using (question_id, candidate) left join rl using (question_id, candidate)),
 scored as (select question_id, candidate, round(case when sem > 0.2::double then (sem - 0.2::double) * 50 else 0 end + least(lexical * 1.6::double, 10) + relation * 8, 6) as score,
   case when (sem > 0.2::double)::int + (lexical > 0)::int + (relation > 0)::int > 1 then 'COMPOSITE' when sem > 0.2::double then 'SEMANTIC' when lexical > 0 then 'LEXICAL' when relation > 0 then 'RELATION' else 'NONE' end as source from feat)"""


def document_terms(spark, d):
    """The distinct terms of every document, taken from the texts once for all route queries."""
    rows = t(spark, d, "documents").select("doc_id", "source", F.array_distinct(index.terms_of(F.col("text"))).alias("terms"))
    return spark.read.schema(rows.schema).parquet(index.stored(spark, "terms", f"{d}/documents.parquet", lambda folder: rows.write.parquet(folder)))


def routed(spark, d):
    """Questions (vectors, with the text of the document of that id) against topics (labels): centroids, shared key terms, and the topic's main source.

    The scores are made once, however often they are read. The terms of documents are not shuffled unless MOST_BROADCAST is passed.
    """
    from pyspark.sql import Window

    e = t(spark, d, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))
    labels = e.select("vec_id", "label")
    labels = F.broadcast(labels) if e.count() <= MOST_BROADCAST else labels
    docs = document_terms(spark, d).withColumnRenamed("doc_id", "vec_id").join(labels, "vec_id")
    counts = docs.groupBy("label", "source").agg(F.count("*").alias("n")).withColumn("at", F.row_number().over(Window.partitionBy("label").orderBy(F.col("n").desc(), "source")))
    main = counts.where("at = 1").select(F.col("label").alias("candidate"), "source")
    asked = docs.where(F.col("vec_id") % ASKED == 0).withColumnRenamed("vec_id", "question_id")
    lexical = routing.lexical_hits(asked, routing.key_terms(docs, "label", KEY_TERMS), "label").withColumnRenamed("label", "candidate")
    relation = asked.join(main, "source").select("question_id", "candidate", F.lit(1.0).alias("relation"))
    # every question meets every topic, in blocks
    topics = routing.centroids(e, "label").select(F.col("label").cast("long").alias("chunk_id"), F.col("cv").alias("vector"))
    pairs = retrieval.vector_hits(e.where(F.col("vec_id") % ASKED == 0).select(F.col("vec_id").alias("question_id"), F.col("v").alias("query")), topics, topics.count())
    rows = pairs.select("question_id", F.col("chunk_id").cast(e.schema["label"].dataType).alias("candidate"), F.col("score").alias("sem"))
    rows = rows.join(lexical, ["question_id", "candidate"], "left").join(relation, ["question_id", "candidate"], "left").fillna(0.0, ["lexical", "relation"])
    parts = [F.col(x) for x in ("sem", "lexical", "relation")]
    return index.once(rows.select("question_id", "candidate", F.round(routing.route_score(*parts), 6).alias("score"), routing.route_source(*parts).alias("source")))


@query(f"with {ROUTE} select * from scored")
def route_score(spark, d):
    return routed(spark, d)


@query(f"with {ROUTE} select question_id, candidate, score, source, row_number() over (partition by question_id order by score desc, candidate)::int as position from scored where score > 0 qualify position <= 5")
def ranked_routes(spark, d):
    return routing.ranked(routed(spark, d), routing.TOP_DOCUMENTS)


@query(
    f"""with {ROUTE}, n as (select question_id, score, row_number() over (partition by question_id order by score desc, candidate) as k from scored),
 tops as (select question_id, max(score) filter (where k = 1) as top1, coalesce(max(score) filter (where k = 2), 0) as top2 from n group by question_id)
 select question_id, top1, top2, round(case when top1 <= 0 then 0 else top1 / greatest(10, top1 + top2 + 5) end, 6) as confidence, case when confidence <= 0 then 'FAILED' when confidence < 0.55 then 'LOW_CONFIDENCE' else 'SUCCESS' end as status from tops"""
)
def route_confidence(spark, d):
    return routing.confidence(routed(spark, d), "question_id")


@query(
    f"""with {ROUTE}, hi as (select question_id, candidate, score from scored where score > 12),
 ext as (select * from hi union all select question_id, candidate, 0 from (select distinct question_id from hi), (select distinct candidate from scored) b)
 select question_id, candidate, score from (select *, row_number() over (partition by question_id order by score desc, candidate) as n from (select question_id, candidate, max(score) as score from ext group by question_id, candidate)) where n <= 5"""
)
def route_expansion(spark, d):
    scored = routed(spark, d)
    return routing.expand_low(scored.where("score > 12"), scored.select("candidate"), "question_id", 5)


@query("select d.source, count(*) as documents, count(l.doc_id) as labelled, round(count(l.doc_id)::double / count(*), 6) as coverage from documents d left join labels l using (doc_id) group by d.source")
def label_coverage(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels").select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("documents"), F.count("has").alias("labelled"), F.round(F.count("has") / F.count("*"), 6).alias("coverage"))


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def unlinked_docs(spark, d):
    return t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels"), "doc_id", "left_anti")


@query("select event_type, count(*) as n, count(*) filter (where value >= 50) as high, count(distinct user_id) as users, round(avg(value), 6) as avg_value from events group by event_type")
def trace_summary(spark, d):
    return admin.status_summary(t(spark, d, "events"), "event_type", "value", 50)


@query("select user_id, count(*) as n, round(avg(value), 6) as avg_value, count(*) filter (where event_type <> 'click') as other from events group by user_id order by n desc, user_id limit 6")
def top_distribution(spark, d):
    return admin.top_distribution(t(spark, d, "events"), "user_id", "value", "click")


@query("select n_nationkey, n_name, count(c_custkey) as n from nation left join customer on c_nationkey = n_nationkey group by n_nationkey, n_name")
def group_count_left_join(spark, d):
    customers = t(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    return admin.counts_with_missing(t(spark, d, "nation").select("n_nationkey", "n_name"), customers, "n_nationkey")


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def scope_semi(spark, d):
    orders = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left_semi")


@query("select o_custkey, count(distinct o_orderstatus) as kinds from orders group by o_custkey having count(distinct o_orderstatus) > 1")
def scope_conflict(spark, d):
    return admin.scope_conflicts(t(spark, d, "orders"), "o_custkey", "o_orderstatus")


@query("select event_id, user_id, coalesce(last_value(case when event_type = 'click' then event_id::varchar end ignore nulls) over (partition by user_id order by k rows between unbounded preceding and current row), '') as section_path from (select *, row_number() over (order by ts, event_id) as k from events)")
def section_fill(spark, d):
    rows = t(spark, d, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") == "click", "TITLE").otherwise("Text").alias("block_type"), F.col("event_id").cast("string").alias("text"))
    return blocks.filled_sections(rows, "at", "user_id").select("event_id", "user_id", "section_path")


@query("select event_id, user_id, sum(c) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row)::bigint as run_no from (select *, case when event_type = lag(event_type) over (partition by user_id order by ts, event_id) then 0 else 1 end as c from events)")
def section_runs(spark, d):
    return blocks.section_runs(t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "run_no")


@query("select doc_id, source, n_chars from documents order by n_chars desc, doc_id limit 20 offset 20")
def page_offset(spark, d):
    return admin.page(t(spark, d, "documents").select("doc_id", "source", "n_chars"), [F.col("n_chars").desc(), F.col("doc_id")], 2)


@query("select * from (values ('channelTimeout', '12', 0), ('finalTopK', '6', 1), ('keywordTopK', '10', 1), ('vectorTopK', '8', 0)) v(option_key, option_value, conflict)")
def config_merge(spark, d):
    stated = [(1, "vectorTopK", "8"), (2, "vectorTopK", "8"), (1, "keywordTopK", "5"), (2, "keywordTopK", "7"), (1, "finalTopK", "4")]
    defaults = {"vectorTopK": "10", "keywordTopK": "10", "finalTopK": "6", "channelTimeout": "12"}
    return routing.merge_options(spark.createDataFrame(stated, "base_id int, option_key string, option_value string"), defaults)


@query("select time_bucket(interval '1 hour', ts) as start_ts, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def events_tumbling(spark, d):
    return admin.tumbling(t(spark, d, "events"), "1 hour")


@query("with g as (select user_id, ts, sum(c) over (partition by user_id order by ts rows unbounded preceding) as s from (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as c from events)) select user_id, min(ts) as start_ts, max(ts) + interval 30 minute as end_ts, count(*) as n from g group by user_id, s")
def events_session_window(spark, d):
    return admin.sessions_by_gap(t(spark, d, "events"), 30)


@query("select event_type, user_id, event_id from events qualify row_number() over (partition by event_type, user_id order by ts desc, event_id desc) = 1")
def latest_per_pair(spark, d):
    best = t(spark, d, "events").groupBy("event_type", "user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return best


@query("select doc_id, sha256(source || text) as content_hash from documents")
def content_hashes(spark, d):
    return t(spark, d, "documents").select("doc_id", T.content_hash(F.col("source"), F.col("text")).alias("content_hash"))


@query("select doc_id, case when length(text) > 100 then substring(text, 1, 99) || '…' else text end as head, case when length(text) > 100 then '…' || right(text, 99) else text end as tail from documents")
def clipped_texts(spark, d):
    return t(spark, d, "documents").select("doc_id", T.clip_head(F.col("text"), 100).alias("head"), T.clip_tail(F.col("text"), 100).alias("tail"))


@query("select o_orderpriority, count(*) as n, max(o_totalprice) as largest, count(distinct o_custkey) as customers from orders where o_orderdate >= timestamp '1995-01-01' group by o_orderpriority")
def stage_totals(spark, d):
    return t(spark, d, "orders").where("o_orderdate >= timestamp '1995-01-01'").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("largest"), F.count_distinct("o_custkey").alias("customers"))


@query(
    "with f as (select doc_id, source, unnest(range(len(ls))) as pos, unnest(ls) as line from (select doc_id, source, string_split(text, chr(10)) as ls from documents)), r as (select doc_id, pos % 2 as question_no, pos as position, length(line) as size, row_number() over (partition by doc_id order by pos % 2, pos) as n from f) select doc_id as answer_id, count(*) as refs from r group by doc_id"
)
def evidence_counts(spark, d):
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("answer_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.groupBy("answer_id").agg(F.count("*").alias("refs"))


@query(
    """with recursive r as (select doc_id as answer_id, pos % 3 as question_no, pos::int as position, length(line) as size from (select doc_id, unnest(range(len(ls))) as pos, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from documents))),
 o as (select *, row_number() over (partition by answer_id order by question_no, position) as k from r),
 f as (select answer_id, k, question_no, position, size, size <= 2200 as rendered, case when size <= 2200 then size else 0 end as used, case when size <= 2200 then size else 0 end as own, size > 2200 as stopped from o where k = 1
  union all select answer_id, k, question_no, position, size, fits, used + case when fits then size else 0 end, own + case when fits then size else 0 end, not fits
   from (select o.answer_id, o.k, o.question_no, o.position, o.size, f.used, case when o.question_no = f.question_no then f.own else 0 end as own,
     not (o.question_no = f.question_no and f.stopped) and f.used + o.size <= 5200 and case when o.question_no = f.question_no then f.own else 0 end + o.size <= 2200 as fits from f join o on o.answer_id = f.answer_id and o.k = f.k + 1))
 select answer_id, question_no::bigint as question_no, position, size::bigint as size, rendered from f"""
)
def evidence_budget(spark, d):
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("answer_id"), F.posexplode(F.split("text", "\n")).alias("position", "line"))
    return conversation.evidence_budget(rows.select("answer_id", (F.col("position") % 3).cast("long").alias("question_no"), "position", F.char_length("line").cast("long").alias("size")), 5200, 2200)


@query(None)
def chunk_recursive(spark, d):
    return chunking.chunk_by(t(spark, d, "documents"), "recursive")


@query(None)
def chunk_semantic(spark, d):
    return chunking.chunk_by(t(spark, d, "documents"), "semantic")


@query(None)
def html_blocks(spark, d):
    return parsers.parse_html(t(spark, d, "pages"))


@query(None)
def structure_tree(spark, d):
    return blocks.with_siblings(blocks.structure_tree(parsers.parse_html(t(spark, d, "pages"))))


@query(None)
def markdown_blocks(spark, d):
    return parsers.parse_markdown(t(spark, d, "documents"))


@query(None)
def intent_rules(spark, d):
    return routing.intent_columns(t(spark, d, "benchmark").select("item_id", F.col("text").alias("question"))).select("item_id", "query_type", "confidence", "anchors", "needs_date", "item_index")


@query(
    r"select item_id, len(regexp_extract_all(text, '[?？]')) >= 2 or regexp_matches(text, '[;；]') or len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) >= 2 as multi, len(list_distinct(list_filter(list_transform(string_split_regex(text, '[?？;；\n]'), lambda x: trim(x)), lambda x: x <> '')))::int as parts from benchmark"
)
def question_split(spark, d):
    rows = t(spark, d, "benchmark")
    return rows.select("item_id", routing.is_multi_question(F.col("text")).alias("multi"), F.size(routing.split_question(F.col("text"), 1000)).alias("parts"))
