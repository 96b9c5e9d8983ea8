"""Queries of the stored indexes: vector search by cells, keyword search by bounded blocks, an index after updates, sections by n-grams."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.catalogue import ASKED, BM25, COSINE, SPAN, chunks, chunks_of, query, question_terms, stored_keywords, t
from docloom.catalogue_documents import BLOCKS, block_rows
from docloom.sources import index, keyword_index, section_index, vector_index


def stored_vectors(spark, d) -> vector_index.VectorIndex:
    rows = t(spark, d, "embeddings").select((F.col("vec_id") * SPAN).alias("chunk_id"), F.col("embedding").alias("vector"))
    return vector_index.read_vector_index(spark, index.stored(spark, "vectors", f"{d}/embeddings.parquet", lambda folder: vector_index.write_vector_index(rows, folder)))


def asked_vectors(spark, d):
    return t(spark, d, "embeddings").where(F.col("vec_id") % ASKED == 0).select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("query"))


@query(None)
def ivf_topk(spark, d):
    """The cells that the index was tuned to probe: recall is measured in tests/test_indexes.py."""
    return vector_index.vector_search(stored_vectors(spark, d), asked_vectors(spark, d))


@query(f"with {COSINE} select * from vh")
def ivf_all_cells(spark, d):
    stored = stored_vectors(spark, d)
    return vector_index.vector_search(stored, asked_vectors(spark, d), probes=len(stored.centres))


@query(f"with {BM25} select * from kw")
def keyword_pruned(spark, d):
    return keyword_index.pruned(stored_keywords(spark, d), question_terms(spark, d)).hits


#: Documents whose number leaves 3 by 7 are deleted; of the others those that leave 1 by 5 are replaced by a line and their text twice.
CHANGED = """(select doc_id, case when doc_id % 5 = 1 then 'anew ' || lang || chr(10) || text || text else text end as text from documents where doc_id % 7 <> 3)"""


@query(f"with {BM25.replace('from documents', 'from ' + CHANGED)} select * from kw")
def keyword_after_updates(spark, d):
    documents = t(spark, d, "documents")

    def build(folder):
        first = chunks(spark, d).withColumnRenamed("doc_id", "document_id")
        stored = keyword_index.add(keyword_index.create(spark, folder), first.where("document_id % 2 = 0"))
        stored = keyword_index.add(stored, first.where("document_id % 2 = 1"))
        stored = keyword_index.delete(stored, documents.where("doc_id % 7 = 3").select(F.col("doc_id").alias("document_id")))
        new = documents.where("doc_id % 5 = 1 and doc_id % 7 <> 3").withColumn("text", F.concat(F.lit("anew "), "lang", F.lit("\n"), "text", "text"))
        keyword_index.replace(stored, chunks_of(new).withColumnRenamed("doc_id", "document_id"))

    return keyword_index.search(keyword_index.open_index(spark, index.stored(spark, "updated", f"{d}/documents.parquet", build)), question_terms(spark, d))



SECTIONED = f"""{BLOCKS}, part as (select *, count(*) filter (where block_type = 'TITLE') over (partition by document_id order by block_no) as section_no from block),
 section as (select document_id, min(block_no)::int as node_no, coalesce(min(text) filter (where block_type = 'TITLE'), '') as title, min(section_path) as section_path, 'section ' || section_no as anchor_text,
   coalesce(string_agg(text, chr(10) order by block_no) filter (where block_type <> 'TITLE'), '') as content_text from part group by document_id, section_no),
 asked as (select document_id as question_id, document_id, case when document_id % 10 = 0 then ' ' when document_id % 3 = 0 then 'Section 1' when document_id % 3 = 1 then substring(last_text, 4, 20) else substring(last_text, 2, 2) end as question,
   case when document_id % 2 = 0 then 'section 2' else '' end as hint from (select document_id, arg_max(text, block_no) as last_text from block group by document_id))"""


def sections_of(spark, d):
    """A document's blocks from title to title as sections."""
    from pyspark.sql import Window

    rows = block_rows(spark, d).withColumn("section_no", F.count_if(F.col("block_type") == "TITLE").over(Window.partitionBy("document_id").orderBy("block_no")))
    title = F.col("block_type") == "TITLE"
    body = F.array_sort(F.collect_list(F.when(~title, F.struct("block_no", "text"))))
    return rows.groupBy("document_id", "section_no").agg(
        F.min("block_no").cast("int").alias("node_no"), F.coalesce(F.min(F.when(title, F.col("text"))), F.lit("")).alias("title"), F.min("section_path").alias("section_path"),
        F.concat(F.lit("section "), F.col("section_no").cast("string")).alias("anchor_text"), F.array_join(F.transform(body, lambda x: x["text"]), "\n").alias("content_text"),
    )


@query(
    rf"""with {SECTIONED}, folded as (select question_id, document_id, lower(regexp_replace(question, '^\s+|\s+$', '', 'g')) as q, hint as h from asked),
 s as (select question_id, f.document_id, node_no, case when trim(title) <> '' and contains(lower(title), q) then 90 else 0 end + case when trim(section_path) <> '' and contains(lower(section_path), q) then 70 else 0 end
   + case when contains(lower(anchor_text), q) then 60 else 0 end + case when trim(content_text) <> '' and contains(lower(content_text), q) then 30 else 0 end
   + case when h <> '' and (contains(lower(title), h) or contains(lower(section_path), h) or contains(lower(anchor_text), h)) then 25 else 0 end as score from folded f join section using (document_id) where q <> '' or h <> '')
 select question_id, document_id, node_no, score::int as score from s where score >= 30 qualify row_number() over (partition by question_id order by score desc, node_no) = 1"""
)
def best_sections(spark, d):
    """Each document is asked for part of its last block, a short piece of it, an anchor, or by hint alone."""
    stored = section_index.read_section_index(spark, index.stored(spark, "sections", f"{d}/documents.parquet", lambda folder: section_index.write_section_index(sections_of(spark, d), folder)))
    last = block_rows(spark, d).groupBy("document_id").agg(F.max_by("text", "block_no").alias("last_text"))
    of = F.col("document_id") % 3
    question = F.when(F.col("document_id") % 10 == 0, " ").when(of == 0, "Section 1").when(of == 1, F.substring("last_text", 4, 20)).otherwise(F.substring("last_text", 2, 2))
    asked = last.select(F.col("document_id").alias("question_id"), "document_id", question.alias("question"), F.when(F.col("document_id") % 2 == 0, "section 2").otherwise("").alias("hint"))
    return section_index.best_sections(stored, asked)
