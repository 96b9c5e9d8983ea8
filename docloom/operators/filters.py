"""Filters before retrieval: document and task scope, section, path, node and item hints, and scopes of requests."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hints:
    """What a search may be narrowed to; empty tuples narrow nothing, but document and task ids must be named."""

    document_ids: tuple[int, ...]
    task_ids: tuple[int, ...]
    sections: tuple[str, ...] = ()
    node_ids: tuple[int, ...] = ()
    paths: tuple[str, ...] = ()
    items: tuple[int, ...] = ()

    def forwarded(self) -> Hints:
        """What a channel gets: the scope and the section hints alone."""
        return Hints(self.document_ids, self.task_ids, self.sections)


def any_part(column: str, hints: tuple[str, ...]) -> Column:
    """Whether the column holds one of the lower-cased hints."""
    return reduce(lambda a, b: a | b, [F.col(column).contains(h.lower()) for h in hints])


def in_scope(chunks: DataFrame, hints: Hints) -> DataFrame:
    """Chunks (document_id, task_id, section_path, structure_node_id, canonical_path, item_index) that the hints leave."""
    rows = chunks.where(F.col("document_id").isin(*hints.document_ids) & F.col("task_id").isin(*hints.task_ids))
    if hints.sections:
        rows = rows.where(any_part("section_path", hints.sections))
    if hints.node_ids:
        rows = rows.where(F.col("structure_node_id").isin(*hints.node_ids))
    if hints.paths:
        rows = rows.where(any_part("canonical_path", hints.paths))
    if hints.items:
        rows = rows.where(F.col("item_index").isin(*hints.items))
    return rows


def where_equal(rows: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows equal to every wanted value; lists and tuples mean any of their values."""
    for name, value in wanted.items():
        rows = rows.where(F.col(name).isin(*value) if isinstance(value, list | tuple) else F.col(name) == value)
    return rows


def retrievable(documents: DataFrame) -> DataFrame:
    """Indexed documents (index_status = 3) that have an index task, newest first."""
    return documents.where("index_status = 3 and last_index_task_id is not null").orderBy(F.col("update_time").desc(), F.col("document_id").desc())


def scope_of(bases: DataFrame, documents: DataFrame, chat_mode: str, selection: str, wanted: list[str] | None = None) -> DataFrame:
    """Knowledge bases of a request with their allowed documents: base_id, allowed (ascending ids).

    Open chats and the selection NONE have no scope; ALL takes every base, SELECTED the wanted ones, which must all exist
    and come in the order asked for. Bases without a retrievable document are left out.
    """
    order = []
    if chat_mode == "open_chat" or selection not in ("ALL", "SELECTED"):
        bases = bases.limit(0)
    elif selection == "SELECTED":
        asked = list(dict.fromkeys(wanted or []))
        if not asked:
            raise ValueError("a selection names at least one knowledge base")
        wanted_rows = bases.sparkSession.createDataFrame([(x,) for x in asked], bases.select("base_id").schema)
        if missing := [r["base_id"] for r in wanted_rows.join(bases, "base_id", "left_anti").collect()]:  # of those asked for
            raise ValueError(f"no such knowledge base: {missing}")
        bases = bases.where(F.col("base_id").isin(*asked))
        order = [F.array_position(F.array(*map(F.lit, asked)), F.col("base_id"))]
    allowed = documents.where("index_status = 3 and last_index_task_id is not null").groupBy("base_id").agg(F.array_sort(F.collect_list("document_id")).alias("allowed"))
    found = bases.select("base_id").distinct().join(allowed, "base_id")
    return found.orderBy(*order) if order else found


def lexical_in_scope(hits: DataFrame, base_ids: list, document_ids: list) -> DataFrame:
    """Lexical hits (base_id, document_id) of the selected bases and allowed documents; an empty list allows all."""
    if base_ids:
        hits = hits.where(F.col("base_id").isin(*base_ids))
    return hits.where(F.col("document_id").isin(*document_ids)) if document_ids else hits


def filled_metadata(candidates: DataFrame, documents: DataFrame, fields: list[str]) -> DataFrame:
    """Candidates with blank fields filled from their document; what they have stays."""
    known = documents.select("document_id", *[F.col(f).alias(f"__{f}") for f in fields])
    rows = candidates.join(known, "document_id", "left")
    blank = lambda c: c.isNull() | (F.trim(c.cast("string")) == "")
    return rows.withColumns({f: F.when(blank(F.col(f)), F.col(f"__{f}")).otherwise(F.col(f)) for f in fields}).drop(*[f"__{f}" for f in fields])


def anchors_in_scope(anchors: DataFrame, document_ids: list) -> DataFrame:
    """Evidence anchors of the request's documents; no documents, no restriction."""
    return anchors.where(F.col("document_id").isin(*document_ids)) if document_ids else anchors
