"""Inverted-file vector index: seeded k-means cells, rows stored by cell with short residual codes, searches of probed cells only.

A row holds its cell, the residual of its unit vector as one signed byte a dimension with a scale of its own, the length
of what the code leaves out (`error`) and the vector itself. A search scores codes: with |q| = 1 the true cosine lies
within `error` of the code's score, so the rows whose upper bound reaches the k-th lower bound hold the exact best k of
the probed cells; their vectors alone are read for the exact scores. Cells are folders of one table, so cells that no
question probes are never read; a cell with very many rows is dealt over pieces, each of them a task.

How many cells a question probes is measured when the index is built: the fewest that reach the wanted recall on a
sample of the rows themselves. Probing all cells is an exact search.

Defined results: null vectors and vectors with null or non-finite components are not indexed and find nothing as questions;
vectors of length 0 score 0; a vector of another dimension is an error; ties go by chunk_id; an empty table gives an
index without cells, in which nothing is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import vectors as V

#: Rows that k-means and the choice of probes see, at most (least hashes); cells at most; rows in a piece of a cell; rounds of k-means.
SAMPLE, TUNED, MOST_CELLS, PIECE_ROWS, ROUNDS = 65_536, 256, 4096, 8192, 10
#: Rows of a group of cells and questions of a block, or about that; scores that are held at a time.
GROUP_ROWS, QUESTION_BLOCK, HELD = 16_384, 2048, 1 << 21
SEED = 20240607
#: Scores are rounded to six digits before they are compared, so bounds give way by this much.
SLACK = 2e-6


class VectorIndex(NamedTuple):
    """rows: cell, piece, chunk_id, code, scale, error, vector. centres, pieces, sizes: a row for each cell. probes: cells a question reads."""

    rows: DataFrame
    centres: np.ndarray
    pieces: np.ndarray
    probes: int
    sizes: np.ndarray


def sound(vector: Column) -> Column:
    """Whether a vector has finite components only."""
    return vector.isNotNull() & F.forall(V.doubles(vector), lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False)))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != dims).any():
        raise ValueError(f"the index holds vectors of {dims} dimensions, found {sorted(set(lengths.tolist()) - {dims})}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def units(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def fitted_cells(vectors: DataFrame, cells: int, seed: int = SEED) -> np.ndarray:
    """Centres of unit vectors by Spark's k-means on the rows with the least hashes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    norm = F.sqrt(V.dot(F.col("vector"), F.col("vector")))
    unit = F.transform("vector", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(0.0))
    sample = vectors.orderBy(F.xxhash64(F.lit(seed), "vector"), "chunk_id").limit(SAMPLE).withColumn("norm", norm).select(array_to_vector(unit).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=ROUNDS, initMode="random").fit(sample.coalesce(8))
    return np.array(model.clusterCenters())


CODED = "cell int, chunk_id long, code binary, scale double, error double, vector array<double>"


def _encode(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = units(_matrix(batch.column(1), centres.shape[1]))
            cell = np.argmin((centres * centres).sum(axis=1) - 2 * unit @ centres.T, axis=1)
            rest = unit - centres[cell]
            scale = np.abs(rest).max(axis=1, initial=0) / 127
            code = np.rint(np.divide(rest, scale[:, None], out=np.zeros_like(rest), where=scale[:, None] > 0)).astype(np.int8)
            error = np.linalg.norm(rest - code * scale[:, None], axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(error), batch.column(1)],
                ["cell", "chunk_id", "code", "scale", "error", "vector"],
            )

    return run


def write_vector_index(vectors: DataFrame, folder: str, recall: float = 0.95, k: int = 10, cells: int | None = None, seed: int = SEED) -> None:
    """Builds the index of vectors (chunk_id, vector) in folder."""
    spark = vectors.sparkSession
    vectors = vectors.where(sound(F.col("vector"))).select(F.col("chunk_id").cast("long").alias("chunk_id"), V.doubles(F.col("vector")).alias("vector"))
    count, dims = vectors.agg(F.count("*"), F.max(F.size("vector"))).first()
    cells = min(count, cells or max(1, min(MOST_CELLS, round(count**0.5))))
    centres = fitted_cells(vectors, cells, seed) if cells else np.zeros((0, dims or 0))
    if cells:
        coded = vectors.mapInArrow(_encode(centres), CODED)
    else:
        coded = spark.createDataFrame([], CODED)
    coded.write.parquet(f"{folder}/coded")
    coded = spark.read.schema(CODED).parquet(f"{folder}/coded")
    sizes = np.zeros(len(centres), dtype=np.int64)
    for r in coded.groupBy("cell").count().collect():  # MOST_CELLS rows at most
        sizes[r["cell"]] = r["count"]
    pieces = np.maximum(1, -(-sizes // PIECE_ROWS))
    share = F.get(F.array(*map(F.lit, pieces.tolist())).cast("array<long>"), F.col("cell"))
    placed = coded.withColumn("piece", F.pmod(F.xxhash64("chunk_id"), share))
    placed.repartition("cell", "piece").sortWithinPartitions("cell", "piece", "chunk_id").write.partitionBy("cell").parquet(f"{folder}/rows")
    spark.createDataFrame([(i, int(pieces[i]), int(sizes[i]), c.tolist()) for i, c in enumerate(centres)], "cell int, pieces long, size long, centre array<double>").write.parquet(f"{folder}/cells")
    index = VectorIndex(_rows(spark, folder), centres, pieces, len(centres), sizes)
    probes = tuned_probes(index, vectors, recall, k, seed) if len(centres) else 0
    spark.createDataFrame([(probes,)], "probes int").write.parquet(f"{folder}/settings")


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CODED + ", piece long").parquet(f"{folder}/rows")


def read_vector_index(spark: SparkSession, folder: str) -> VectorIndex:
    cells = spark.read.parquet(f"{folder}/cells").orderBy("cell").collect()  # MOST_CELLS rows at most
    centres = np.array([r["centre"] for r in cells]) if cells else np.zeros((0, 0))
    pieces, sizes = (np.array([r[c] for r in cells], dtype=np.int64) for c in ("pieces", "size"))
    return VectorIndex(_rows(spark, folder), centres, pieces, spark.read.parquet(f"{folder}/settings").first()["probes"], sizes)


def tuned_probes(index: VectorIndex, vectors: DataFrame, recall: float, k: int, seed: int = SEED) -> int:
    """The fewest probed cells with which TUNED rows of the index find `recall` of their exact best k."""
    asked = vectors.orderBy(F.xxhash64(F.lit(seed + 1), "chunk_id")).limit(TUNED).select(F.col("chunk_id").alias("question_id"), F.col("vector").alias("query"))
    asked = asked.sparkSession.createDataFrame(asked.toArrow())  # TUNED rows
    true = vector_search(index, asked, k, probes=len(index.centres))
    found_at = asked.join(true, "question_id").join(index.rows.select("chunk_id", "cell"), "chunk_id")
    at = np.sort([r["at"] for r in found_at.mapInArrow(_place_of_cell(index.centres), "at long").collect()])  # TUNED * k rows at most
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))))]) + 1 if len(at) else 1


def _order(query: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Cells of each question, nearest centre first."""
    return np.argsort((centres * centres).sum(axis=1) - 2 * units(query) @ centres.T, axis=1, kind="stable")


def _place_of_cell(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query = _matrix(batch.column(batch.schema.get_field_index("query")), centres.shape[1])
            cell = batch.column(batch.schema.get_field_index("cell")).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.argmax(_order(query, centres) == cell[:, None], axis=1))], ["at"])

    return run


PROBES = "question_id long, query array<double>, part long, cells array<int>"
FOUND = "question_id long, chunk_id long, cell int, piece long, lower double, upper double"


def _pieces_of_group() -> int:
    return max(1, GROUP_ROWS // PIECE_ROWS)


def _first_groups(index: VectorIndex) -> np.ndarray:
    """The group of each cell's first pieces. Cells of one piece share groups; others have as many as they need."""
    first, at, held = [], 0, 0
    for size, pieces in zip(index.sizes.tolist(), index.pieces.tolist(), strict=True):
        if held and held + size > GROUP_ROWS:
            at, held = at + 1, 0
        first.append(at)
        at, held = (at, held + size) if pieces == 1 else (at - (-pieces // _pieces_of_group()), 0)
    return np.array(first, dtype=np.int64)


def _probe(centres: np.ndarray, pieces: np.ndarray, first: np.ndarray, probes: int):
    """A row for each group that a question probes, with the cells that it probes there."""
    groups = -(-pieces // _pieces_of_group())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                rows = batch.slice(begin, 256)
                cells = _order(_matrix(rows.column(1), centres.shape[1]), centres)[:, :probes]
                times = groups[cells.ravel()]
                cell, owner = np.repeat(cells.ravel(), times), np.repeat(np.repeat(np.arange(len(cells)), cells.shape[1]), times)
                part = first[cell] + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                order = np.lexsort((cell, part, owner))
                cell, owner, part = cell[order], owner[order], part[order]
                starts = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])]))
                sent = rows.take(pa.array(owner[starts]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(cell)).astype(np.int32)), pa.array(cell.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([sent.column(0), sent.column(1), pa.array(part[starts]), lists], ["question_id", "query", "part", "cells"])

    return run


def _score(centres: np.ndarray, k: int):
    """The rows of a group that can be among the best k of a question's probed rows there, with bounds of their cosines."""

    def run(questions: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if questions.num_rows and rows.num_rows:
            dims = centres.shape[1]
            query, probed = units(_matrix(questions.column("query").combine_chunks(), dims)), questions.column("cells").combine_chunks()
            code = np.frombuffer(b"".join(rows.column("code").to_pylist()), dtype=np.int8).reshape(-1, dims).astype(float)
            ids, scale, error, cell, piece = (rows.column(c).to_numpy() for c in ("chunk_id", "scale", "error", "cell", "piece"))
            numbers, asked = questions.column("question_id").to_numpy(), probed.value_lengths().to_numpy(zero_copy_only=False)
            known, of_row = np.unique(cell, return_inverse=True)
            owner, flat = np.repeat(np.arange(len(query)), asked), probed.flatten().to_numpy(zero_copy_only=False)
            there = np.isin(flat, known)
            meets = np.zeros((len(query), len(known)), dtype=bool)
            meets[owner[there], np.searchsorted(known, flat[there])] = True
            step = max(1, HELD // len(ids))
            for begin in range(0, len(query), step):
                some, met = query[begin : begin + step], meets[begin : begin + step][:, of_row]
                score = (some @ centres[known].T)[:, of_row] + (some @ code.T) * scale
                lower, upper = np.where(met, score - error, -np.inf), score + error
                least = np.partition(lower, -k, axis=1)[:, -k] if len(ids) >= k else np.full(len(some), -np.inf)
                q, r = np.nonzero(met & (upper >= least[:, None] - SLACK))
                out.append((numbers[begin : begin + step][q], ids[r], cell[r], piece[r], lower[q, r], upper[q, r]))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [[]] * len(kinds)
        return pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["question_id", "chunk_id", "cell", "piece", "lower", "upper"])

    return run


def vector_search(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """question_id, chunk_id, score: the best k by cosine in the probed cells of each question; queries: (question_id, query).

    allowed: (chunk_id) narrows the rows before they are scored. A narrow scope may lie outside the tuned probes; give more then.
    """
    spark, probes = queries.sparkSession, index.probes if probes is None else probes
    if not len(index.centres) or k <= 0 or probes <= 0:
        return spark.createDataFrame([], "question_id long, chunk_id long, score double")
    asked = queries.where(sound(F.col("query"))).select(F.col("question_id").cast("long").alias("question_id"), V.doubles(F.col("query")).alias("query"))
    first, blocks = _first_groups(index), max(1, -(-asked.count() // QUESTION_BLOCK))
    probed = asked.mapInArrow(_probe(index.centres, index.pieces, first, min(probes, len(index.centres))), PROBES)
    rows = index.rows
    if probes < len(index.centres):  # MOST_CELLS numbers at most; as a plain list they prune folders while the plan is made
        read = [r["cell"] for r in probed.select(F.explode("cells").alias("cell")).distinct().collect()]
        rows = rows.where(F.col("cell").isin(read)) if len(read) < len(index.centres) else rows
    part = F.get(F.array(*map(F.lit, first.tolist())).cast("array<long>"), F.col("cell")) + F.floor(F.col("piece") / _pieces_of_group())
    coded = rows.select("cell", "piece", "chunk_id", "code", "scale", "error", part.alias("part"))
    coded = coded if allowed is None else coded.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
    coded = coded.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    probed = probed.withColumn("block", F.pmod(F.xxhash64("question_id"), F.lit(blocks).cast("long")))
    found = probed.groupBy("part", "block").cogroup(coded.groupBy("part", "block")).applyInArrow(_score(index.centres, k), FOUND)
    of_question = Window.partitionBy("question_id")
    ranked = found.withColumn("at", F.row_number().over(of_question.orderBy(F.desc("lower"))))
    least = F.when(F.max("at").over(of_question) >= k, F.min(F.when(F.col("at") <= k, F.col("lower"))).over(of_question)).otherwise(float("-inf"))
    able = ranked.withColumn("least", least).where(F.col("upper") >= F.col("least") - SLACK).select("question_id", "cell", "piece", "chunk_id")
    exact = able.join(rows.select("cell", "piece", "chunk_id", "vector"), ["cell", "piece", "chunk_id"]).join(asked, "question_id")
    scores = exact.select("question_id", "chunk_id", F.round(V.cosine(F.col("query"), F.col("vector")), 6).alias("score"))
    rank = F.row_number().over(of_question.orderBy(F.desc("score"), "chunk_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
