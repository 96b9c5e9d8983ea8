"""Exact top-k search by a Voronoi kNN join over integer inner products.

1. Vectors become integers, floor(256 * x). Pivots are distinct vectors with the least hashes, PIVOTS at most; every
   vector, query or not, falls into the Voronoi cell of the nearest pivot of its own length. Vectors of a length that
   no pivot has share one cell more, OTHER.
2. Summaries. A cell has its row count, its radius and the k + 1 smallest distances to its pivot; its queries have a
   radius of their own. The driver holds these alone: pivots times (k + 3) numbers.
3. Bounds. With queries q = a + u, |u| <= s, and data x = c + v, |v| <= r, the product lies within
   a.c -+ (s|c| + r|a| + s r). The (k + 1)-th largest lower bound over the cells' nearest distances is the floor of a
   query cell (one of those rows may be the query itself); a data cell whose upper bound is below needs no visit.
4. Replication. Neighbouring cells are put into groups of bounded size, large cells are dealt over several. A data row
   goes to each query group with a cell that needs its own cell, a query to each data group with a cell that q.c + |q| r
   can still lift over the floor. Each pair of groups is solved locally and exactly; k rows a query leave it, and Spark
   merges them by rank.

Scores are exact: doubles are used while every partial sum is an integer below 2^53, Python integers beyond.

Defined results: vectors null, or holding null or non-finite components, take no part; vectors are compared with those
of their length only, and empty ones score 0; components and scores beyond a long are clipped to its range; rows with the
same vec_id are candidates of each other, and each query row has ranks of its own; a null vec_id is no query and comes
last among ties; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import saved, table

TOP = 5
EVERY = 50
SCALE = 256
#: Pivots are about the root of the number of rows; at most so many, and so many numbers in all.
PIVOTS, PIVOT_NUMBERS = 1024, 1 << 22
#: Rows of a group of queries and of data; queries scored at a time.
QUERY_GROUP, DATA_GROUP, STEP = 16384, 4096, 128
OTHER = -1
_LONG = np.iinfo(np.int64)


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, v): integer vectors of the rows that take part, each with a number of its own."""
    x = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & F.forall(x, lambda c: F.coalesce(c > float("-inf"), F.lit(False)) & (c < float("inf")))
    rows = vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * float(scale))).alias("v"))
    return saved(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"))


def pivots_of(rows: DataFrame, most: int = PIVOTS) -> list[np.ndarray]:
    """A bounded sample of distinct vectors: those with the least hashes."""
    count, longest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    wanted = max(1, min(most, round(count**0.5), PIVOT_NUMBERS // max(1, longest)))
    mark = F.xxhash64(F.lit("pivot"), "v")
    least = [r[0] for r in rows.select(mark.alias("mark")).distinct().orderBy("mark").limit(wanted).collect()]
    chosen = rows.withColumn("mark", mark).where(F.col("mark").isin(least)).groupBy("mark").agg(F.first("v").alias("v")).orderBy("mark").collect()
    return [np.array(r["v"], dtype=np.int64) for r in chosen]


def _by_length(pivots: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Numbers and vectors (doubles) of the pivots of each length."""
    lengths = np.array([len(p) for p in pivots])
    return {int(n): (np.flatnonzero(lengths == n), np.stack([p for p in pivots if len(p) == n]).astype(float)) for n in np.unique(lengths)}


def _blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, integer vectors) for each length of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield int(n), at, values[starts[at][:, None] + np.arange(n)]


CELLS = "row long, vec_id long, v array<long>, cell int, far double"


def _assign(pivots: list[np.ndarray]):
    known = _by_length(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.full(batch.num_rows, OTHER, dtype=np.int32), np.zeros(batch.num_rows)
            for n, at, vectors in _blocks(batch.column(2)):
                if n in known:
                    numbers, centres = known[n]
                    x = vectors.astype(float)
                    nearest = np.argmin((centres * centres).sum(axis=1) - 2 * (x @ centres.T), axis=1)
                    cell[at], far[at] = numbers[nearest], np.sqrt(((x - centres[nearest]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], ["row", "vec_id", "v", "cell", "far"])

    return run


class Bounds:
    """What is known of cells: which data cells a query cell needs, and the floor of its k-th score. Cell OTHER is the last index."""

    def __init__(self, pivots: list[np.ndarray], rows: np.ndarray, radius: np.ndarray, queries: np.ndarray, query_radius: np.ndarray, nearest: list[tuple[int, float]], k: int):
        size = len(pivots)
        self.rows, self.radius, self.queries = rows, radius, queries
        self.floor = np.full(size + 1, -np.inf)
        self.needed = np.zeros((size + 1, size + 1), dtype=bool)
        self.needed[size, size] = True
        cells, distances = np.array([c for c, _ in nearest if c >= 0], dtype=np.int64), np.array([d for c, d in nearest if c >= 0])
        for numbers, centres in _by_length(pivots).values():
            dots, norms = centres @ centres.T, np.sqrt((centres * centres).sum(axis=1))
            inside = np.isin(cells, numbers)
            where, near = np.searchsorted(numbers, cells[inside]), distances[inside]
            for i, own in enumerate(numbers):
                s, a = query_radius[own], norms[i]
                spread = s * norms + radius[numbers] * a + s * radius[numbers]
                slack = 1 + 1e-9 * (a * norms + spread)
                lower = dots[i][where] - s * norms[where] - near * a - s * near - slack[where]
                if len(lower) > k:
                    self.floor[own] = np.partition(lower, len(lower) - k - 1)[len(lower) - k - 1]
                self.needed[own, numbers] = dots[i] + spread + slack >= self.floor[own]
        self.needed &= (queries > 0)[:, None] & (rows > 0)[None, :]


def chained(pivots: list[np.ndarray]) -> list[int]:
    """The cells in an order that goes from each pivot to its nearest one not yet visited; OTHER last."""
    order: list[int] = []
    for numbers, centres in _by_length(pivots).values():
        left, at = np.ones(len(numbers), dtype=bool), 0
        for _ in numbers:
            left[at] = False
            order.append(int(numbers[at]))
            if left.any():
                at = int(np.argmin(np.where(left, ((centres - centres[at]) ** 2).sum(axis=1), np.inf)))
    return [*order, len(pivots)]


def groups_of(counts: np.ndarray, order: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """First group of each cell and over how many groups it is dealt; groups hold about `most` rows."""
    first, pieces = np.zeros(len(counts), dtype=np.int64), np.ones(len(counts), dtype=np.int64)
    group, held = 0, 0
    for cell in order:
        count = int(counts[cell])
        if held and held + count > most:
            group, held = group + 1, 0
        first[cell] = group
        if count > most:
            pieces[cell] = -(-count // most)
            group += int(pieces[cell])
        else:
            held += count
    return first, pieces


ROUTED = "queries long, data long, row long, vec_id long, v array<long>"


def _route(pivots: list[np.ndarray], bounds: Bounds, asking: bool):
    """Sends each row to the pairs of groups where it is needed: queries if asking, else data."""
    order, known, last = chained(pivots), _by_length(pivots), len(pivots)
    query_groups, data_groups = groups_of(bounds.queries, order, QUERY_GROUP), groups_of(bounds.rows, order, DATA_GROUP)
    (own_first, own_pieces), (other_first, other_pieces) = (query_groups, data_groups) if asking else (data_groups, query_groups)

    def targets(cells: np.ndarray) -> np.ndarray:
        return np.unique(np.concatenate([np.arange(other_first[c], other_first[c] + other_pieces[c]) for c in cells])) if len(cells) else np.empty(0, dtype=np.int64)

    def needs(cell: np.ndarray, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, target groups) of rows that go the same way."""
        if not asking:
            for c in np.unique(cell):
                yield np.flatnonzero(cell == c), targets(np.flatnonzero(bounds.needed[:, c]))
            return
        for n, at, vectors in _blocks(column):
            if n not in known:
                yield at, targets(np.flatnonzero(bounds.needed[last]))
                continue
            numbers, centres = known[n]
            x = vectors.astype(float)
            norms = np.sqrt((x * x).sum(axis=1))[:, None]
            reach, dots = norms * bounds.radius[numbers], x @ centres.T
            slack = 1 + 1e-9 * (norms * np.sqrt((centres * centres).sum(axis=1)) + reach)
            open_cells = (dots + reach + slack >= bounds.floor[cell[at]][:, None]) & bounds.needed[cell[at]][:, numbers]
            for pattern in np.unique(open_cells, axis=0):
                yield at[(open_cells == pattern).all(axis=1)], targets(numbers[pattern])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            cell[cell == OTHER] = last
            row = batch.column(0).to_numpy(zero_copy_only=False)
            own = own_first[cell] + row % own_pieces[cell]
            for at, others in needs(cell, batch.column(2)):
                part = batch.take(pa.array(at)) if len(others) else None
                for other in others:
                    same = np.full(len(at), other)
                    ends = (own[at], same) if asking else (same, own[at])
                    yield pa.RecordBatch.from_arrays([*map(pa.array, ends), part.column(0), part.column(1), part.column(2)], ["queries", "data", "row", "vec_id", "v"])

    return run


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products, as longs."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < 2**52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, _LONG.min, _LONG.max).astype(np.int64) if a.shape[1] else np.zeros((len(a), len(b)), dtype=np.int64)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values of a row, earlier places first among ties."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.concatenate([np.flatnonzero(scores > least), np.flatnonzero(scores == least)[:k]])
        at.sort()
    else:
        at = np.arange(len(scores))
    return at[np.argsort(-scores[at].astype(object) if scores[at].min(initial=0) == _LONG.min else -scores[at], kind="stable")[:k]]


SOLVED = "query_row long, query_id long, row long, vec_id long, score long"


def _solve(k: int):
    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        out = [[] for _ in range(5)]
        if queries.num_rows and data.num_rows:
            data = data.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # nulls come last
            rows, ids = data.column("row").to_numpy(), data.column("vec_id")
            query_rows, query_ids = queries.column("row").to_numpy(), queries.column("vec_id").to_numpy()
            stored = {n: (at, vectors) for n, at, vectors in _blocks(data.column("v"))}
            for n, asked, vectors in _blocks(queries.column("v")):
                if n not in stored:
                    continue
                places, block = stored[n]
                for begin in range(0, len(asked), STEP):
                    scores = _products(vectors[begin : begin + STEP], block)
                    for q, line in zip(asked[begin : begin + STEP], scores, strict=True):
                        others = np.flatnonzero(rows[places] != query_rows[q])
                        line = line[others]
                        best = _best(line, k)
                        found = places[others[best]]
                        for column, values in zip(out, (np.full(len(best), query_rows[q]), np.full(len(best), query_ids[q]), rows[found], found, line[best]), strict=True):
                            column.append(values)
        joined = [np.concatenate([np.empty(0, dtype=np.int64), *column]).astype(np.int64) for column in out]
        vec_ids = data.column("vec_id").combine_chunks().take(pa.array(joined[3]))
        vec_ids = vec_ids.combine_chunks() if isinstance(vec_ids, pa.ChunkedArray) else vec_ids
        return pa.table([pa.array(joined[0]), pa.array(joined[1]), pa.array(joined[2]), vec_ids, pa.array(joined[4])], ["query_row", "query_id", "row", "vec_id", "score"])

    return run


def top_products(vectors: DataFrame, k: int = TOP, every: int = EVERY, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each row whose vec_id is divisible by `every`."""
    rows = quantised(vectors)
    centres = pivots_of(rows, pivots)
    placed = saved(rows.mapInArrow(_assign(centres), CELLS))
    asks = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    summary = placed.groupBy("cell").agg(F.count("*").alias("rows"), F.max("far").alias("radius"), F.count_if(asks).alias("queries"), F.coalesce(F.max(F.when(asks, F.col("far"))), F.lit(0.0)).alias("query_radius")).collect()
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("far"))
    nearest = [(r["cell"], r["far"]) for r in placed.select("cell", "far").withColumn("rank", rank).where(F.col("rank") <= k + 1).collect()]
    figures = np.zeros((4, len(centres) + 1))
    for r in summary:
        figures[:, r["cell"]] = r["rows"], r["radius"], r["queries"], r["query_radius"]
    bounds = Bounds(centres, figures[0], figures[1], figures[2], figures[3], nearest, k)
    queries = placed.where(asks).mapInArrow(_route(centres, bounds, True), ROUTED)
    data = placed.mapInArrow(_route(centres, bounds, False), ROUTED)
    solved = queries.groupBy("queries", "data").cogroup(data.groupBy("queries", "data")).applyInArrow(_solve(k), SOLVED)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return solved.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


ORACLE = {
    "op11_voronoi_knn": """
with e as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r, q.vec_id as query_id, e.r as other, e.vec_id, list_sum(list_transform(list_zip(q.v, e.v), lambda z: z[1] * z[2]))::bigint as score
  from e q join e on q.r <> e.r where q.vec_id % 50 = 0),
t as (select query_id, row_number() over (partition by r order by score desc, vec_id nulls last, other) as rank, vec_id, score from s)
select query_id, rank::integer as rank, vec_id, score from t where rank <= 5
"""
}
