"""MinHash near-dedup with an LSH forest, confirmed on full shingle sets.

1. Signatures. Every whole text becomes the set of its distinct word shingles (64-bit hashes). Equal
   sets are one class, kept by its smallest doc_id; only classes go on. A class gets HASHES minima.
2. Forest. TREES signature orders are sorted by Spark (range partitions, so a dense region spreads
   over many tasks). Neighbours whose longest common prefix reaches the region's depth are candidates:
   BASE_DEPTH hashes, or, where more than DENSE classes share these, two of the next BASE_DEPTH besides
   (any two within a partition of the sorted order; across a border the first two). A run of neighbours
   is given as links to its smallest member, so no pairs multiply.
3. Candidate components of these links (alternating large and small stars, on tables).
4. Confirmation. Each component is checked on full sets. Up to CHUNK classes are checked in one place:
   a class is compared with the members of every group it isn't linked with yet, until the first link.
   Larger components are cut into chunks; each chunk is solved, then one member of each group found is
   compared across chunks, and what still stands apart from the component's largest group is compared,
   in blocks, with all members of the component. So no link between candidates is lost and no task
   gets an unbounded group.

A pair with similarity s shares a prefix in no tree with a chance of (1 - s^4)^24: 2e-8 at 0.85, 2e-6 at
0.8. Where its region is dense in every tree the chance is (1 - s^4 p)^24, p that of two equal hashes in
four (0.99 and 0.97): 3e-8 and 3e-6; if partition borders part it in every tree, (1 - s^6)^24: 1e-5 and 7e-4.

Defined results: texts without words are linked with nothing; fewer words than a shingle count as one
shingle; rows are told apart by a number of their own, so repeated rows are copies and rows that repeat a
doc_id with other texts are grouped by their own text; a null doc_id counts as larger than all others and
is kept only as the first row of a group without ids; an empty table gives no rows; other columns are
ignored (`deduplicated` returns them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import ascii_lower, by_row, saved, table, whole, words

TREES = 24
BASE_DEPTH = 4
DENSE = 512
HASHES = TREES * BASE_DEPTH
CHUNK = 400
#: Classes in a confirming task, and of those that stand apart in a block.
UNIT = 1000
BLOCK = 200
PASS_WORDS = 1_000_000

_rng = np.random.default_rng(20240607)
_MULTIPLIERS = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(text: Column) -> Column:
    return F.transform(words(ascii_lower(whole(text))), lambda w: F.xxhash64(w))


def mixed64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(values: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of documents laid end to end as word hashes, and how many each document has."""
    total = len(values)
    h = np.zeros(total, dtype=np.uint64)
    for j in range(k):
        part = values[j:] if j else values
        h[: total - j] = h[: total - j] * _STEPS[0] + mixed64(part + _STEPS[j + 1])
    starts = np.cumsum(lengths) - lengths
    place = np.arange(total) - np.repeat(starts, lengths)
    counts = np.maximum(lengths - k + 1, np.minimum(lengths, 1))
    for d in np.flatnonzero((lengths > 0) & (lengths < k)):
        v = np.uint64(lengths[d])
        for x in values[starts[d] : starts[d] + lengths[d]]:
            v = mixed64(np.array([v * _STEPS[40] + x], dtype=np.uint64))[0]
        h[starts[d]] = v
    return mixed64(h[place < np.repeat(counts, lengths)]), counts


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lengths


def _slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about PASS_WORDS words together."""
    part = np.cumsum(lengths) // PASS_WORDS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    yield from ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b)


SIGNED = "row long, doc_id long, n_shingles long, set_key binary, signature binary"


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                all_values, all_lengths = _lists(batch.column(2))
                ends = np.cumsum(all_lengths)
                for first, last in _slices(all_lengths):
                    lengths = all_lengths[first:last]
                    begin = ends[first] - all_lengths[first]
                    s, counts = shingles(all_values[begin : ends[last - 1]], lengths, k)
                    starts = np.cumsum(counts) - counts
                    sizes, keys = np.zeros(len(counts), dtype=np.int64), []
                    for d, (at, n) in enumerate(zip(starts, counts, strict=True)):
                        u = np.unique(s[at : at + n])
                        sizes[d] = len(u)
                        keys.append(np.array([u.sum(), mixed64(u ^ _STEPS[50]).sum()], dtype=np.uint64).tobytes() if n else None)
                    filled = np.flatnonzero(counts)
                    signatures = np.zeros((len(counts), HASHES), dtype=np.uint16)
                    if len(filled):
                        for f in range(HASHES):
                            low = np.minimum.reduceat(s * _MULTIPLIERS[f], starts[filled])
                            signatures[filled, f] = (mixed64(low) >> np.uint64(48)).astype(np.uint16)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).slice(first, last - first) for c in (0, 1)), pa.array(sizes), pa.array(keys, pa.binary()), pa.array([x.tobytes() for x in signatures], pa.binary())],
                        ["row", "doc_id", "n_shingles", "set_key", "signature"],
                    )

    return run


def signed(stored: DataFrame, k: int) -> DataFrame:
    """stored: (row, doc). Size, key and signature of every row's shingle set."""
    return stored.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), word_hashes(F.col("doc.text")).alias("w")).mapInArrow(_sign(k), SIGNED)


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class and tree the first 2 * BASE_DEPTH minima of the tree's order, as two sortable numbers."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        reps = batch.column(0).to_numpy(zero_copy_only=False)
        signatures = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(n, HASHES).astype(np.int64)
        wide = np.concatenate([signatures, signatures[:, :BASE_DEPTH]], axis=1)
        for tree in range(TREES):
            parts = [sum(wide[:, BASE_DEPTH * (tree + x) + i] << (16 * (BASE_DEPTH - 1 - i)) for i in range(BASE_DEPTH)) for x in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, tree, dtype=np.int32)), pa.array(parts[0]), pa.array(parts[1]), pa.array(reps)], ["tree", "upper", "lower", "rep"])


def _dense_labels(rep: np.ndarray, lower: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The smallest class that each class of a dense run reaches by classes with two equal hashes of the next BASE_DEPTH."""
    label = rep.copy()
    if not len(rep):
        return label
    hashes = [(lower >> 16 * (BASE_DEPTH - 1 - i)) & 0xFFFF for i in range(BASE_DEPTH)]
    orders = []
    for i in range(BASE_DEPTH):
        for j in range(i + 1, BASE_DEPTH):
            order = np.lexsort((hashes[j], hashes[i], run))
            keys = [x[order] for x in (hashes[j], hashes[i], run)]
            starts = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
            orders.append((order, starts, np.diff(np.append(starts, len(order)))))
    while True:
        before = label.copy()
        for order, starts, sizes in orders:
            label[order] = np.repeat(np.minimum.reduceat(label[order], starts), sizes)
        if np.array_equal(before, label):
            return label


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each row to the smallest class of its run; the partition's first and last row, for the seams, as (tree, upper)."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    tree, upper, lower, rep = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in tables]) for i in range(4))
    links = [np.empty((0, 2), dtype=np.int64)]

    def runs(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.concatenate([[True], change]))
        return starts, np.diff(np.append(starts, len(tree)))

    base = (tree[1:] != tree[:-1]) | (upper[1:] != upper[:-1])
    starts, sizes = runs(base)
    dense = np.repeat(sizes > DENSE, sizes)
    least = np.where(dense, rep, np.repeat(np.minimum.reduceat(rep, starts), sizes))
    at = np.flatnonzero(dense)
    least[at] = _dense_labels(rep[at], lower[at], np.repeat(np.arange(len(starts)), sizes)[at])
    own = rep != least
    links.append(np.stack([rep[own], least[own]], axis=1))
    both = np.concatenate(links)
    seam = np.array([0, len(tree) - 1])
    none = np.full(len(both), -1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([both[:, 0], rep[seam]])), pa.array(np.concatenate([both[:, 1], rep[seam]])), pa.array(np.concatenate([none, tree[seam]]).astype(np.int32)), pa.array(np.concatenate([none, upper[seam]]))],
        ["a", "b", "tree", "upper"],
    )


def candidate_links(classes: DataFrame) -> DataFrame:
    """classes: (rep, signature). Returns distinct (a, b), b < a, both classes in a run of some tree."""
    forest = classes.select("rep", "signature").mapInArrow(_plant, "tree int, upper long, lower long, rep long")
    rows = forest.repartitionByRange("tree", "upper", "lower", "rep").sortWithinPartitions("tree", "upper", "lower", "rep")
    found = saved(rows.mapInArrow(_neighbours, "a long, b long, tree int, upper long"))
    # a run cut by partition borders goes on: the rows at the seams are two a partition
    seams = found.where("tree >= 0").groupBy("tree", "upper").agg(F.collect_set("a").alias("all"))
    across = seams.where(F.size("all") > 1).select(F.explode("all").alias("a"), F.array_min("all").alias("b"))
    return found.where("tree < 0").select("a", "b").unionByName(across).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable; links: (a, b). Alternating large and small stars."""
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def marks(e: DataFrame) -> tuple:
        h = F.xxhash64("u", "v")
        return tuple(e.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())

    before = marks(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = saved(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = marks(edges)
        if after == before:
            break
        before = after
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


class Groups:
    """Disjoint groups of documents; a document joins every group with a member that it is linked with."""

    def __init__(self, percent: int):
        self.percent = percent
        self.members: list[list[int]] = []

    def linked(self, a: set, b: set) -> bool:
        if 100 * min(len(a), len(b)) < self.percent * max(len(a), len(b)):
            return False
        shared = len(a & b)
        return 100 * shared >= self.percent * (len(a) + len(b) - shared)

    def add(self, i: int, sets: list[set]) -> None:
        joined, apart = [i], []
        for group in self.members:
            if any(self.linked(sets[i], sets[j]) for j in group):
                joined = group + joined
            else:
                apart.append(group)
        self.members = [*apart, joined]


def _sets(column: pa.ChunkedArray, k: int) -> list[set]:
    values, lengths = _lists(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    with np.errstate(over="ignore"):
        s, counts = shingles(values, lengths, k)
    ends = np.cumsum(counts)
    return [set(s[e - n : e].tolist()) for e, n in zip(ends, counts, strict=True)]


LABELLED = "component long, chunk long, rep long, label long"


def _solve(k: int, percent: int):
    """Groups within each (component, chunk) of a unit; a group's label is its smallest member."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("component", "ascending"), ("chunk", "ascending"), ("rep", "ascending")])
        component, chunk, rep = (rows.column(c).to_numpy() for c in ("component", "chunk", "rep"))
        label = rep.copy()
        cuts = np.flatnonzero(np.concatenate([[True], (component[1:] != component[:-1]) | (chunk[1:] != chunk[:-1])])) if len(rep) else np.empty(0, int)
        for a, b in zip(cuts, np.append(cuts[1:], len(rep)), strict=True):
            sets, groups = _sets(rows.column("w").slice(a, b - a), k), Groups(percent)
            for i in range(b - a):
                groups.add(i, sets)
            for group in groups.members:
                label[a + np.array(group)] = rep[a + min(group)]
        return pa.table({"component": component, "chunk": chunk, "rep": rep, "label": label})

    return run


def _solved(members: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """members: (component, chunk, rep). Labels within each chunk, confirmed on full sets."""
    units = max(1, -(-members.count() // UNIT))
    texts = docs.select(F.col("row").alias("rep"), F.col("doc.text").alias("text"))
    rows = members.withColumn("unit", F.pmod(F.xxhash64("component", "chunk"), F.lit(units))).join(texts, "rep")
    hashed = rows.repartition("unit").select("unit", "component", "chunk", "rep", word_hashes(F.col("text")).alias("w"))
    return saved(hashed.groupBy("unit").applyInArrow(_solve(k, percent), LABELLED))


def _members(column: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of all texts end to end, the text of each, and the sizes of the sets."""
    values, lengths = _lists(column.combine_chunks())
    with np.errstate(over="ignore"):
        s, counts = shingles(values, lengths, k)
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    first = np.concatenate([[True], (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])])[: len(s)]
    return s[first], owner[first], np.bincount(owner[first], minlength=len(counts))


#: Shingles in a slice of a product.
WIDE = 8192


def shared_sizes(left: tuple, right: tuple) -> np.ndarray:
    """How many shingles each set of the left has in common with each of the right, as products over the shingles that both sides have."""
    common = np.intersect1d(left[0], right[0])
    out = np.zeros((len(left[2]), len(right[2])))
    for at in range(0, len(common), WIDE):
        part, sides = common[at : at + WIDE], []
        for s, owner, sizes in (left, right):
            place = np.minimum(np.searchsorted(part, s), len(part) - 1)
            here = part[place] == s
            side = np.zeros((len(sizes), len(part)), dtype=np.float32)
            side[owner[here], place[here]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _across(k: int, percent: int):
    """Links between a block of those that stand apart and a chunk of all members of their component."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.zeros((0, 2), dtype=np.int64)
        if left.num_rows and right.num_rows:
            a, b = _members(left.column("w"), k), _members(right.column("w"), k)
            x, y = left.column("label").to_numpy()[:, None], right.column("label").to_numpy()[None, :]
            shared = shared_sizes(a, b)
            i, j = np.nonzero((100 * shared >= percent * (a[2][:, None] + b[2][None, :] - shared)) & (x != y))
            found = np.unique(np.stack([np.maximum(x[i, 0], y[0, j]), np.minimum(x[i, 0], y[0, j])], axis=1), axis=0)
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    return run


def confirmed_groups(candidates: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """candidates: (rep, component). Returns (rep, label): label is the smallest class linked through confirmed links."""
    sizes = candidates.groupBy("component").count()
    chunked = saved(
        candidates.join(sizes, "component").select("component", "rep", F.when(F.col("count") <= CHUNK, 0).otherwise(F.pmod(F.xxhash64("rep"), F.ceil(F.col("count") / CHUNK))).cast("long").alias("chunk"), (F.col("count") > CHUNK).alias("large"))
    )
    found = _solved(chunked.select("component", "chunk", "rep"), docs, k, percent)
    large = saved(chunked.where("large").select("component").distinct())
    if large.isEmpty():
        return found.select("rep", "label")
    # one member of each group, across the chunks of a large component
    heads = saved(found.join(large, "component", "left_semi").select("component", F.col("label").alias("rep")).distinct())
    counts = heads.groupBy("component").count()
    again = heads.join(counts, "component").select("component", F.pmod(F.xxhash64("rep"), F.ceil(F.col("count") / CHUNK)).alias("chunk"), "rep")
    tops = _solved(again, docs, k, percent).select(F.col("rep").alias("label"), F.col("label").alias("top"))
    merged = saved(found.join(large, "component", "left_semi").join(tops, "label").select("component", "chunk", "rep", F.col("top").alias("label")))
    # the rest: everything outside the largest group of its component, in blocks against all members
    largest = merged.groupBy("component", "label").count().groupBy("component").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    texts = docs.select(F.col("row").alias("rep"), F.col("doc.text").alias("text"))
    rest = saved(merged.join(largest, "component").where("label <> main").select("component", "rep", "label"))
    blocks = rest.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    chunks = merged.select("component", "chunk").distinct()
    pairs = blocks.select("component", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).join(chunks, "component").withColumn("pair", F.xxhash64("component", "block", "chunk"))
    left = rest.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).join(pairs, ["component", "block"]).join(texts, "rep").select(F.col("pair").alias("block_pair"), "label", word_hashes(F.col("text")).alias("w"))
    right = merged.join(pairs, ["component", "chunk"]).join(texts, "rep").select(F.col("pair").alias("chunk_pair"), "label", word_hashes(F.col("text")).alias("w"))
    links = saved(left.groupBy("block_pair").cogroup(right.groupBy("chunk_pair")).applyInArrow(_across(k, percent), "a long, b long"))
    joined = components(links).select(F.col("node").alias("label"), F.col("component").alias("final"))
    settled = merged.join(joined, "label", "left").select("rep", F.coalesce("final", "label").alias("label"))
    return found.join(large, "component", "left_anti").select("rep", "label").unionByName(settled)


def grouped(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The stored rows (row, doc) and for each row: doc_id, n_shingles, component_id, kept, and stays for one row of each group."""
    stored = by_row(docs)
    rows = saved(signed(stored, k))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    classes = saved(rows.where("set_key is not null").groupBy("set_key").agg(F.min("row").alias("rep"), F.first("signature").alias("signature"), first))
    candidates = components(candidate_links(classes)).select(F.col("node").alias("rep"), "component")
    candidates = saved(candidates.unionByName(candidates.select(F.col("component").alias("rep"), "component").distinct()))
    labels = confirmed_groups(candidates, stored, k, percent)
    joined = saved(classes.select("set_key", "rep", "first").join(labels, "rep", "left"))
    labelled = joined.where("label is not null")
    groups = labelled.groupBy("label").agg(F.min("first").alias("group_first"))
    final = labelled.join(groups, "label").select("set_key", F.col("group_first").alias("first")).unionByName(joined.where("label is null").select("set_key", "first"))
    found = rows.drop("signature").join(final, "set_key", "left")
    least, alone = F.col("first.doc_id"), F.col("first").isNull()
    stays = alone | (F.col("row") == F.col("first.row"))
    result = found.select(
        "row", "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(least).alias("component_id"),
        F.when(alone, True).when(least.isNull(), stays).otherwise(F.coalesce(F.col("doc_id") == least, F.lit(False))).alias("kept"), stays.alias("stays"),
    )
    return stored, result


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs: component_id is the smallest doc_id reachable by links of percent similarity."""
    return grouped(docs.select("doc_id", "text"), k, percent)[1].drop("row", "stays")


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group, with the columns of docs: that of the smallest doc_id, of rows with that id the first."""
    stored, found = grouped(docs, k, percent)
    return stored.join(found.where("not stays").select("row"), "row", "left_anti").select("doc.*")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)
