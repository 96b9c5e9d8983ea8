"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short, documents long, so Jaccard LSH over whole documents fails; what counts is the
share of an item's shingles found in the document. Each item keeps the SKETCH smallest hashes of its
distinct 5-word shingles (a MinHash sketch of the item). Items are partitioned by size in powers of
two, each partition with an index and a threshold of its own: the sketch hashes that a document must
hold, set so that an item with the wanted containment is missed with a chance below MISS (hits are
hypergeometric, so smaller sizes bear higher thresholds; a sketch that is the whole set must reach the
containment itself). A document probes every partition with all shingles of its whole text; candidates
are verified by exact shingle containment, on the words themselves.

The item index is broadcast in blocks of at most BLOCK_SHINGLES shingles: a larger benchmark makes
more blocks, each a pass over the documents, so what is broadcast is bounded at every size.
Documents aren't shuffled.

Words are runs of letters and digits, lower-cased, so case and punctuation don't hide a leak.
Items of fewer than SHINGLE words are one shingle, all their words, and match where these stand together; `without_items`
takes them only if asked, as a single common word would reject clean documents.
Defined results: null or empty texts and items match nothing; of an item's containments all are given, ties too; repeated items and documents give a row for each pair of rows; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import table

SHINGLE = 5
MIN_CONTAINMENT = 0.8
SKETCH = 16
MISS = 1e-6
BLOCK_SHINGLES = 250_000

WORD = re.compile(r"\w+")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
PAIRS = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"


def least_hits(n_shingles: int, sketch: int, containment: float, miss: float = MISS) -> int:
    """The most sketch hashes that may be demanded, so that a document with that share of an item's n_shingles is missed with a chance below miss.

    The sketch is a sample of the shingles without replacement, so the hits are hypergeometric.
    """
    held = int(np.ceil(containment * n_shingles - 1e-9))
    tail = 0.0
    for hits in range(sketch + 1):
        tail += comb(held, hits) * comb(n_shingles - held, sketch - hits) / comb(n_shingles, sketch)
        if tail > miss:
            return max(1, hits)
    return sketch


def shingle_hashes(ids: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of the n-word shingles of a document given as word numbers; 0 where a word is no item's (number 0)."""
    count = len(ids) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    h, known = np.zeros(count, dtype=np.uint64), np.ones(count, dtype=bool)
    for j in range(n):
        part = ids[j : j + count]
        known &= part > 0
        h = (h ^ (part * _MULTIPLIERS[j])) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
    h[~known] = 0
    return h


class Partition(NamedTuple):
    """Sketches of the items with 2 ** size_class to 2 ** (size_class + 1) - 1 shingles, by hash, and the hits that a document needs."""

    hashes: np.ndarray
    owners: np.ndarray
    needed: np.ndarray


class ItemIndex:
    """Words, shingles and size-partitioned sketches of one block of items."""

    def __init__(self, items: list[tuple[int, str]], containment: float = MIN_CONTAINMENT):
        self.containment = containment
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, frozenset]] = []
        self.short: dict[int, dict[tuple, list[int]]] = {}  # by number of words: the words, their items
        sketches: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in WORD.findall(text.lower())]
            shingles = frozenset(zip(*(ids[j:] for j in range(SHINGLE)), strict=False))
            if shingles:
                hashes = np.unique(shingle_hashes(np.array(ids, dtype=np.uint64)))
                sketches.setdefault(len(shingles).bit_length() - 1, []).append((len(self.items), hashes[:SKETCH]))
                self.items.append((item_id, shingles))
            elif ids:
                self.short.setdefault(len(ids), {}).setdefault(tuple(ids), []).append(item_id)
        self.partitions = [self._partition(c, rows) for c, rows in sorted(sketches.items())]

    def _partition(self, size_class: int, rows: list[tuple[int, np.ndarray]]) -> Partition:
        """One threshold for the class, that of its largest size; where sketches are whole sets each item's own."""
        hashes, owners = np.concatenate([h for _, h in rows]), np.repeat([i for i, _ in rows], [len(h) for _, h in rows])
        largest, needed = 2 ** (size_class + 1) - 1, np.zeros(len(self.items), dtype=np.int64)
        for i, h in rows:
            n = len(self.items[i][1])
            needed[i] = max(1, int(np.ceil(self.containment * n - 1e-9))) if len(h) == n else least_hits(largest, len(h), self.containment)
        order = np.argsort(hashes, kind="stable")
        return Partition(hashes[order], owners[order], needed)

    def candidates(self, present: np.ndarray) -> Iterator[int]:
        """Items whose sketch has enough hashes in the sorted hashes of a document."""
        for part in self.partitions:
            at = np.minimum(np.searchsorted(present, part.hashes), len(present) - 1)
            hits = np.bincount(part.owners[present[at] == part.hashes], minlength=len(part.needed))
            yield from np.flatnonzero((hits[: len(part.needed)] >= part.needed) & (part.needed > 0)).tolist()

    def _short_items(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """The items of fewer than SHINGLE words that stand in a text."""
        listed, found = ids.tolist(), []
        for n, items in sorted(self.short.items()):
            for words in set(zip(*(listed[j:] for j in range(n)), strict=False)) & items.keys():
                found += [(item_id, 1, 1) for item_id in items[words]]
        return found

    def find(self, text: str, short: bool = True) -> list[tuple[int, int, int]]:
        """(item_id, shingles of the item, those found in the text) for every item contained in the text."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in WORD.findall(text.lower())], dtype=np.uint64)
        found, exact = self._short_items(ids) if short and self.short else [], None
        present = np.unique(shingle_hashes(ids))
        if not len(present) or (len(present) == 1 and present[0] == 0):
            return found
        for k in self.candidates(present):
            if exact is None:
                listed = ids.tolist()
                exact = set(zip(*(listed[j:] for j in range(SHINGLE)), strict=False))
            item_id, shingles = self.items[k]
            shared = len(shingles & exact)
            if shared >= self.containment * len(shingles) - 1e-9:
                found.append((item_id, len(shingles), shared))
        return found


def _probe(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: ItemIndex = index.value
        for batch in batches:
            rows = [
                (doc_id, item_id, n, shared, round(shared / n, 6))
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                if (t := text.as_py())
                for item_id, n, shared in items.find(t)
            ]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "n_shingles", "n_shared", "containment"])

    return run


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most `most` words (at least one item each), streamed by partition."""
    block, size = [], 0
    for r in items.select("item_id", "text").where("text is not null").toLocalIterator():
        n = r["text"].count(" ") + 1
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    if block:
        yield block


def contained_items(docs: DataFrame, items: DataFrame, containment: float = MIN_CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment: all pairs in which the document holds the item."""
    spark, found = docs.sparkSession, None
    for block in _blocks(items, BLOCK_SHINGLES):
        index = spark.sparkContext.broadcast(ItemIndex(block, containment))
        part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_probe(index), PAIRS)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], PAIRS) if found is None else found


def _clean(index, column: int, short: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: ItemIndex = index.value
        for batch in batches:
            yield batch.filter(pa.array([not ((t := x.as_py()) and items.find(t, short)) for x in batch.column(column)], pa.bool_()))

    return run


def without_items(docs: DataFrame, items: DataFrame, containment: float = MIN_CONTAINMENT, short: bool = False) -> DataFrame:
    """The rows of docs, all columns, whose text contains no item; decided row by row, so ids don't matter. short: items of fewer than SHINGLE words count too."""
    for block in _blocks(items, BLOCK_SHINGLES):
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(block, containment))
        docs = docs.mapInArrow(_clean(index, docs.columns.index("text"), short), docs.schema)
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
