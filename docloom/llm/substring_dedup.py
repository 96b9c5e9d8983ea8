"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

Every document is a reference block. The index holds content-chosen anchors (the least of every GRAM
consecutive GRAM-word hashes, so each window of 2 * GRAM - 1 words has one); an anchor found more than
once refers to its first occurrence (smallest row number, then place). A document is parsed greedily from
left to right into factors: neighbouring anchors that point to the same block at the same shift extend a
factor, and as anchors are at most GRAM words apart the whole factor is equal to the block's words. A
factor of at least `window` words is a duplicate span, in the document and in its reference block.

Windows that aren't inside a factor - those at factor boundaries above all - are checked one by one: if
their least anchor occurs twice, the window is counted by a 128-bit hash among all such windows of the corpus.
A window equal to its anchor's first occurrence is found by its factor, any other by this count, so
the removed words are exactly those of windows found twice.

Texts are stored once, bucketed by chunk; passes over it shuffle hashes only. Within a chunk each hash
goes out at most twice and its answer comes back once, so common passages are pre-aggregated.

Defined results: null or empty texts have no words and keep the empty text; texts shorter than a window
lose nothing; repeated rows are copies of each other (all copies are removed); rows with null or repeated
ids are documents of their own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import chunked, saved, table, words
from docloom.llm.matching import MAX, at_most_two, dealt, found_in, gram_hashes, joined, minimizers, spread

WINDOW = 35
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 40 << 20
_SALT = np.uint64(0x5851F42D4C957F2D)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _laid(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes end to end, words left from each place, document number and place of each; documents in order of row_no."""
    column = rows.column("w").combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    starts = np.cumsum(lengths) - lengths
    number = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(values)) - starts[number]
    return values, lengths[number] - place, number, place, starts


def _ordered(rows: pa.Table) -> pa.Table:
    return rows.sort_by("row_no")


OUT = "bucket int, chunk long, hashes binary, docs binary, places binary"


def _index(window: int, buckets: int):
    """The anchors of a chunk, by bucket."""
    gram = (window + 1) // 2

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = _ordered(rows)
        with np.errstate(over="ignore"):
            values, room, number, place, _ = _laid(rows)
            h = gram_hashes(values, gram, room) if len(values) else np.empty(0, np.uint64)
            _, chosen = minimizers(h, gram)
            at = np.flatnonzero(chosen)
            at = at[at_most_two(h[at], np.argsort(h[at], kind="stable"))]
            docs = rows.column("row_no").to_numpy(zero_copy_only=False)
            out = [(b, key[0].as_py(), h[at[i]].tobytes(), docs[number[at[i]]].tobytes(), place[at[i]].astype(np.int32).tobytes()) for b, i in dealt(h[at], buckets)]
        return _table(out, ["bucket", "chunk", "hashes", "docs", "places"], [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])

    return run


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})


ANSWER = "chunk long, hashes binary, docs binary, places binary"


def _refer(rows: pa.Table) -> pa.Table:
    """For each anchor found more than once its first occurrence, told to every chunk that has it."""
    h, docs, places = joined(rows.column("hashes"), np.uint64), joined(rows.column("docs"), np.int64), joined(rows.column("places"), np.int32)
    chunk = np.repeat(rows.column("chunk").to_numpy(zero_copy_only=False), [len(x) // 8 for x in rows.column("hashes").to_pylist()])
    order = np.lexsort((places, docs, h))
    h, docs, places, chunk = h[order], docs[order], places[order], chunk[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, int)
    sizes = np.diff(np.append(starts, len(h)))
    first = np.repeat(starts, sizes)
    often = np.flatnonzero(np.repeat(sizes > 1, sizes))
    by_chunk = often[np.argsort(chunk[often], kind="stable")]
    cuts = np.flatnonzero(np.diff(chunk[by_chunk])) + 1
    out = []
    for part in np.split(by_chunk, cuts):
        if len(part):
            hashes, one = np.unique(h[part], return_index=True)
            source = first[part[one]]
            out.append((int(chunk[part[0]]), hashes.tobytes(), docs[source].tobytes(), places[source].tobytes()))
    return _table(out, ["chunk", "hashes", "docs", "places"], [pa.int64(), pa.binary(), pa.binary(), pa.binary()])


PARSED = "kind int, key long, chunk long, hashes binary, checks binary, row_no long, starts binary, ends binary"


def _parse(window: int, buckets: int):
    """Factors of a chunk's documents as spans (kind 0) and the windows to check exactly, by bucket (kind 1)."""
    gram = (window + 1) // 2

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows, chunk, out = _ordered(rows), key[0].as_py(), []
        with np.errstate(over="ignore"):
            values, room, number, place, _ = _laid(rows)
            if len(values) and answers.num_rows:
                docs = rows.column("row_no").to_numpy(zero_copy_only=False)
                refs, ref_docs, ref_places = joined(answers.column("hashes"), np.uint64), joined(answers.column("docs"), np.int64), joined(answers.column("places"), np.int32)
                order = np.argsort(refs, kind="stable")
                refs, ref_docs, ref_places = refs[order], ref_docs[order], ref_places[order]
                h = gram_hashes(values, gram, room)
                least, chosen = minimizers(h, gram)
                at = np.flatnonzero(chosen)
                hit = found_in(h[at], refs)
                at, hit = at[hit >= 0], hit[hit >= 0]
                own, where = docs[number[at]], place[at]
                block, there = ref_docs[hit], ref_places[hit].astype(np.int64)
                other = (block != own) | (there != where)
                at, own, where, block, there = at[other], own[other], where[other], block[other], there[other]
                proven = np.zeros(len(values), dtype=bool)
                if len(at):
                    joins = (number[at[1:]] == number[at[:-1]]) & (block[1:] == block[:-1]) & (where[1:] - there[1:] == where[:-1] - there[:-1]) & (where[1:] - where[:-1] <= gram)
                    first = np.flatnonzero(np.concatenate([[True], ~joins]))
                    last = np.append(first[1:], len(at)) - 1
                    length = where[last] + gram - where[first]
                    long_enough = length >= window
                    first, length = first[long_enough], length[long_enough]
                    begin = at[first]
                    proven = spread(begin, begin + length - window + 1, len(values))
                    spans = np.stack([np.concatenate([own[first], block[first]]), np.concatenate([where[first], there[first]]), np.concatenate([where[first] + length, there[first] + length])], axis=1)
                    spans = np.unique(spans, axis=0)
                    for part in np.split(spans, np.flatnonzero(np.diff(spans[:, 0])) + 1):
                        if len(part):
                            out.append((0, None, None, None, None, int(part[0, 0]), part[:, 1].astype(np.int32).tobytes(), part[:, 2].astype(np.int32).tobytes()))
                changes = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
                repeated = np.repeat(found_in(least[changes], refs) >= 0, np.diff(np.append(changes, len(least))))
                test = np.flatnonzero(repeated & ~proven & (room >= window) & (least != MAX))
                hashes, checks = (h[test] for h in window_hashes(values, window, room))
                order = np.lexsort((checks, hashes))
                hashes, checks = hashes[order], checks[order]
                third = np.zeros(len(hashes), dtype=bool)
                third[2:] = (hashes[2:] == hashes[:-2]) & (checks[2:] == checks[:-2])
                hashes, checks = hashes[~third], checks[~third]
                out += [(1, b, chunk, hashes[i].tobytes(), checks[i].tobytes(), None, None, None) for b, i in dealt(hashes, buckets)]
        return _table(out, ["kind", "key", "chunk", "hashes", "checks", "row_no", "starts", "ends"], [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()])

    return run


def window_hashes(values: np.ndarray, window: int, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the window from each place; together 128 bits, so windows with both the same are taken as the same."""
    return gram_hashes(values, window, room), gram_hashes(values ^ _SALT, window, room)


def _pairs_in(hashes: np.ndarray, checks: np.ndarray, ref_hashes: np.ndarray, ref_checks: np.ndarray) -> np.ndarray:
    """Which pairs are among the reference pairs, which are sorted."""
    low, high = np.searchsorted(ref_hashes, hashes), np.searchsorted(ref_hashes, hashes, "right")
    found = high > low
    found[found] = ref_checks[low[found]] == checks[found]
    for i in np.flatnonzero(~found & (high - low > 1)):
        found[i] = checks[i] in ref_checks[low[i] : high[i]]
    return found


def _twice(rows: pa.Table) -> pa.Table:
    """Windows found at least twice, told to every chunk that has them."""
    every_h, every_c = joined(rows.column("hashes"), np.uint64), joined(rows.column("checks"), np.uint64)
    order = np.lexsort((every_c, every_h))
    h, c = every_h[order], every_c[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])) if len(h) else np.empty(0, int)
    often = first[np.diff(np.append(first, len(h))) > 1]
    out, at = [], 0
    for chunk, x in zip(rows.column("chunk").to_pylist(), rows.column("hashes").to_pylist(), strict=True):
        mine = slice(at, at + len(x) // 8)
        at = mine.stop
        hit = _pairs_in(every_h[mine], every_c[mine], h[often], c[often])
        if hit.any():
            out.append((chunk, every_h[mine][hit].tobytes(), every_c[mine][hit].tobytes()))
    return _table(out, ["chunk", "hashes", "checks"], [pa.int64(), pa.binary(), pa.binary()])


RESULT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


def _remove(window: int, with_text: bool):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, found: pa.Table) -> pa.Table:
        rows = _ordered(rows)
        ids, numbers, texts = rows.column("doc_id").to_pylist(), rows.column("row_no").to_pylist(), rows.column("text")
        with np.errstate(over="ignore"):
            values, room, number, _, starts = _laid(rows)
            gone = np.zeros(len(values), dtype=bool)
            if found.num_rows and len(values):
                twice, checks = joined(found.column("hashes"), np.uint64), joined(found.column("checks"), np.uint64)
                if len(twice):
                    order = np.lexsort((checks, twice))
                    hits = np.flatnonzero(_pairs_in(*window_hashes(values, window, room), twice[order], checks[order]))
                    gone |= spread(hits, hits + window, len(values))
                base = dict(zip(numbers, starts.tolist(), strict=True))
                begin, end = [], []
                for row_no, s, e in zip(found.column("row_no").to_pylist(), found.column("starts").to_pylist(), found.column("ends").to_pylist(), strict=True):
                    if row_no is not None:
                        begin.append(np.array(s, dtype=np.int64) + base[row_no])
                        end.append(np.array(e, dtype=np.int64) + base[row_no])
                if begin:
                    gone |= spread(np.concatenate(begin), np.concatenate(end), len(values))
        lengths = rows.column("w").combine_chunks().value_lengths().to_pylist()
        out = []
        for i, doc_id in enumerate(ids):
            w = WORD.findall(texts[i].as_py())
            lost = gone[starts[i] : starts[i] + lengths[i]]
            n = int(lost.sum())
            kept = " ".join(w if not n else [x for x, bad in zip(w, lost.tolist(), strict=True) if not bad])
            out.append((doc_id, len(w), n, kept if with_text else None, hashlib.sha256(kept.encode()).hexdigest()))
        return _table(out, ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()])

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, kept_sha256: words of windows found twice are removed."""
    # the row numbers are written with the table, so they stay the same in every pass
    stored, total = chunked(docs, CHUNK_BYTES)
    stored = stored.withColumnRenamed("row", "row_no")
    buckets = int(max(24, total // BUCKET_BYTES))
    hashed = stored.select("chunk", "row_no", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    anchors = hashed.groupBy("chunk").applyInArrow(_index(window, buckets), OUT)
    answers = saved(anchors.groupBy("bucket").applyInArrow(_refer, ANSWER))
    parsed = saved(hashed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_parse(window, buckets), PARSED))
    twice = parsed.where("kind = 1").select("key", "chunk", "hashes", "checks").groupBy("key").applyInArrow(_twice, "chunk long, hashes binary, checks binary")
    pairs = parsed.where("kind = 0").select("row_no", "starts", "ends").mapInArrow(_pairs, "row_no long, start int, end int")
    spans = pairs.groupBy("row_no", "start").agg(F.max("end").alias("end"))
    by_doc = spans.groupBy("row_no").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    # a span goes to the chunk of its document
    places = stored.select("row_no", "chunk")
    told = by_doc.join(places, "row_no").select("chunk", F.lit(None).cast("binary").alias("hashes"), F.lit(None).cast("binary").alias("checks"), "row_no", "starts", "ends")
    found = twice.select("chunk", "hashes", "checks", F.lit(None).cast("long").alias("row_no"), F.lit(None).cast("array<int>").alias("starts"), F.lit(None).cast("array<int>").alias("ends")).unionByName(told)
    ready = stored.select("chunk", "row_no", "doc_id", "text", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    return ready.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_remove(window, with_text), RESULT)


def _pairs(batches):
    """Spans as rows."""
    for batch in batches:
        starts, ends = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        counts = [len(x) // 4 for x in starts]
        ids = np.repeat(np.array(batch.column(0).to_pylist(), dtype=np.int64), counts)
        s, e = np.frombuffer(b"".join(starts), dtype=np.int32), np.frombuffer(b"".join(ends), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(s), pa.array(e)], ["row_no", "start", "end"])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
