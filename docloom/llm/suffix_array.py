"""Suffix-array dedup of repeated byte strings by a distributed difference-cover algorithm.

1. Candidates. Any `length`-byte string holds a content-chosen anchor (the least of its hashes of GRAM
   bytes), so equal strings have equal anchors. The strings of one anchor that begin at neighbouring
   places of a document are one context. Contexts whose anchor occurs in one document only can't repeat
   across documents and are not sorted. Rows with a whole text that a smaller document has go whole.
2. Dealing. Contexts are dealt to tasks by anchor. Equal contexts are one before they are sent (a chunk
   sends the smallest document's) and one again when they meet: each string of the others also starts in
   the smallest document. What is left to sort are contexts that share an anchor and differ somewhere.
3. Difference cover. The letters of a suffix are its 8-byte groups. Suffixes whose letter number modulo
   3 is 1 or 2 are sampled; their triples of letters are sorted and named, and triples of names are
   sorted again until names stand for more bytes than asked (one recursion for 50).
4. Merge. The others are ordered by (letter, rank of the next sampled suffix) and merged into the sample
   with the usual two comparisons.
5. Adjacent prefixes. Neighbours with the same first `length` bytes, compared as bytes, are one run;
   every member in a larger document than the run's smallest is a removed string.

An anchor with more than HOT contexts (the border of a passage that very many documents hold) is not
sorted in one task: its strings are aggregated by content across the cluster instead, with map-side
combining, and joined back.

Defined results: null and empty texts have no bytes; texts shorter than `length` lose nothing; matches
never cross documents and a document is not compared with itself; rows that repeat a doc_id are one
document to this rule, with a row each; a null doc_id counts as larger than all others; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import chunked, saved, table
from docloom.llm.matching import dealt, found_in, gram_hashes, joined, least_of, spread

LENGTH = 50
GRAM = 24
LETTER = 8
CHUNK_BYTES = 1 << 20
BUCKET_BYTES = 16 << 20
#: Contexts of one anchor that a task sorts; the strings of commoner anchors are aggregated by content.
HOT = 100_000
_SIGN = np.uint64(1 << 63)
_LAST = np.iinfo(np.int64).min


def _table(rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> pa.Table:
    values = list(zip(*rows, strict=True)) or [[]] * len(columns)
    return pa.table({n: pa.array(v, k) for (n, k), v in zip(columns, values, strict=True)})


class _Chunk:
    """The documents of a chunk laid end to end in the order of their row numbers; rows told to be copies keep their number but no bytes."""

    def __init__(self, rows: pa.Table, length: int, copies: pa.Table | None = None):
        rows = rows.sort_by("row")
        self.doc, row, self.length = rows.column("doc").to_numpy(), rows.column("row").to_numpy(), length
        self.ids, self.texts = rows.column("doc_id").to_pylist(), [x.as_buffer() for x in rows.column("text").cast(pa.binary()).combine_chunks()]
        self.copy = np.zeros(len(row), dtype=bool)
        if copies is not None:
            self.copy[np.searchsorted(row, copies.column("row").drop_null().to_numpy())] = True
        lengths = np.array([0 if c else x.size for x, c in zip(self.texts, self.copy, strict=True)], dtype=np.int64)
        self.data = np.frombuffer(b"".join(x for x, c in zip(self.texts, self.copy, strict=True) if not c), dtype=np.uint8)
        self.starts = np.cumsum(lengths) - lengths
        self.number = np.repeat(np.arange(len(lengths)), lengths)
        self.room = np.repeat(self.starts + lengths, lengths) - np.arange(len(self.data))

    def contexts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First place, number of strings and anchor of each run of neighbouring strings with one anchor."""
        least = least_of(gram_hashes(self.data.astype(np.uint64), GRAM, self.room), self.length - GRAM + 1)
        whole = np.flatnonzero(self.room >= self.length)
        if not len(whole):
            return whole, whole, np.empty(0, dtype=np.uint64)
        h, number = least[whole], self.number[whole]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (number[1:] != number[:-1])]))
        return whole[first], np.diff(np.append(first, len(whole))), h[first]


ANCHORS = "bucket int, chunk long, hashes binary, many binary, counts binary"


def _anchors(buckets: int, length: int):
    """Anchors of a chunk, dealt to buckets by hash; `many` marks those of several of its documents."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, copies: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            chunk = _Chunk(rows, length, copies) if rows.num_rows else None
            out = []
            if chunk and len(chunk.data):
                at, _, h = chunk.contexts()
                order = np.argsort(h, kind="stable")
                h, doc = h[order], chunk.doc[chunk.number[at]][order]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
                if len(first):
                    many = (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)).astype(np.uint8)
                    hashes, counts = h[first], np.diff(np.append(first, len(h))).astype(np.int32)
                    out = [(b, key[0].as_py(), hashes[i].tobytes(), many[i].tobytes(), counts[i].tobytes()) for b, i in dealt(hashes, buckets)]
        return _table(out, [("bucket", pa.int32()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("many", pa.binary()), ("counts", pa.binary())])

    return run


SHARED = "chunk long, hashes binary, hot binary"


def _shared(most: int):
    """Anchors of more than one document, told to every chunk that has them, and whether they are hot."""

    def run(rows: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, dtype=np.uint64) for x in rows.column("hashes").to_pylist()]
        out = []
        if lists:
            every, many, counts = np.concatenate(lists), joined(rows.column("many"), np.uint8), joined(rows.column("counts"), np.int32)
            order = np.argsort(every, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], every[order][1:] != every[order][:-1]]))
            often = (np.diff(np.append(first, len(order))) > 1) | (np.maximum.reduceat(many[order], first) > 0)
            values, hot = every[order][first[often]], np.add.reduceat(counts[order].astype(np.int64), first)[often] > most
            for c, x in zip(rows.column("chunk").to_pylist(), lists, strict=True):
                k = found_in(x, values)
                if (k >= 0).any():
                    out.append((c, x[k >= 0].tobytes(), hot[k[k >= 0]].astype(np.uint8).tobytes()))
        return _table(out, [("chunk", pa.int64()), ("hashes", pa.binary()), ("hot", pa.binary())])

    return run


#: What is known of a chunk's strings. kind 0: to be sorted; 1: removed; 2: fare as those at `source`; 3: hot, to be aggregated.
TOLD = [("chunk", pa.int64()), ("kind", pa.int32()), *((x, pa.binary()) for x in ("rows", "ats", "sizes", "source", "anchors", "docs", "body"))]
TOLD_SCHEMA = "chunk long, kind int, rows binary, ats binary, sizes binary, source binary, anchors binary, docs binary, body binary"


def _binary(body: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])


def _slices(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of data[at : at + size] end to end."""
    ends = np.cumsum(sizes)
    return data[np.repeat(at - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _by_code(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest document of each code, and for each item whether it is of that document."""
    least = np.full(int(codes.max()) + 1 if len(codes) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, codes, doc)
    return least, doc == least[codes]


def _contexts(buckets: int, length: int):
    """Contexts with shared anchors; equal ones of a chunk once."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, told: pa.Table) -> pa.Table:
        out, chunk_no = [], key[0].as_py()
        if rows.num_rows and told.num_rows:
            with np.errstate(over="ignore"):
                chunk = _Chunk(rows, length, told.filter(pa.compute.is_valid(told.column("row"))))
                refs, hot = joined(told.column("hashes"), np.uint64), joined(told.column("hot"), np.uint8)
                order = np.argsort(refs)
                refs, hot = refs[order], hot[order]
                at, n, h = chunk.contexts()
                hit = found_in(h, refs)
                at, n, h, hot = at[hit >= 0], n[hit >= 0], h[hit >= 0], hot[hit[hit >= 0]]
                number = chunk.number[at]
                row, place, doc = number.astype(np.int32), (at - chunk.starts[number]).astype(np.int32), chunk.doc[number]
                size = n.astype(np.int32)
                codes = _binary(_slices(chunk.data, at, n + length - 1), n + length - 1).dictionary_encode().indices.to_numpy()
                _, own = _by_code(codes, doc)

                def packed(kind: int, i: np.ndarray, bucket: int | None = None, source=None, body=None) -> None:
                    if len(i):
                        sent = (h[i].tobytes(), doc[i].tobytes(), body.tobytes()) if body is not None else (None, None, None)
                        out.append((chunk_no, kind, row[i].tobytes(), place[i].tobytes(), size[i].tobytes(), source, *sent, chunk_no % buckets if bucket is None else bucket))

                packed(1, np.flatnonzero(~own))
                mine = np.flatnonzero(own)
                _, first, back = np.unique(codes[mine], return_index=True, return_inverse=True)
                sent, again = mine[first], np.setdiff1d(np.arange(len(mine)), first)
                packed(2, mine[again], source=np.stack([row[sent[back[again]]], place[sent[back[again]]]], axis=1).tobytes())
                for b, i in dealt(h[sent], buckets):
                    i = sent[i]
                    for kind, j in ((0, i[hot[i] == 0]), (3, i[hot[i] == 1])):
                        packed(kind, j, b, body=_slices(chunk.data, at[j], n[j] + length - 1))
        return _table(out, [*TOLD, ("bucket", pa.int32())])

    return run


def _letters(data: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as an order-preserving number; bytes past the end count as 0."""
    out = np.zeros(len(data), dtype=np.uint64)
    for j in range(LETTER):
        part = np.where(room > j, np.append(data[j:], np.zeros(min(j, len(data)), dtype=np.uint8)), 0)
        out |= part.astype(np.uint64) << np.uint64(8 * (LETTER - 1 - j))
    return (out ^ _SIGN).view(np.int64)


def _ahead(x: np.ndarray, room: np.ndarray, n: int, at: np.ndarray, none: int) -> np.ndarray:
    """x at n places on from each place of at; `none` past the end of its context."""
    return np.where(room[at] > n, x[np.minimum(at + n, len(x) - 1)], none)


def _named(*keys: np.ndarray) -> np.ndarray:
    """Ranks of the rows of keys; equal rows have one name."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    names = np.empty(len(order), dtype=np.int64)
    names[order] = np.cumsum(new)
    return names


def _before(keys: list[np.ndarray], rank: np.ndarray, wanted: list[np.ndarray]) -> np.ndarray:
    """Rank of the last of the sampled suffixes (keys, rank) whose key isn't above each wanted key; -1 if none is."""
    if not len(rank):
        return np.full(len(wanted[0]), -1, dtype=np.int64)
    m = len(rank)
    every = [np.concatenate([k, w]) for k, w in zip(keys, wanted, strict=True)]
    late = np.concatenate([np.zeros(m, dtype=np.int8), np.ones(len(wanted[0]), dtype=np.int8)])
    order = np.lexsort((late, *reversed(every)))
    got = np.maximum.accumulate(np.where(order < m, rank[np.minimum(order, m - 1)], -1))
    out = np.empty(len(wanted[0]), dtype=np.int64)
    mine = order >= m
    out[order[mine] - m] = got[mine]
    return out


def suffix_runs(data: np.ndarray, room: np.ndarray, place: np.ndarray, strings: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Difference cover over contexts laid end to end (bytes left and place in its context of each byte).

    Returns the string starts in suffix order and, for each, whether its first `length` bytes differ from the one before.
    """
    letter = _letters(data, room)
    sampled = np.flatnonzero(place // LETTER % 3 > 0)
    step = LETTER
    rank = np.full(len(data), -1, dtype=np.int64)
    rank[sampled] = _named(letter[sampled], _ahead(letter, room, step, sampled, _LAST), _ahead(letter, room, 2 * step, sampled, _LAST))
    step *= 3
    while step < length + LETTER:
        rank[sampled] = _named(rank[sampled], _ahead(rank, room, step, sampled, -1), _ahead(rank, room, 2 * step, sampled, -1))
        step *= 3
    kind = place[strings] // LETTER % 3
    a, b, own = letter[strings], _ahead(letter, room, LETTER, strings, _LAST), rank[strings]
    r8, r16 = _ahead(rank, room, LETTER, strings, -1), _ahead(rank, room, 2 * LETTER, strings, -1)
    rest, one, two = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
    position = own.copy()
    position[rest] = np.maximum(_before([a[one], r8[one]], own[one], [a[rest], r8[rest]]), _before([a[two], b[two], r16[two]], own[two], [a[rest], b[rest], r16[rest]]))
    order = np.lexsort((r8, a, kind == 0, position))
    at = strings[order]
    new = np.zeros(len(at), dtype=bool)
    new[:1] = True
    for begin in range(0, length, LETTER):
        x = letter[at + begin]
        if begin + LETTER > length:
            x = x >> (8 * (begin + LETTER - length))
        new[1:] |= x[1:] != x[:-1]
    return order, new


def _judge(length: int):
    """Sorts the contexts of a bucket and tells every chunk which of its strings are removed."""

    def run(rows: pa.Table) -> pa.Table:
        kinds = rows.column("kind").to_numpy()
        passed = rows.filter(pa.array(kinds != 0)).select([x for x, _ in TOLD])
        rows = rows.filter(pa.array(kinds == 0))
        if not rows.num_rows:
            return passed
        row, at, n = (joined(rows.column(x), np.int32) for x in ("rows", "ats", "sizes"))
        anchor, doc = joined(rows.column("anchors"), np.uint64), joined(rows.column("docs"), np.int64)
        chunk = np.repeat(rows.column("chunk").to_numpy(), [len(x) // 4 for x in rows.column("rows").to_pylist()])
        sizes = n.astype(np.int64) + length - 1
        body = joined(rows.column("body"), np.uint8)
        codes = _binary(body, sizes).dictionary_encode().indices.to_numpy()
        least, own = _by_code(codes, doc)
        gone = [np.stack([chunk[~own], row[~own], at[~own], n[~own]], axis=1)]
        # contexts that share their anchor with another, different one
        _, first = np.unique(codes, return_index=True)
        _, of, alike = np.unique(anchor[first], return_inverse=True, return_counts=True)
        code = np.flatnonzero(alike[of] > 1)
        if len(code):
            picked = first[code]
            sizes_of, begin = sizes[picked], (np.cumsum(sizes) - sizes)[picked]
            data = _slices(body, begin, sizes_of)
            ends = np.cumsum(sizes_of)
            place = np.arange(len(data)) - np.repeat(ends - sizes_of, sizes_of)
            room = np.repeat(sizes_of, sizes_of) - place
            strings = np.flatnonzero(room >= length)
            owner = np.repeat(np.arange(len(code)), n[picked])
            order, new = suffix_runs(data, room, place, strings, length)
            of_string = least[code[owner[order]]]
            begins = np.flatnonzero(new)
            smallest = np.repeat(np.minimum.reduceat(of_string, begins), np.diff(np.append(begins, len(order))))
            lost = np.zeros(len(strings), dtype=bool)
            lost[order[of_string > smallest]] = True
            # neighbouring removed strings of a context as ranges, for each document that has the context first
            begins = np.flatnonzero(lost & np.concatenate([[True], ~lost[:-1] | (owner[1:] != owner[:-1])]))
            ends = np.flatnonzero(lost & np.concatenate([~lost[1:] | (owner[1:] != owner[:-1]), [True]])) + 1
            low, high = np.searchsorted(owner[begins], np.arange(len(code))), np.searchsorted(owner[begins], np.arange(len(code)), "right")
            number = np.full(len(least), -1, dtype=np.int64)
            number[code] = np.arange(len(code))
            mine = np.flatnonzero(own & (number[codes] >= 0))
            k = number[codes[mine]]
            times = high[k] - low[k]
            record, total = np.repeat(mine, times), np.cumsum(times)
            span = np.repeat(low[k] - total + times, times) + np.arange(total[-1] if len(total) else 0)
            gone.append(np.stack([chunk[record], row[record], at[record] + place[strings[begins[span]]], ends[span] - begins[span]], axis=1))
        every = np.concatenate(gone)
        every = every[np.argsort(every[:, 0], kind="stable")]
        out = []
        for part in np.split(every, np.flatnonzero(np.diff(every[:, 0])) + 1):
            if len(part):
                cells = part[:, 1:].astype(np.int32)
                out.append((int(part[0, 0]), 1, cells[:, 0].tobytes(), cells[:, 1].tobytes(), cells[:, 2].tobytes(), None, None, None, None))
        return pa.concat_tables([passed.cast(pa.schema(TOLD)), _table(out, TOLD)])

    return run


def _exploded(length: int):
    """The strings of hot anchors as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                rows, ats, sizes = (np.frombuffer(x[c], dtype=np.int32) for c in ("rows", "ats", "sizes"))
                docs, body = np.frombuffer(x["docs"], dtype=np.int64), np.frombuffer(x["body"], dtype=np.uint8)
                full = sizes.astype(np.int64) + length - 1
                first = np.repeat(np.cumsum(full) - full, sizes)
                within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                count = len(within)
                strings = _binary(_slices(body, first + within, np.full(count, length)), np.full(count, length)).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [strings, pa.array(np.repeat(docs, sizes)), pa.array(np.full(count, x["chunk"])), pa.array(np.repeat(rows, sizes)), pa.array((np.repeat(ats, sizes) + within).astype(np.int32))],
                    ["string", "doc", "chunk", "row", "at"],
                )

    return run


def _packed(rows: pa.Table) -> pa.Table:
    """Removed strings of a chunk in one row."""
    ones = np.ones(rows.num_rows, dtype=np.int32)
    return _table([(rows.column("chunk")[0].as_py(), 1, rows.column("row").to_numpy().tobytes(), rows.column("at").to_numpy().tobytes(), ones.tobytes(), None, None, None, None)], TOLD)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def _remove(length: int, with_bytes: bool):
    """Cuts what is told of each row."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, told: pa.Table) -> pa.Table:
        chunk = _Chunk(rows, length, told.filter(pa.compute.is_valid(told.column("row"))))
        marks = np.zeros(len(chunk.data), dtype=bool)
        told = told.filter(pa.compute.is_valid(told.column("kind")))
        of_kind = lambda k: told.filter(pa.compute.equal(told.column("kind"), k))
        if (sure := of_kind(1)).num_rows:
            row, at, n = (joined(sure.column(x), np.int32).astype(np.int64) for x in ("rows", "ats", "sizes"))
            begin = chunk.starts[row] + at
            marks = spread(begin, begin + n, len(chunk.data))
        if (same := of_kind(2)).num_rows:
            row, at, n, source = (joined(same.column(x), np.int32).astype(np.int64) for x in ("rows", "ats", "sizes", "source"))
            ends = np.cumsum(n)
            within = np.arange(ends[-1]) - np.repeat(ends - n, n)
            marks[np.repeat(chunk.starts[row] + at, n) + within] |= marks[np.repeat(chunk.starts[source[::2]] + source[1::2], n) + within]
        begin = np.flatnonzero(marks)
        gone = spread(begin, begin + length, len(chunk.data))
        edge = gone & ~np.concatenate([[False], gone[:-1] & (chunk.number[1:] == chunk.number[:-1])]) if len(gone) else gone
        n_removed, n_spans = (np.bincount(chunk.number[x], minlength=len(chunk.ids)).tolist() for x in (gone, edge))
        out = []
        for i, (doc_id, text) in enumerate(zip(chunk.ids, chunk.texts, strict=True)):
            kept, lost, runs = text, n_removed[i], n_spans[i]
            if chunk.copy[i]:
                kept, lost, runs = b"", text.size, 1
            elif lost:
                kept = np.frombuffer(text, dtype=np.uint8)[~gone[chunk.starts[i] : chunk.starts[i] + text.size]].tobytes()
            out.append((doc_id, text.size, lost, runs, bytes(kept) if with_bytes else None, hashlib.sha256(kept).hexdigest()))
        return _table(out, [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    return run


def dedup_repeats(docs: DataFrame, length: int = LENGTH, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256."""
    docs = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"))
    stored, total = chunked(docs, CHUNK_BYTES, extra=("doc",))
    buckets = int(max(24, total // BUCKET_BYTES))
    prints = stored.where(F.octet_length("text") >= length).select("chunk", "row", "doc", F.unhex(F.sha2("text", 256)).alias("print"))
    least = prints.groupBy("print").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("most > least")
    copies = saved(prints.join(least, "print").where("doc > least").select("chunk", "row"))
    by_chunk = stored.groupBy("chunk")
    anchors = by_chunk.cogroup(copies.groupBy("chunk")).applyInArrow(_anchors(buckets, length), ANCHORS)
    shared = saved(anchors.groupBy("bucket").applyInArrow(_shared(HOT), SHARED).unionByName(copies, allowMissingColumns=True))
    contexts = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(_contexts(buckets, length), f"{TOLD_SCHEMA}, bucket int")
    judged = saved(contexts.groupBy("bucket").applyInArrow(_judge(length), TOLD_SCHEMA))
    told = judged.where("kind in (1, 2)").unionByName(copies, allowMissingColumns=True)
    hot = judged.where("kind = 3").select("chunk", "rows", "ats", "sizes", "docs", "body")
    if not hot.isEmpty():
        strings = saved(hot.mapInArrow(_exploded(length), "string binary, doc long, chunk long, row int, at int"))
        firsts = strings.groupBy("string").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("most > least")
        lost = strings.join(firsts, "string").where("doc > least").select("chunk", "row", "at")
        told = told.unionByName(lost.groupBy("chunk").applyInArrow(_packed, TOLD_SCHEMA), allowMissingColumns=True)
    return by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(_remove(length, with_bytes), RESULT)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_repeats(table(spark, sf_dir, "documents"), with_bytes=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
