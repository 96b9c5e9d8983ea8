"""Fill-in-middle transformation by big-integer bit-parallelism.

A text is cut into tokens (blanks with the word after them; blanks at the end are a token of their own). Instead of
a list of tokens every text gets one integer with a bit for each code point:

1. class mask: the text as one byte a code point, `bytes.translate` to 1 for word characters and 0 for blanks, read
   as a number in base 2 (reversed, so bit i is code point i);
2. boundaries: a token ends where a word character isn't followed by another, `mask & ~(mask >> 1)`, and at the end;
3. n is the number of set bits, `bit_count`;
4. the two cuts are the places of ranked bits, found by halving the integer and counting its lower half.

All steps are linear in the text and hold a few bits a code point, so no token list is made. Rows are independent:
there is no shuffle, and a lost task is simply run again.

Defined results: a null or empty text is plain, with 0 tokens and an empty output; a text that holds a mark is plain;
a null doc_id draws as the empty string; repeated rows give equal rows; blank texts are one token; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import BLANKS, table, whole

SEED = "42"
RATE, SPM_SHARE = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: UTF-8 bytes of output in an Arrow batch, about.
BATCH_BYTES = 16 << 20

_WORD = bytes(48 if chr(b) in BLANKS else 49 for b in range(256))


def token_ends(text: str) -> int:
    """The integer whose bit i is set where code point i ends a token."""
    if not text:
        return 0
    word = int(text.encode("latin-1", "replace").translate(_WORD)[::-1], 2)
    ends = word & ~(word >> 1)
    return ends if text[-1] not in BLANKS else ends | 1 << (len(text) - 1)


def ranked_bit(mask: int, width: int, rank: int) -> int:
    """The place of the rank-th set bit, from 1, of a mask of `width` bits."""
    at = 0
    while width > 1:
        half = width >> 1
        low = mask & ((1 << half) - 1)
        below = low.bit_count()
        if rank <= below:
            mask, width = low, half
        else:
            mask, width, rank, at = mask >> half, width - half, rank - below, at + half
    return at


def draws(doc_id: int | None, seed: str = SEED) -> list[int]:
    """Four numbers of 32 bits that depend on the seed and doc_id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def transformed(doc_id: int | None, text: str, seed: str = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of one text."""
    ends = token_ends(text)
    n, (h1, h2, h3, h4) = ends.bit_count(), draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = (ranked_bit(ends, len(text), units) + 1 if units else 0 for units in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < spm_share:
        return n, "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _transform(seed: str, rate: int, spm_share: int):
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                key, made = doc_id.as_py(), text.as_py()
                rows.append((key, *transformed(key, made, seed, rate, spm_share)))
                held += 4 * len(made) + 64
                if held > BATCH_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return run


def fill_in_middle(docs: DataFrame, seed: str = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row of docs; rate and spm_share are percentages."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    return rows.mapInArrow(_transform(seed, rate, spm_share), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No part holds a mark, so the marks split the output in one way only."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = {
    "op12_fill_middle": r"""
with cut as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u,
    sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
drawn as (
  select doc_id, t, u, len(u) as n, ('0x' || substr(h, 1, 8))::bigint % (len(u) + 1) as a, ('0x' || substr(h, 9, 8))::bigint % (len(u) + 1) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or ('0x' || substr(h, 17, 8))::bigint % 100 >= 50 then 'plain'
      when ('0x' || substr(h, 25, 8))::bigint % 100 < 80 then 'spm' else 'psm' end as form from cut),
parts as (
  select doc_id, t, n, form, array_to_string(u[1:least(a, b)], '') as p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') as m,
    array_to_string(u[greatest(a, b) + 1:], '') as s from drawn)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from parts
"""
}
