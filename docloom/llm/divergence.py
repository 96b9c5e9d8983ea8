"""Source divergence audit by integer-dictionary encoding.

Every language keeps the terms found in enough of its documents. Each source's smoothed term distribution is compared
with each other source's (part `pair`) and with the whole language's (part `term`), in exact integers.

1. Each task counts occurrences and documents by (language, source, term) and passes on sums; a hot source or a
   common word is one row a task. A text is counted piece by piece, so very long ones need no token list of their own.
2. Kept terms are dealt by hash into the language's chunks, so that terms times sources of a chunk stay near CELLS.
3. A chunk sorts its kept terms (bytes, so ids follow UTF-8 order), finds ids by `searchsorted` and each group's counts
   by `bincount`: one dense row a group. Sums of differences and the first ranks of a chunk follow by array steps,
   ties by id. Sums are added and ranks merged over chunks by Spark.

p = 1 + floor(SCALE * (count + ADDED) / (N + ADDED * V)) is a long division with remainders below 2^63, exact for
N + ADDED * V below 9e15.

Defined results: null text, lang and source are ''; rows with the same or a null doc_id are documents of their own; a
group without kept terms still has its pairs; a language without kept terms has pairs of value 0 and no terms; a
language with one source has no pairs; ties go by the item's UTF-8 bytes; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import saved, table, whole

MIN_DOCUMENTS = 30
ADDED = 5
DIGIT, DIGITS = 1000, 3  # p has DIGITS digits of this base: SCALE = DIGIT ** DIGITS
TOP_TERMS = 50
#: Terms times sources of a chunk; entries that a counting task holds; bytes counted at a time; parts into which a language's rows are dealt.
CELLS = 1 << 18
HELD = 300_000
PIECE = 1 << 22
SALTS = 64

#: Letters a-z and bytes of other scripts stay, A-Z are lower-cased, all else parts terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTED = "lang string, source string, term binary, n long, d long"


def _pieces(text: bytes) -> Iterator[bytes]:
    """The folded text in parts of about PIECE bytes that end between terms."""
    text, at = text.translate(_FOLD), 0
    while len(text) - at > PIECE:
        end = text.find(b" ", at + PIECE)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task; each group also has a row without a term, which says that it occurs."""
    groups: dict[tuple, tuple[Counter, Counter]] = {}
    seen: set[tuple] = set()
    held = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (occurrences, documents) in groups.items():
            terms = list(documents)
            first = [] if (lang, source) in seen else [None]
            seen.add((lang, source))
            size = len(terms) + len(first)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array([*first, *terms], pa.binary()),
                    pa.array([0] * len(first) + [occurrences[t] for t in terms], pa.int64()), pa.array([0] * len(first) + [documents[t] for t in terms], pa.int64()),
                ],
                ["lang", "source", "term", "n", "d"],
            )
        groups.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            key = (lang.as_py(), source.as_py())
            if key not in groups:
                groups[key] = (Counter(), Counter())
                held += 1
            occurrences, documents = groups[key]
            before, own = len(documents), set()
            for piece in _pieces(text.as_py()):
                terms = piece.split()
                occurrences.update(terms)
                own.update(terms)
            documents.update(own)
            held += len(documents) - before
            if held > HELD:
                yield from flushed()
                held = 0
    yield from flushed()


def probabilities(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + ADDED) / total), a digit at a time."""
    rest, value = counts + ADDED, 0
    for _ in range(DIGITS + 1):  # the first quotient is 1 only where one term is all there is
        value = value * DIGIT + rest // total
        rest = rest % total * DIGIT
    return 1 + value


DIVERGED = "lang string, source string, part string, item binary, value long"


def _diverge(top: int):
    def run(rows: pa.Table, groups: pa.Table) -> pa.Table:
        out = {name: [] for name in ("lang", "source", "part", "item", "value")}
        sources = sorted(zip(groups.column("source").to_pylist(), groups.column("total").to_pylist(), strict=True))
        if sources:
            lang, kept = groups.column("lang")[0].as_py(), groups.column("kept")[0].as_py()
            names, totals = [s for s, _ in sources], np.array([n for _, n in sources], dtype=np.int64)
            own = np.empty(rows.num_rows, dtype=object)
            own[:] = rows.column("term").to_pylist()
            terms = np.unique(own)
            ids = np.searchsorted(terms, own)
            place = {s: i for i, s in enumerate(names)}
            group = np.array([place[s] for s in rows.column("source").to_pylist()], dtype=np.int64)
            shape = (len(names), len(terms))
            # counts are below 2^53, so sums of doubles are exact; each (group, term) has one row
            counts = np.bincount(group * shape[1] + ids, weights=rows.column("n").to_numpy(), minlength=shape[0] * shape[1]).astype(np.int64).reshape(shape) if shape[1] else np.zeros(shape, dtype=np.int64)
            smooth = ADDED * kept
            p = probabilities(counts, (totals + smooth)[:, None]) if shape[1] else counts
            q = probabilities(counts.sum(axis=0), int(totals.sum()) + smooth) if shape[1] else counts[0]

            def add(i: int, part: str, items: list[bytes], values: np.ndarray) -> None:
                for name, column in (("lang", [lang] * len(items)), ("source", [names[i]] * len(items)), ("part", [part] * len(items)), ("item", items), ("value", values.tolist())):
                    out[name] += column

            coded = [s.encode() for s in names]
            for i in range(shape[0]):
                add(i, "pair", coded[:i] + coded[i + 1 :], np.delete(np.abs(p - p[i]).sum(axis=1), i))
                over = np.flatnonzero((counts[i] > 0) & (p[i] > q))
                over = over[np.argsort(q[over] - p[i][over], kind="stable")[:top]]
                add(i, "term", terms[over].tolist(), p[i][over] - q[over])
        return pa.table([pa.array(out[n], t) for n, t in (("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.binary()), ("value", pa.int64()))], list(out))

    return run


def source_divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language, and the `top` terms that a source has more of than its language."""
    texts = docs.select(*(whole(F.col(c)).alias(c) for c in ("lang", "source")), whole(F.col("text")).cast("binary").alias("text"))
    counts = saved(texts.mapInArrow(_count, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")))
    groups = counts.where("term is null").select("lang", "source")
    kept = saved(counts.where("term is not null").groupBy("lang", "term").agg(F.sum("d").alias("d")).where(F.col("d") >= min_documents).select("lang", "term"))

    chunks = F.greatest(F.lit(1), F.least("kept", F.ceil(F.col("kept") * F.col("sources") / CELLS)))
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left")
    langs = saved(langs.withColumn("kept", F.coalesce("kept", F.lit(0))).withColumn("chunks", chunks.cast("long")))

    salted = langs.select("lang", "chunks", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    placed = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS))).join(salted, ["lang", "salt"]).select("lang", "term", F.pmod(F.crc32("term"), "chunks").alias("chunk"))
    rows = saved(counts.join(placed, ["lang", "term"]).select("lang", "source", "term", "n", "chunk"))

    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    stats = groups.join(totals, ["lang", "source"], "left").join(langs, "lang").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "kept", "chunks")
    stats = stats.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    found = saved(rows.groupBy("lang", "chunk").cogroup(stats.groupBy("lang", "chunk")).applyInArrow(_diverge(top), DIVERGED))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms).withColumn("item", F.col("item").cast("string"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


ORACLE = {
    "op13_source_divergence": r"""
with doc as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
tok as (select r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from doc),
kept as (select lang, term from tok group by all having count(distinct r) >= 30),
v as (select lang, count(*) as v from kept group by lang),
grp as (select distinct lang, source from doc),
cnt as (select lang, source, term, count(*)::hugeint as c from tok semi join kept using (lang, term) group by all),
ng as (select lang, source, sum(c) as n from cnt group by all),
p as (select g.lang, g.source, k.term, coalesce(c.c, 0) as c, 1 + (1000000000 * (coalesce(c.c, 0) + 5)) // (coalesce(ng.n, 0) + 5 * v.v) as p
  from grp g join kept k using (lang) join v using (lang) left join cnt c on c.lang = g.lang and c.source = g.source and c.term = k.term
  left join ng on ng.lang = g.lang and ng.source = g.source),
q as (select lang, term, 1 + (1000000000 * (sum(c) + 5)) // (sum(sum(c)) over (partition by lang) + 5 * v) as q from p join v using (lang) group by lang, term, v),
dist as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pair as (select g.lang, g.source, h.source as item, coalesce(f, 0) as f from grp g join grp h on g.lang = h.lang and g.source <> h.source
  left join dist d on d.lang = g.lang and d.source = g.source and d.item = h.source),
term as (select lang, source, term as item, p - q as f from p join q using (lang, term) where c > 0 and p > q),
ranked as (select lang, source, 'pair' as part, item, f, row_number() over (partition by lang, source order by f desc, encode(item)) as rank from pair
  union all select lang, source, 'term', item, f, row_number() over (partition by lang, source order by f desc, encode(item)) from term)
select lang, source, part, item, f::bigint as value, rank::integer as rank from ranked where part = 'pair' or rank <= 50
"""
}
