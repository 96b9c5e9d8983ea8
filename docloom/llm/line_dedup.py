"""Line dedup with levelled sorted runs of line hashes.

The index is a small log-structured store of sorted runs of keys and document counts. Each batch
of documents is merge-anti-joined with the settled keys (already known to be frequent) and with every run;
what is new becomes the batch's own run, and when a level holds `fanout` runs they are compacted into one run
of the next level (`LineRuns`). Everything is DataFrame code.

Defined results: a null or empty text is one empty line; blank lines are never dropped; a line
repeated within a document counts that document once; rows with the same (or a null) doc_id count
as documents of their own and get a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import BLANKS, ascii_lower, saved, table, whole

MIN_DOCUMENTS = 10
BATCHES = 4


def lines(text: Column) -> Column:
    return F.split(whole(text), "\n")


def _folded(line: Column) -> Column:
    """A string that two lines share just when they are equal but for the case of A-Z.

    ASCII lines are lower-cased. Others give their lower-cased form and, after a line break, their non-ASCII
    characters as they are: equal ones differ in the case of A-Z alone. The two characters whose lower case
    holds an ASCII letter (U+0130, U+212A) take the slow letter-by-letter way.
    """
    odd = F.contains(line, F.lit("\u0130")) | F.contains(line, F.lit("\u212a"))
    return (
        F.when(F.length(line) == F.octet_length(line), F.lower(line))
        .when(odd, ascii_lower(line))
        .otherwise(F.concat(F.lower(line), F.lit("\n"), F.regexp_replace(line, "[\\x00-\\x7F]+", "")))
    )


def line_keys(text: Column) -> Column:
    """For each line the 128-bit hash of its key (trimmed, A-Z lower-cased); null where the key is empty."""
    trimmed = F.transform(lines(text), lambda x: F.btrim(x, F.lit(BLANKS)))
    return F.transform(trimmed, lambda x: F.when(x != "", F.unhex(F.md5(_folded(x)))))


class LineRuns:
    """Levelled runs of (key, n), sorted by key in each of their files; a key is in one run at most.

    A batch is merged against all runs: keys that are settled go, keys that no run has are the batch's own run,
    and counts of keys that a run has wait as increments. When a level holds `fanout` runs they are compacted to
    one run of the next level with the increments of its keys, and keys whose count has reached the threshold
    move to the settled keys. A batch, its run and each compacted run are written once.
    """

    def __init__(self, threshold: int = MIN_DOCUMENTS, fanout: int = 2):
        self.threshold, self.fanout = threshold, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []
        self.waiting: list[DataFrame] = []

    @staticmethod
    def _sorted(rows: DataFrame) -> DataFrame:
        return saved(rows.sortWithinPartitions("key"))

    def _open(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    @staticmethod
    def _without(rows: DataFrame, runs: list[DataFrame]) -> DataFrame:
        for run in runs:
            rows = rows.join(run.select("key"), "key", "left_anti")
        return rows

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of keys whose key is in no run and not settled."""
        return self._without(keys, [*self.settled, *self._open()])

    def add(self, keys: DataFrame) -> None:
        """keys: a row for each document of the batch and each distinct key in it."""
        batch = self._sorted(keys.groupBy("key").agg(F.count("*").alias("n")))
        known = self._open()
        fresh = self._sorted(self.unseen(batch))
        if known:
            self.waiting.append(self._without(batch, [*self.settled, fresh]))
        self._push(0, fresh)

    def _push(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) < self.fanout:
            return
        keys, self.levels[level] = self._union(self.levels[level]), []
        if self.waiting:
            more = self._sorted(self._summed(self.waiting))
            keys = keys.join(more.withColumnRenamed("n", "more"), "key", "left").select("key", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
        merged = self._sorted(keys)
        if self.waiting:
            self.waiting = [self._without(more, [merged])]
        self.settled.append(merged.where(F.col("n") >= self.threshold).select("key"))
        self._push(level + 1, merged.where(F.col("n") < self.threshold))

    @staticmethod
    def _union(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out

    def _summed(self, runs: list[DataFrame]) -> DataFrame:
        return self._union(runs).groupBy("key").agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame:
        """All keys found in at least `threshold` documents, each once."""
        found = list(self.settled)
        if self._open():
            found.append(self._summed([*self._open(), *self.waiting]).where(F.col("n") >= self.threshold).select("key"))
        return self._union(found)


def first_seen_lines(docs: DataFrame, runs: LineRuns) -> DataFrame:
    """Incremental use: (doc_id, line_no, line) of the batch's lines that no earlier batch has; adds the batch."""
    at = docs.select("doc_id", F.posexplode(F.arrays_zip(lines(F.col("text")).alias("line"), line_keys(F.col("text")).alias("key"))).alias("line_no", "x"))
    rows = at.select("doc_id", "line_no", F.col("x.line").alias("line"), F.col("x.key").alias("key")).where("key is not null")
    fresh = saved(runs.unseen(rows))
    runs.add(_document_keys(docs))
    return fresh.drop("key")


def _document_keys(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.array_compact(F.array_distinct(line_keys(F.col("text"))))).alias("key"))


def dedup_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text: every line whose key is in at least min_documents documents goes."""
    docs = docs.select("doc_id", "text", F.xxhash64(whole(F.col("text"))).alias("print"))
    keyed = saved(docs.select("doc_id", "print", F.pmod(F.xxhash64("doc_id", "print"), F.lit(batches)).alias("batch"), line_keys(F.col("text")).alias("keys")))
    runs = LineRuns(min_documents)
    for i in range(batches):
        runs.add(keyed.where(F.col("batch") == i).select(F.explode(F.array_compact(F.array_distinct("keys"))).alias("key")))
    frequent = saved(runs.frequent())
    hits = (
        keyed.select("doc_id", "print", F.posexplode("keys").alias("pos", "key"))
        .where("key is not null")
        .join(frequent, "key", "left_semi")
        .groupBy(F.col("doc_id").alias("hit_id"), F.col("print").alias("hit_print"))
        .agg(F.collect_list("pos").alias("gone"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("print") == F.col("hit_print"))
    marked = docs.join(hits, same, "left").select("doc_id", lines(F.col("text")).alias("lines"), "gone")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get("lines", i)))
    return marked.select("doc_id", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept")).select(
        "doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text")
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = {
    "op1_line_dedup": """
with line as (
  select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents)),
hot as (select key from line where key <> '' group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (where hot.key is not null) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where hot.key is null), '')) as kept_sha256
from line left join hot using (key) group by doc_id
"""
}
