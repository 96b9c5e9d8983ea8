"""Quality rules: structural base rules and a hashed n-gram log-likelihood ratio.

Word 1-grams and 2-grams are hashed into a fixed number of bins. Two multinomials are counted over
the bins: one from the trusted documents (those labelled quality 1), one from the whole corpus; both
cover every document. A document's score is the mean over its n-grams of log(trusted/corpus); it is
kept when the score reaches a fixed threshold.

Each document is scored without its own counts (leave-one-out), so a trusted document scores just as
it would with its label hidden. A bin's ratio is shrunk to 1 by PRIOR counts of the corpus, so a bin
that no other document fills says nothing and the threshold means the same on small and large tables.

Expressions only. Labels meet documents in a join on doc_id, with the ids broadcast while they are at most
MOST_BROADCAST. Repeated 3-word windows are found inside a row: each window is one number of hash and
position, sorted, so that equal windows meet; those found are compared as words, and gaps between their
sorted positions give the words covered.

Defined results: null, empty and blank texts have no words, fail the base rules and are not kept;
where no other document is trusted the score is 0 and the threshold does not reject; a null doc_id has
no label; repeated rows are scored
row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import saved, table, whole, words

BINS = 65536
#: Counts of the corpus that stand in each bin, at the overall share of trusted ones, before any is seen.
PRIOR = 32
#: Trusted ids that are broadcast; where there are more, documents and ids meet in a shuffled join.
MOST_BROADCAST = 2_000_000
MIN_SCORE = -0.12
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


class Ratio(NamedTuple):
    """Counts of the bins, over all documents and over the trusted ones, and the ids of the trusted."""

    corpus: list[int]
    trusted: list[int]
    labels: DataFrame


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with is_trusted; null ids are spread by their text and match nothing."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    return docs.join(labels, key == F.col("label_id"), "left").select(*docs.columns, (F.col("label_id").isNotNull() & F.col("doc_id").isNotNull()).alias("is_trusted"))


def base_columns(docs: DataFrame) -> DataFrame:
    """docs: (row, text, is_trusted). The row itself, is_trusted, the hashes of its words and word pairs and the base figures."""
    d = docs.select("row", "is_trusted", whole(F.col("text")).alias("text"), words(F.col("text")).alias("w")).withColumn("h", word_hashes()).withColumn("g", pair_hashes())
    d = d.withColumn("triples", F.expr("zip_with(slice(g, 1, greatest(size(g) - 1, 0)), slice(h, 3, greatest(size(h) - 2, 0)), (x, y) -> xxhash64(x, y))"))
    # most texts have no triple twice, and the sorting below is for the others
    bits = "cast(ceil(log2(size(w) + 1)) as int)"
    d = d.withColumn("b", F.expr(bits)).withColumn(
        "codes", F.expr("case when size(array_distinct(triples)) = size(triples) then cast(array() as array<bigint>) else sort_array(transform(triples, (x, i) -> shiftleft(x, b) | i)) end")
    )
    d = d.withColumn(
        "near",
        F.expr(
            "transform(filter(codes, (c, i) -> shiftright(c, b) = shiftright(get(codes, i + 1), b) or (i > 0 and shiftright(c, b) = shiftright(codes[greatest(i - 1, 0)], b))),"
            " c -> cast(c & (shiftleft(1L, b) - 1) as int))"
        ),
    )
    # equal codes can be a clash of hashes: those few windows are compared as words
    d = d.withColumn("seen", F.expr("array_sort(transform(near, i -> struct(w[i] as a, w[i + 1] as b, w[i + 2] as c, i as i)))"))
    same = "seen[{0}].a = x.a and seen[{0}].b = x.b and seen[{0}].c = x.c"
    d = d.withColumn(
        "at", F.expr(f"array_sort(transform(filter(seen, (x, j) -> (j > 0 and {same.format('greatest(j - 1, 0)')}) or (j < size(seen) - 1 and {same.format('least(j + 1, size(seen) - 1)')})), x -> x.i))")
    )
    covered = F.expr("aggregate(transform(at, (p, j) -> case when j = size(at) - 1 then 3 else least(3, at[least(j + 1, size(at) - 1)] - p) end), 0L, (s, x) -> s + x)")
    with_words = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    n = F.size("w").cast("long")
    return d.select(
        "row",
        "is_trusted",
        "h",
        "g",
        n.alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.expr("cast(length(regexp_replace(text, '[^#*$%&|<>]+', '')) as bigint)").alias("n_symbols"),
        (F.size(with_words) - F.size(F.array_distinct(with_words))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def word_hashes(w: str = "w") -> Column:
    return F.expr(f"transform({w}, x -> xxhash64(x))")


def pair_hashes(h: str = "h") -> Column:
    """For each word but the last the hash of it and the next, from the word hashes in the array column h."""
    return F.expr(f"zip_with(slice({h}, 1, greatest(size({h}) - 1, 0)), slice({h}, 2, greatest(size({h}) - 1, 0)), (x, y) -> xxhash64(x, y))")


def ngram_bins(bins: int = BINS, h: str = "h", g: str = "g") -> Column:
    """The bins of all word 1-grams and 2-grams, from the hashes of words and of word pairs."""
    return F.expr(f"transform(concat({h}, {g}), x -> cast(pmod(x, {bins}) as int))")


def fit_ratio(docs: DataFrame, labels: DataFrame, bins: int = BINS) -> Ratio:
    """The counts of each bin; what comes to the driver is a row for each bin at most."""
    trusted = saved(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("label_id")).distinct())
    if trusted.count() <= MOST_BROADCAST:
        trusted = F.broadcast(trusted)
    hashed = marked(docs.select("doc_id", "text"), trusted).select("is_trusted", words(F.col("text")).alias("w")).select("is_trusted", word_hashes().alias("h")).withColumn("g", pair_hashes())
    counts = (
        hashed.select("is_trusted", F.explode(F.concat("h", "g")).alias("x"))
        .groupBy(F.pmod("x", F.lit(bins)).cast("int").alias("bin"))
        .agg(F.count("*").alias("corpus"), F.sum(F.col("is_trusted").cast("long")).alias("trusted"))
        .collect()
    )
    by_bin = {r["bin"]: (r["corpus"], r["trusted"]) for r in counts}
    return Ratio(*([by_bin.get(b, (0, 0))[x] for b in range(bins)] for x in (0, 1)), trusted)


def score_documents(docs: DataFrame, ratio: Ratio, min_score: float = MIN_SCORE) -> DataFrame:
    """row (all columns of docs), the base columns, score and kept; docs are those that the ratio was fitted on.

    Every n-gram first counts as the document's only one of its bin; bins with k > 1 of them, found as
    neighbours in the sorted bins, are then set right.
    """
    listed = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<double>")
    # the corpus without one n-gram and with the prior, as almost every n-gram needs it
    others, trusted, n, m = listed([c - 1 + PRIOR for c in ratio.corpus]), listed(ratio.trusted), sum(ratio.corpus), sum(ratio.trusted)
    with_row = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    d = base_columns(marked(with_row, ratio.labels)).withColumn("bins", F.sort_array(ngram_bins(len(ratio.corpus)))).drop("h", "g")
    d = d.withColumn("repeats", F.expr("filter(bins, (b, i) -> b = get(bins, i + 1))"))
    d = d.withColumn("at", F.expr("case when size(repeats) = 0 then cast(array() as array<int>) else filter(sequence(0, size(repeats) - 1), i -> i = 0 or repeats[i] <> repeats[greatest(i - 1, 0)]) end"))
    own = F.when(F.col("is_trusted"), 1.0).otherwise(0.0)
    d = d.withColumn("own", own).withColumn("share", (m - F.col("own") * F.size("bins")) / F.greatest(F.lit(1), n - F.size("bins")))
    d = d.withColumn("one", F.lit(float(PRIOR)) * F.col("share") - F.col("own"))

    # the counts stand in few places of the plan, as each of them is written out there in full
    d = d.withColumn("found", F.transform("at", lambda place: F.struct(F.get(trusted, F.get("repeats", place)).alias("t"), F.get(others, F.get("repeats", place)).alias("c"))))

    def correction(place: Column, j: Column) -> Column:
        k = F.coalesce(F.get(F.col("at"), j + 1), F.size("repeats")) - place + 1
        t, c = F.get("found", j)["t"], F.get("found", j)["c"]
        return k * (F.ln((t - F.col("own") * k + PRIOR * F.col("share")) / (c - (k - 1))) - F.ln((t + F.col("one")) / c))

    zero = F.lit(0.0)
    total = F.aggregate("bins", zero, lambda s, b: s + F.ln((F.get(trusted, b) + F.col("one")) / F.get(others, b))) + F.aggregate(F.transform("at", correction), zero, lambda s, x: s + x) - F.size("bins") * F.ln("share")
    score = F.when((F.size("bins") > 0) & (F.col("share") > 0), F.round(total / F.size("bins"), 6)).otherwise(0.0)
    return d.withColumn("score", score).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= min_score)).drop("bins", "repeats", "at", "found", "own", "share", "one", "is_trusted")


def kept_documents(docs: DataFrame, ratio: Ratio, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs that the rules keep."""
    # explode stands between the filter and the nested expressions, which the optimizer would else copy into the filter many times over
    return score_documents(docs, ratio, min_score).select("row", F.explode(F.array("kept")).alias("stays")).where("stays").select("row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs.select("doc_id", "text"), fit_ratio(docs, table(spark, sf_dir, "labels")))
    return scored.select("row.doc_id", *[c for c in scored.columns if c != "row"])
