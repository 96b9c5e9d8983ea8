"""Mixing sources to target weights by capped water-filling.

Every source has a weight; the mix has a size budget of `share` times all sizes. A source's target is
its weighted part of the budget, clamped at `max_epochs` times the source's size; the excess is dealt
to the others by weight until none is above its clamp. With the sources in ascending order of
clamp/weight this fixed point has a closed form, so no driver loop is needed.

Documents of a source stand in a seeded hash order. Each is taken floor(target/size) whole times; the
fraction that is left takes whole documents in hash order until the target is met, the last one in part.
Where the fraction ends is found in two levels (sums of buckets of the hash, then the rows of one bucket),
so each row is decided by comparing it with one row of its source; texts are never shuffled and a source
with a third of all rows is spread over all tasks.

Defined results: null text has size 0; null source is a source of its own, last in order; a source of
size 0 gets target 0; an empty table gives no rows; repeated rows and rows with a null id are documents of
their own, ordered by size and text where ids are the same, and rows the same in id and text at which the
fraction ends share its words; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import saved, table, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Rows that a bucket of the order hash holds, about.
BUCKET_ROWS = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sizes: (source, source_size), one row for each source. Adds weight and target."""
    code_points = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(code_points) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("clamp", F.col("source_size") * float(max_epochs))
    order = Window.orderBy(F.col("clamp") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.select(
        "*",
        (F.sum("source_size").over(every) * float(share)).alias("budget"),
        F.coalesce(F.sum("clamp").over(before), F.lit(0.0)).alias("clamped"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open_weight"),
    ).withColumn("rate", (F.col("budget") - F.col("clamped")) / F.col("open_weight"))
    # the water level: the rate at the first source whose clamp isn't reached at that rate
    first_open = F.min(F.when(F.col("rate") * F.col("weight") < F.col("clamp"), F.struct(F.col("clamp") / F.col("weight"), "rate"))).over(every)
    return level.withColumn("level", first_open["rate"]).select(
        "source", "source_size", "weight", F.when(F.col("level").isNull(), F.col("clamp")).otherwise(F.least("clamp", F.col("level") * F.col("weight"))).alias("target")
    )


def _keyed(docs: DataFrame, seed: str, digits: int) -> DataFrame:
    """docs with each row's place in its source: __at (order hash), __print (settles ties of ids) and __bucket."""
    at = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.withColumns({"__at": at, "__print": F.xxhash64("text")}).withColumn("__bucket", F.left("__at", F.lit(digits)))


def _size() -> Column:
    return F.size(words(F.col("text"))).cast("long")


def cutoffs(docs: DataFrame, weights: tuple[int, ...], share: float, max_epochs: float, seed: str) -> DataFrame:
    """For each source its target, the whole times that its documents are taken and the document at which the fraction ends.

    Sums are by (source, bucket of the order hash); only the rows of the one bucket of a source in which the
    fraction ends are ordered one by one.
    """
    digits = min(8, max(1, (docs.count() // BUCKET_ROWS).bit_length() // 4 + 1))
    slim = _keyed(docs.select("doc_id", "source", "text"), seed, digits)
    buckets = saved(slim.groupBy("source", "__bucket").agg(F.sum(_size()).alias("bucket_size")))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, max_epochs)
    times = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size")))
    targets = saved(targets.withColumn("times", times.cast("long")).withColumn("part", F.round("target").cast("long") - F.col("times") * F.col("source_size")))
    running = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = saved(
        buckets.withColumn("before", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)))
        .alias("b")
        .join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
        .where("part > before and part <= before + bucket_size")
        .select(F.col("b.source").alias("edge_source"), F.col("__bucket").alias("edge_bucket"), "before", "part")
    )
    here = slim.join(edge, F.col("source").eqNullSafe(F.col("edge_source")) & (F.col("__bucket") == F.col("edge_bucket")))
    rows = here.select("edge_source", "before", "part", "__at", "__print", _size().alias("__size")).groupBy("edge_source", "before", "part", "__at", "__size", "__print").agg(F.count("*").alias("same"))
    within = Window.partitionBy("edge_source").orderBy("__at", "__size", "__print").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum(F.col("__size") * F.col("same")).over(within), F.lit(0))
    last = rows.withColumn("start", start).where("part > start and part <= start + __size * same")
    # rows that are the same in id and text share what is left
    last = last.select("edge_source", F.struct("__at", "__size", "__print").alias("last_key"), F.floor((F.col("part") - F.col("start")) / F.col("same")).alias("last_words"))
    return saved(
        targets.join(last, F.col("source").eqNullSafe(F.col("edge_source")), "left").select(F.col("source").alias("plan_source"), "source_size", "target", "times", "last_key", "last_words")
    )


def _planned(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs with __size, source_size, target and __taken: how many words of each row the mix takes. Rows meet one row for each source."""
    rows = _keyed(docs.select(F.struct("*").alias("__row"), "doc_id", "source", "text"), seed, 1).withColumn("__size", _size())
    rows = rows.join(cutoffs(docs, weights, share, max_epochs, seed), F.col("source").eqNullSafe(F.col("plan_source")))
    key = F.struct("__at", "__size", "__print")
    extra = F.when(F.col("last_key").isNull() | (key > F.col("last_key")), F.lit(0)).when(key == F.col("last_key"), F.col("last_words")).otherwise(F.col("__size"))
    return rows.withColumn("__taken", (F.col("times") * F.col("__size") + extra).cast("long"))


def mix_plan(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words of each document the mix takes."""
    return _planned(docs, **settings).select("doc_id", "source", F.col("__size").alias("size"), "source_size", "target", F.col("__taken").alias("taken"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, with the columns of docs: whole repetitions as repeated rows, a part as the text's first words."""
    taken, size = F.col("__taken"), F.col("__size")
    rows = _planned(docs, **settings).where(taken > 0).withColumn("__time", F.explode(F.sequence(F.lit(1), F.ceil(taken / size).cast("int"))))
    left = taken - (F.col("__time") - 1) * size
    text = F.when(left >= size, F.col("text")).otherwise(F.array_join(F.slice(words(F.col("text")), 1, left.cast("int")), " "))
    out = rows.select("__row.*", text.alias("__text"))
    changed = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("__text").cast(docs.schema["n_chars"].dataType)
    return out.withColumns(changed).select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = {
    "op9_mixing": f"""
with doc as (select doc_id, source, case when trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' then 0
    else len(string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+')) end as size,
    md5('{SEED}:' || doc_id::varchar) as ord from documents),
src as (select source, sum(size)::double as s, (case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end)::double as w from doc group by source),
lev as (select *, 1.5 * sum(s) over () as budget, coalesce(sum(2 * s) over (order by 2 * s / w, source rows between unbounded preceding and 1 preceding), 0) as clamped,
    sum(w) over () - coalesce(sum(w) over (order by 2 * s / w, source rows between unbounded preceding and 1 preceding), 0) as ow from src),
lam as (select arg_min((budget - clamped) / ow, 2 * s / w) as rate from lev where (budget - clamped) / ow * w < 2 * s),
tgt as (select source, s, least(2 * s, coalesce((select rate from lam) * w, 2 * s)) as target from src),
run as (select doc_id, size, s, target, coalesce(sum(size) over (partition by d.source order by ord, doc_id rows between unbounded preceding and 1 preceding), 0) as start
    from doc d join tgt t on d.source is not distinct from t.source)
select doc_id, size, s::bigint as source_size, target,
  ((case when s = 0 then 0 else floor(target / s) end) * size + greatest(0, least(size, round(target) - (case when s = 0 then 0 else floor(target / s) end) * s - start)))::bigint as taken
from run
"""
}
