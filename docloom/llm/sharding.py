"""Sharding by Karmarkar-Karp differencing, with equal texts as indivisible groups.

A partial partition is a row of `shards` byte sums; the differencing step takes the two partial
partitions with the largest spread and adds them oppositely ordered, until one is left. To run on
many tasks:

* groups above total / (HEAD * shards) bytes - HEAD * shards of them at most, by their size - are
  differenced first and give the head's partial partition;
* all others are dealt by hash into blocks of about BLOCK_ITEMS groups; each block is differenced
  together with its share of the head's partial partition, so the blocks make up for large groups;
* the last block is differenced with the sum of everything before it, which evens out the rests.

Only (label, sum) rows, `shards` of them, leave the blocks. Slots are numbered in two levels, so a
shard or a group that holds a third of all rows is numbered by many tasks.

Defined results: null and empty texts are one group, 16 bytes a row; repeated rows are rows of the
same group; ties are broken by the key, so reruns agree; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import saved, table, whole

SHARDS = 40
ROW_BYTES = 16
#: Groups differenced by one task; bound of the head, as groups a shard; rows in a slot bucket.
BLOCK_ITEMS = 8192
HEAD = 50
SLOT_BUCKET = 2048


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over partial partitions.

    sums: (items, shards) floats. Returns place (items, shards), the final label of each item's
    label, and the final sums. Ties go by item number, so the result depends on the rows alone.
    """
    items, k = sums.shape
    order = np.argsort(-sums, axis=1, kind="stable")
    state = {i: np.take_along_axis(sums[i], order[i], 0) for i in range(items)}
    # children[n] = (left, right, permutation of right's positions to n's, permutation of left's)
    children: dict[int, tuple] = {}
    heap = [(-(s[0] - s[-1]), i) for i, s in state.items()]
    heapq.heapify(heap)
    new = items
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        joined = state.pop(a) + state.pop(b)[::-1]
        rank = np.argsort(-joined, kind="stable")
        state[new] = joined[rank]
        position = np.empty(k, dtype=np.int64)
        position[rank] = np.arange(k)
        children[new] = (a, b, position)
        heapq.heappush(heap, (-(state[new][0] - state[new][-1]), new))
        new += 1
    root = heap[0][1]
    final = {root: np.arange(k)}
    place = np.empty((items, k), dtype=np.int64)
    for n in range(root, -1, -1):
        at = final.pop(n, None)
        if at is None:
            continue
        if n in children:
            a, b, position = children[n]
            final[a] = at[position]
            final[b] = at[position][::-1]
        else:
            place[n][order[n]] = at
    return place, state[root]


def place_items(sizes: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Labels of single items when they are differenced together with the partial partition base."""
    if not len(sizes):
        return np.empty(0, dtype=np.int64)
    sums = np.zeros((len(sizes) + 1, len(base)))
    sums[0], sums[1:, 0] = base, sizes
    place, _ = difference(sums)
    label_at = np.empty(len(base), dtype=np.int64)
    label_at[place[0]] = np.arange(len(base))
    return label_at[place[1:, 0]]


def _difference_block(base: np.ndarray, rest_bytes: float):
    """Differences one block with its share of base (all of base if rest_bytes is 0)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "gkey"], ascending=[False, True], kind="stable", ignore_index=True)
        sizes = rows["bytes"].to_numpy(dtype=float)
        labels = place_items(sizes, base * (sizes.sum() / rest_bytes if rest_bytes else 1))
        return pd.DataFrame({"gkey": rows["gkey"], "bytes": rows["bytes"], "shard": labels.astype("int32")})

    return run


def assign_groups(groups: DataFrame, shards: int = SHARDS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """groups: (gkey binary, bytes), one row for each group. Returns gkey, shard."""
    spark, out = groups.sparkSession, "gkey binary, bytes long, shard int"
    count, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    is_head = F.col("bytes") * HEAD * shards > total
    head = sorted(((r["bytes"], bytes(r["gkey"])) for r in groups.where(is_head).select("bytes", "gkey").collect()), key=lambda x: (-x[0], x[1]))
    head_sizes = np.array([x[0] for x in head], dtype=float)
    labels = place_items(head_sizes, np.zeros(shards))
    base = np.bincount(labels, weights=head_sizes, minlength=shards).astype(float)
    placed = [spark.createDataFrame([(key, size, int(label)) for (size, key), label in zip(head, labels, strict=True)], out)]
    n_blocks = max(1, -(-(count - len(head)) // block_items))
    rest = groups.where(~is_head).select("gkey", F.col("bytes").cast("long").alias("bytes"), F.pmod(F.xxhash64("gkey"), F.lit(n_blocks)).alias("block"))
    if n_blocks > 1:
        early = saved(rest.where("block > 0").groupBy("block").applyInPandas(_difference_block(base, float(total - head_sizes.sum())), out))
        for r in early.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect():
            base[r["shard"]] += r["bytes"]
        placed.append(early)
    placed.append(rest.where("block = 0").groupBy("block").applyInPandas(_difference_block(base, 0.0), out))
    result = placed[0]
    for part in placed[1:]:
        result = result.unionByName(part)
    return result.select("gkey", "shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    text = whole(F.col("text"))
    rows = saved(docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.md5(text)).alias("gkey")))
    groups = saved(rows.groupBy("gkey").agg(F.sum("size").alias("bytes")))
    shard_of = assign_groups(groups, shards)
    buckets = max(1, -(-rows.count() // (SLOT_BUCKET * shards)))
    dealt = saved(rows.join(shard_of, "gkey").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "gkey"), F.lit(buckets))))
    starts = dealt.groupBy("shard", "bucket").count().select(
        "shard", "bucket", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start")
    )
    at = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "gkey"))
    return (
        dealt.withColumn("at", at)
        .join(starts, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
