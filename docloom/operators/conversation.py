"""Conversations: turns, memory windows, overflow batches, search, evidence budget, rule-based summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.blocks import folded


def newest_first(order: str = "turn", key: str = "conv_id"):
    return Window.partitionBy(key).orderBy(F.col(order).desc())


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key as one struct aggregate, so the partial aggregation runs before the shuffle."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("x"))
    return best.select(key, *[F.col(f"x.{c}").alias(c) for c in others])


def recent(rows: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation, with their age (1 is the newest)."""
    return rows.withColumn("age", F.row_number().over(newest_first())).where(F.col("age") <= n)


def overflow_batches(rows: DataFrame, keep: int, batch: int) -> DataFrame:
    """All but the last `keep` turns with text, in batches of `batch` in order."""
    stable = rows.where(~T.is_blank(F.col("text")))
    aged = stable.withColumns({"age": F.row_number().over(newest_first()), "n": F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))})
    return aged.where(F.col("age") > keep).select("conv_id", "turn", F.floor((F.col("n") - 1) / batch).alias("batch_no"))


def memory_window(rows: DataFrame, keep: int) -> DataFrame:
    """For each turn the joined text of itself and the keep - 1 turns before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-(keep - 1), 0)
    return rows.select("conv_id", "turn", F.array_join(F.collect_list("text").over(w), "\n").alias("window_text"))


def memory_turns(exchanges: DataFrame, keep: int) -> DataFrame:
    """The turns that a memory shows: of the newest max(3 keep, keep + 4) exchanges those that don't run any more, the newest `keep`, with place from 1 in order.

    exchanges: conv_id, turn, question, answer, status (RUNNING while the answer is written).
    """
    fetched = exchanges.withColumn("age", F.row_number().over(newest_first())).where(F.col("age") <= max(3 * keep, keep + 4))
    ended = fetched.where(F.coalesce("status", F.lit("")) != "RUNNING").withColumn("age", F.row_number().over(newest_first())).where(F.col("age") <= keep)
    return ended.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).drop("age")


def sessions(rows: DataFrame, turns: DataFrame, mode: str = "", keyword: str = "") -> DataFrame:
    """rows: conv_id, name, mode. Sessions of a mode (blank: any) whose id or name holds the keyword, or that have a turn with it (blank: all), without regard to case."""
    if mode.strip():
        rows = rows.where(F.col("mode") == mode.strip())
    if keyword.strip():
        word = F.lit(keyword.strip().lower())
        said = turns.where(F.contains(F.lower("text"), word)).select("conv_id").distinct().withColumn("said", F.lit(True))
        rows = rows.join(said, "conv_id", "left").where(F.contains(F.lower(F.col("conv_id").cast("string")), word) | F.contains(F.lower("name"), word) | F.col("said")).drop("said")
    return rows


def with_latest(rows: DataFrame, others: DataFrame, key: str, order: list[str]) -> DataFrame:
    """All rows, each with the newest of the other table's rows of its key as `latest`, null where there is none."""
    best = others.groupBy(key).agg(F.max_by(F.struct(*[c for c in others.columns if c != key]), F.struct(*order)).alias("latest"))
    return rows.join(best, key, "left")


def token_usage(rows: DataFrame, per_thousand: float = 0.002) -> DataFrame:
    """rows: conv_id, text, tokens (what a model stated, or null). Tokens stated, else estimated, how many rows stated them, and the cost."""
    used = F.coalesce(F.col("tokens").cast("long"), T.token_estimate(F.coalesce("text", F.lit(""))))
    return rows.groupBy("conv_id").agg(F.sum(used).alias("tokens"), F.count("tokens").alias("stated"), F.round(F.sum(used) * per_thousand / 1000, 6).alias("cost"))


def turn_pairs(rows: DataFrame) -> DataFrame:
    """User turns with the assistant turn that follows at once."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    following = rows.withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("text").over(w), "answer_turn": F.lead("turn").over(w)})
    return following.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", "answer_turn", F.col("text").alias("question"), "answer")


def search(rows: DataFrame, keyword: str) -> DataFrame:
    """Conversations with a turn that has the keyword, and their number of turns."""
    hit = rows.where(F.lower("text").contains(keyword.lower())).select("conv_id").distinct()
    return rows.join(hit, "conv_id", "left_semi").groupBy("conv_id").agg(F.count("*").alias("turns"))


def with_latest_role(rows: DataFrame, role: str) -> DataFrame:
    """Conversations whose newest turn has the role."""
    return latest(rows, "conv_id", ["turn"]).where(F.col("role") == role).select("conv_id", F.col("turn").alias("last_turn"))


def message_counts(rows: DataFrame) -> DataFrame:
    said = ~T.is_blank(F.col("text"))
    return rows.groupBy("conv_id").agg(F.count_if(said & (F.col("role") == "user")).alias("questions"), F.count_if(said & (F.col("role") == "assistant")).alias("answers"), F.count_if(said & F.col("role").isin("user", "assistant")).alias("messages"))


def token_cost(rows: DataFrame, per_thousand: float = 0.002) -> DataFrame:
    tokens = T.token_estimate(F.coalesce("text", F.lit("")))
    return rows.groupBy("conv_id").agg(F.sum(tokens).alias("tokens"), F.round(F.sum(tokens) * per_thousand / 1000, 6).alias("cost"), F.max(tokens).alias("longest"))


def evidence_budget(references: DataFrame, total: int, per_question: int) -> DataFrame:
    """references: answer_id, question_no, position, size. Adds rendered: a fold in order over both budgets; a question stops at its first overflow.

    Answers are independent.
    """

    def start():
        used, question, own, stopped = 0, None, 0, False

        def step(row: dict) -> bool:
            nonlocal used, question, own, stopped
            if row["question_no"] != question:
                question, own, stopped = row["question_no"], 0, False
            size = row["size"]
            fits = not stopped and used + size <= total and own + size <= per_question
            if fits:
                used, own = used + size, own + size
            stopped = not fits
            return fits

        return step

    rows = references.select("answer_id", "question_no", "position", F.coalesce("size", F.lit(0)).alias("size"))
    return folded(rows, ["answer_id"], ["question_no", "position"], "rendered", "boolean", start)


def merged_summary(batches: DataFrame, highlights: int = 4, item_chars: int = 80) -> DataFrame:
    """Rule-based summary of a conversation: its first question as goal, the newest distinct questions as highlights."""
    asked = batches.where((F.col("role") == "user") & ~T.is_blank(F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", T.clip_head(T.compact(F.col("text")), item_chars).alias("item"))))
    items = F.array_distinct(F.transform(F.reverse("xs"), lambda x: x["item"]))
    return asked.groupBy("conv_id").agg(ordered.alias("xs")).select("conv_id", F.get("xs", 0)["item"].alias("goal"), F.slice(items, 1, highlights).alias("highlights"), F.element_at("xs", -1)["turn"].alias("covered_turn"), F.size("xs").alias("covered_count"))
