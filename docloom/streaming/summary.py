"""Conversation summaries kept up to date turn by turn: keyed state with the covered turn, waiting turns and the summary itself.

Completed exchanges with a question are stable. The newest `keep` of a conversation wait; when `batch` more have gathered
beyond them, the oldest `batch` are folded into the summary and covered. Only full batches are folded, so the summary
depends on the exchanges and not on how they arrived. Exchanges come in the order of their numbers; a number that is
covered or waits already is ignored, so replays change nothing. The same fold runs over a whole table (`batch_summaries`).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.operators.planning import GOAL_CHARS, ITEM_CHARS, ITEMS

KEEP, BATCH, MAX_CHARS = 4, 4, 1200
# The labels of a folded exchange and how many items a batch gives.
ASKED, FOUND, BATCH_ITEMS = "用户关注：", "已有结论：", 4

EXCHANGES = "conv_id long, turn long, question string, answer string, completed boolean"
SUMMARIES = "conv_id long, covered_turn long, covered_count long, compressions long, waiting int, goal string, questions array<string>, summary string"


def exchanges(turns: DataFrame) -> DataFrame:
    """User turns with the answers that follow at once, from turns (conv_id, turn, role, text); without an answer an exchange isn't completed."""
    from docloom.operators.conversation import turn_pairs

    return turn_pairs(turns).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "question", "answer", F.lit(True).alias("completed"))


def clipped(text: str, size: int) -> str:
    """The end of a text that is too long, behind an ellipsis."""
    return text if len(text) <= size else "…" + text[len(text) - size + 1 :]


class Summary(NamedTuple):
    covered: int = -1
    count: int = 0
    compressions: int = 0
    goal: str = ""
    questions: tuple[str, ...] = ()
    text: str = ""

    def folded(self, batch: list[tuple[int, str, str]]) -> Summary:
        """The summary with a batch of (turn, question, answer)."""
        items: list[str] = []
        for _, question, answer in batch:
            if len(items) < BATCH_ITEMS:
                items.append(ASKED + clipped(question.strip(), ITEM_CHARS))
                if answer.strip():
                    items.append(FOUND + clipped(answer.strip(), ITEM_CHARS))
        text = clipped(";".join(x for x in (self.text, "；".join(items)) if x), MAX_CHARS)
        questions = dict.fromkeys([*self.questions, *(clipped(q.strip(), ITEM_CHARS) for _, q, _ in batch)])
        return Summary(batch[-1][0], self.count + len(batch), self.compressions + 1, self.goal or clipped(batch[-1][1].strip(), GOAL_CHARS), tuple(questions)[:ITEMS], text)


def stable(rows: pd.DataFrame) -> list[tuple[int, str, str]]:
    """(turn, question, answer) of the completed exchanges with a question."""
    out = []
    for turn, question, answer, completed in zip(rows["turn"], rows["question"], rows["answer"], rows["completed"], strict=True):
        if completed and isinstance(question, str) and question.strip() and not pd.isna(turn):
            out.append((int(turn), question, answer if isinstance(answer, str) else ""))
    return out


def refreshed(summary: Summary, waiting: list[tuple[int, str, str]], new: list[tuple[int, str, str]], keep: int, batch: int) -> tuple[Summary, list[tuple[int, str, str]]]:
    """The summary and the exchanges that wait, after new ones."""
    by_turn = {x[0]: x for x in reversed([*waiting, *new]) if x[0] > summary.covered}
    waiting = [by_turn[t] for t in sorted(by_turn)]
    while len(waiting) >= keep + batch:
        summary, waiting = summary.folded(waiting[:batch]), waiting[batch:]
    return summary, waiting


def _row(key: int, summary: Summary, waiting: int) -> pd.DataFrame:
    return pd.DataFrame(
        {"conv_id": [key], "covered_turn": [summary.covered], "covered_count": [summary.count], "compressions": [summary.compressions], "waiting": [waiting], "goal": [summary.goal], "questions": [list(summary.questions)], "summary": [summary.text]}
    )


def batch_summaries(rows: DataFrame, keep: int = KEEP, batch: int = BATCH) -> DataFrame:
    """The summary of every conversation from all its exchanges at once."""

    def run(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        summary, waiting = refreshed(Summary(), [], stable(found.sort_values("turn", kind="stable")), keep, batch)
        return _row(key[0], summary, len(waiting))

    return rows.groupBy("conv_id").applyInPandas(run, SUMMARIES)


class Summaries(StatefulProcessor):
    """Keyed by conversation: the summary as a value, waiting exchanges as a list. State that nobody touches for ttl milliseconds goes (0: never)."""

    def __init__(self, keep: int, batch: int, ttl: int):
        self.keep, self.batch, self.ttl = keep, batch, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = {"ttl_duration_ms": self.ttl} if self.ttl else {}
        self.summary = handle.getValueState("summary", "covered long, count long, compressions long, goal string, questions string, text string", **ttl)
        self.waiting = handle.getListState("waiting", "turn long, question string, answer string", **ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        found = self.summary.get() if self.summary.exists() else None
        summary = Summary() if found is None else Summary(*found[:4], tuple(json.loads(found[4])), found[5])
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        new = [x for part in rows for x in stable(part)]
        summary, waiting = refreshed(summary, waiting, new, self.keep, self.batch)
        self.summary.update((*summary[:4], json.dumps(summary.questions), summary.text))
        if waiting:
            self.waiting.put(waiting)
        else:
            self.waiting.clear()
        yield _row(key[0], summary, len(waiting))

    def close(self) -> None:
        pass


def summaries(rows: DataFrame, keep: int = KEEP, batch: int = BATCH, ttl: int = 0) -> DataFrame:
    """A stream of exchanges to a stream of their conversations' summaries (output mode update).

    The session must keep state in RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    mode = "ProcessingTime" if ttl else "None"
    return rows.groupBy("conv_id").transformWithStateInPandas(Summaries(keep, batch, ttl), SUMMARIES, "update", mode)
