"""Extension points: named functions that a user adds or replaces - embedders, scorers, memory strategies, recognisers, tokenisers, rerankers, parsers and callbacks."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import conversation, retrieval, routing
from docloom.sources import index


class Registry:
    """Functions of one kind by name; names are looked up without regard to case."""

    def __init__(self, kind: str):
        self.kind, self._known = kind, {}

    def add(self, name: str, function: Callable[..., Any]) -> Callable[..., Any]:
        if not name.strip():
            raise ValueError(f"a {self.kind} needs a name")
        self._known[name.strip().lower()] = function
        return function

    def get(self, name: str) -> Callable[..., Any]:
        try:
            return self._known[name.strip().lower()]
        except KeyError:
            raise KeyError(f"no {self.kind} called {name}; there are {sorted(self._known)}") from None

    def names(self) -> list[str]:
        return sorted(self._known)


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """A bag of words as a vector: how many terms fall in each of `size` bins. The default embedder, so routes work without a model."""
    bins = F.transform(index.terms_of(text), lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda b: F.size(F.filter(bins, lambda x: x == b)).cast("double"))


def recent_memory(turns: DataFrame, keep: int) -> DataFrame:
    return conversation.recent(turns, keep)


EMBEDDERS, SCORERS, MEMORIES, RECOGNISERS, TOKENISERS, RERANKERS, LEXICAL, CALLBACKS = (
    Registry(kind) for kind in ("embedder", "scorer", "memory strategy", "intent recogniser", "tokeniser", "reranker", "lexical index", "callback")
)
EMBEDDERS.add("hashed", hashed_embedding)
SCORERS.add("weighted", routing.route_score)
MEMORIES.add("window", conversation.memory_window)
MEMORIES.add("recent", recent_memory)
RECOGNISERS.add("rules", routing.intent_columns)
TOKENISERS.add("latin_han", index.terms_of)
RERANKERS.add("by_position", retrieval.reranked)
LEXICAL.add("bm25", retrieval.keyword_hits)


def told(event: str, rows: DataFrame) -> DataFrame:
    """Passes rows through all callbacks, each called with the event and the rows; what one returns (or the rows) goes to the next."""
    for name in CALLBACKS.names():
        rows = CALLBACKS.get(name)(event, rows) or rows
    return rows
