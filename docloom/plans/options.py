"""Run-time options of retrieval, their defaults and the plan of channels."""

from __future__ import annotations

from dataclasses import dataclass, field

# Defaults of the retrieval engine.
RRF_K = 60
RANK_WEIGHT, ORIGINAL_WEIGHT, BOOST_WEIGHT, MAX_BOOST = 1.0, 0.08, 0.04, 1.0
KEYWORD_FLOOR, VECTOR_MINIMUM = 0.35, 0.45
CANDIDATES, FINAL_TOP_K = 40, 6
BM25_K1, BM25_B = 1.2, 0.75
TOTAL_BUDGET, QUESTION_BUDGET = 5200, 2200


@dataclass(frozen=True)
class Channel:
    name: str
    enabled: bool = True
    top_k: int = 10
    rank_weight: float = RANK_WEIGHT
    original_weight: float = ORIGINAL_WEIGHT
    minimum_score: float = 0.0
    relative_floor: float = 0.0

    def __post_init__(self):
        if not self.name.strip():
            raise ValueError("a channel needs a name")


@dataclass(frozen=True)
class Plan:
    channels: tuple[Channel, ...] = field(
        default=(Channel("vector", minimum_score=VECTOR_MINIMUM), Channel("keyword", relative_floor=KEYWORD_FLOOR))
    )
    boost_weight: float = BOOST_WEIGHT
    max_boost: float = MAX_BOOST
    candidates: int = CANDIDATES
    final_top_k: int = FINAL_TOP_K

    def __post_init__(self):
        names = [c.name for c in self.channels]
        if len(names) != len(set(names)):
            raise ValueError("channel names must be unique")

    def enabled(self) -> tuple[Channel, ...]:
        return tuple(c for c in self.channels if c.enabled)


@dataclass(frozen=True)
class Request:
    """A checked search request: a question, and documents with the index tasks they were indexed by, one each."""

    question: str
    document_ids: tuple[int, ...]
    task_ids: tuple[int, ...]
    plan: Plan = field(default_factory=Plan)

    def __post_init__(self):
        if not self.question.strip():
            raise ValueError("a request needs a question")
        if not self.document_ids:
            raise ValueError("a request needs documents to search")
        if len(self.document_ids) != len(self.task_ids):
            raise ValueError(f"{len(self.document_ids)} documents have {len(self.task_ids)} tasks")
        if any(x <= 0 for x in (*self.document_ids, *self.task_ids)):
            raise ValueError("documents and tasks have positive ids")
        if not self.plan.enabled():
            raise ValueError("a request needs an enabled channel")
