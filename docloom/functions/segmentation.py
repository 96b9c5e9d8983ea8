"""Word segmentation: a lattice of dictionary words with the most probable path, and character states for what the dictionary lacks.

A run of letters is cut where the product of its words' probabilities is largest (dynamic programming from its end). Single
characters that no word covers are runs of unknown text: a Viterbi pass over the states begin, middle, end and single of
a character gives their words. Both models are learned from a corpus: word counts, and from the same words how often a
character stands in each state and one state follows another. A dictionary without counts is counted in the corpus
by cutting it with the counts so far, a few rounds over.

Defined results: null and blank texts have no words; text outside runs parts words; ties go to the longer first word; a
model of an empty corpus cuts every run by single characters.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs that are cut: Han characters by default; LETTERS cuts compounds of any script. Other letters and digits stay whole.
HAN = r"[㐀-䶿一-鿿豈-﫿\U00020000-\U0003134f]+"
LETTERS = r"[^\W\d_]+"
WHOLE = r"[^\W_]+"
#: Words of a dictionary at most (the most frequent), characters of a word at most, count of what was never seen.
MOST_WORDS, LONGEST, UNSEEN = 500_000, 32, 0.5
STATES = "BMES"
FOLLOWERS = {"B": "ME", "M": "ME", "E": "BS", "S": "BS"}


class Model(NamedTuple):
    """Logarithms: of words, of a character never seen, and of state starts, steps and characters; `bare` is that of a character new to a state."""

    words: dict[str, float]
    unseen: float
    longest: int
    start: dict[str, float]
    step: dict[tuple[str, str], float]
    shown: dict[tuple[str, str], float]
    bare: dict[str, float]


def fitted(counts: Iterable[tuple[str, float]]) -> Model:
    """The model of counted words."""
    counts = [(w, n) for w, n in counts if 0 < len(w) <= LONGEST and n > 0]
    total = sum(n for _, n in counts) + UNSEEN
    of_state: dict[str, float] = defaultdict(float)
    follows: dict[tuple[str, str], float] = defaultdict(float)
    shown: dict[tuple[str, str], float] = defaultdict(float)
    for word, n in counts:
        states = "S" if len(word) == 1 else f"B{'M' * (len(word) - 2)}E"
        for state, character in zip(states, word, strict=True):
            of_state[state] += n
            shown[state, character] += n
        for a, b in zip(states, states[1:], strict=False):
            follows[a, b] += n
    several, single = of_state["B"] + UNSEEN, of_state["S"] + UNSEEN
    for end in "ES":  # whatever ends a word is followed by one of any length
        follows[end, "B"], follows[end, "S"] = several, single
    alphabet = len({c for _, c in shown}) + 1
    step = {(a, b): math.log((follows[a, b] + UNSEEN) / (sum(follows[a, x] for x in FOLLOWERS[a]) + 2 * UNSEEN)) for a in STATES for b in FOLLOWERS[a]}
    size = {s: of_state[s] + UNSEEN * alphabet for s in STATES}
    return Model(
        {w: math.log(n / total) for w, n in counts}, math.log(UNSEEN / total), max((len(w) for w, _ in counts), default=1),
        {"B": math.log(several / (several + single)), "S": math.log(single / (several + single))}, step,
        {(s, c): math.log((n + UNSEEN) / size[s]) for (s, c), n in shown.items()}, {s: math.log(UNSEEN / size[s]) for s in STATES},
    )


def best_path(run: str, model: Model) -> list[str]:
    """The most probable words of a run; a character without a word counts as never seen."""
    n = len(run)
    best, cut = [0.0] * (n + 1), [0] * n
    for i in range(n - 1, -1, -1):
        best[i] = -math.inf
        for j in range(min(n, i + model.longest), i, -1):
            log = model.words.get(run[i:j], model.unseen if j == i + 1 else None)
            if log is not None and log + best[j] > best[i]:
                best[i], cut[i] = log + best[j], j
    words, i = [], 0
    while i < n:
        words.append(run[i : cut[i]])
        i = cut[i]
    return words


def best_states(run: str, model: Model) -> str:
    """The most probable states of a run's characters; the last ends a word."""
    look = lambda s, c: model.shown.get((s, c), model.bare[s])
    scores = {s: model.start.get(s, -math.inf) + look(s, run[0]) for s in STATES}
    back: list[dict[str, str]] = []
    for c in run[1:]:
        came = {b: max((a for a in STATES if b in FOLLOWERS[a]), key=lambda a: (scores[a] + model.step[a, b], a)) for b in STATES}
        scores = {b: scores[came[b]] + model.step[came[b], b] + look(b, c) for b in STATES}
        back.append(came)
    state = max("ES", key=lambda s: (scores[s], s))
    out = [state]
    for came in reversed(back):
        state = came[state]
        out.append(state)
    return "".join(reversed(out))


def unknown_words(run: str, model: Model) -> list[str]:
    words, start = [], 0
    for i, state in enumerate(best_states(run, model)):
        if state in "ES":
            words.append(run[start : i + 1])
            start = i + 1
    return words


def cut_run(run: str, model: Model) -> list[str]:
    words, unknown = [], ""
    for word in [*best_path(run, model), ""]:
        if len(word) == 1 and word not in model.words:
            unknown += word
            continue
        if unknown:
            words += unknown_words(unknown, model) if len(unknown) > 1 else [unknown]
            unknown = ""
        if word:
            words.append(word)
    return words


def cut_text(text: str | None, model: Model, runs: str = HAN, known: dict[str, list[str]] | None = None) -> list[str]:
    """The words of a text. known: words of runs that were cut before."""
    words = []
    for m in re.finditer(rf"({runs})|{WHOLE}" if runs != HAN else rf"({HAN})|(?:(?!{HAN}){WHOLE[:-1]})+", text or ""):
        if m[1] is None:
            words.append(m[0])
            continue
        found = known.get(m[1]) if known is not None else None
        if found is None:
            found = cut_run(m[1], model)
            if known is not None and len(known) < 200_000:
                known[m[1]] = found
        words += found
    return words


def segmented(rows: DataFrame, column: str, model: Model, runs: str = HAN) -> DataFrame:
    """rows with `tokens`, the words of a text column, lower-cased."""
    schema = rows.withColumn("tokens", F.array().cast("array<string>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column))
            tokens = pa.array([cut_text(x.as_py().lower() if x.is_valid else None, model, runs, known) for x in texts], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, tokens], [*batch.schema.names, "tokens"])

    return rows.mapInArrow(run, schema)


def _most_frequent(counts: DataFrame, most: int) -> list[tuple[str, float]]:
    best = counts.where(F.char_length("word").between(1, LONGEST) & (F.col("n") > 0)).orderBy(F.desc("n"), "word").limit(most)
    return [(r["word"], float(r["n"])) for r in best.collect()]


def learned(texts: DataFrame, column: str, dictionary: DataFrame | None = None, runs: str = HAN, least: int = 2, rounds: int = 2, most: int = MOST_WORDS) -> Model:
    """A model of a corpus. dictionary: (word) or (word, n); without one, the runs found at least `least` times are the words.

    The dictionary is bounded by `most` words; counts are of all texts.
    """
    if dictionary is None:
        java = rf"\p{{IsHan}}+" if runs == HAN else r"\p{L}+"
        found = texts.select(F.explode(F.regexp_extract_all(F.lower(column), F.lit(java), F.lit(0))).alias("word"))
        return fitted(_most_frequent(found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least), most))
    words = dictionary.select(F.lower("word").alias("word"), (F.col("n") if "n" in dictionary.columns else F.lit(1)).alias("n")).groupBy("word").agg(F.max("n").alias("n"))
    model = fitted(_most_frequent(words, most))
    for _ in range(0 if "n" in dictionary.columns else rounds):
        counted = segmented(texts.select(column), column, model, runs).select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
        recount = words.select("word").join(counted, "word", "left").select("word", F.coalesce(F.col("n"), F.lit(UNSEEN)).alias("n"))
        model = fitted(_most_frequent(recount, most))
    return model
