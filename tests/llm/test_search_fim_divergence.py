"""Exact search, fill-in-middle and source divergence: odd rows, hot groups and hidden bounds against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import divergence, fill_middle, voronoi_knn

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
VECTORS = "vec_id long, embedding array<float>, row int, cell string, v int, far int, score string"


# exact search


def nearest(rows, k, every):
    """Brute force over (vec_id, vector) rows."""
    sound = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(sound):
        if i is None or i % every:
            continue
        scored = [(-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(q, v, strict=True)))), j is None, j or 0) for b, (j, v) in enumerate(sound) if b != a and len(v) == len(q)]
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def searched(spark, rows, k=5, every=50, **settings):
    frame = spark.createDataFrame([(i, v, 1, "c", 2, 3, "s") for i, v in rows], VECTORS).repartition(3)
    return sorted((tuple(r) for r in voronoi_knn.top_products(frame, k, every, **settings).select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def test_search_with_odd_rows(spark):
    r = random.Random(1)
    vector = lambda n: [r.uniform(-1, 1) for _ in range(n)]
    rows = [(i, vector(6)) for i in range(120)] + [(i, [0.5] * 6) for i in range(200, 260)] + [(None, vector(6)), (None, [0.5] * 6), (50, vector(6)), (50, [0.5] * 6)]
    rows += [(300, None), (301, [None] * 6), (350, [float("nan")] * 6), (351, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (400, []), (401, []), (450, vector(3)), (451, vector(3)), (500, [1e15] * 6), (501, [0.0] * 6)]
    assert searched(spark, rows) == nearest(rows, 5, 50)


def test_search_of_an_empty_table_and_few_rows(spark):
    assert searched(spark, []) == []
    assert searched(spark, [(0, [1.0, 2.0])]) == []
    assert searched(spark, [(0, [1.0, 2.0]), (7, [0.0, -1.0])]) == [(0, 1, 7, -(2**17))]


def test_search_prunes_cells_and_stays_exact(spark, monkeypatch):
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 8)) * 4
    rows = [(i, (centres[i % 12] + r.normal(size=8) * 0.05).astype(np.float32).tolist()) for i in range(600)]
    # a group of copies larger than a group of rows
    rows += [(i, centres[3].astype(np.float32).tolist()) for i in range(600, 800)]
    monkeypatch.setattr(voronoi_knn, "DATA_GROUP", 60)
    monkeypatch.setattr(voronoi_knn, "QUERY_GROUP", 4)
    asked = []
    made = voronoi_knn.Bounds
    monkeypatch.setattr(voronoi_knn, "Bounds", lambda *args: asked.append(made(*args)) or asked[-1])
    assert searched(spark, rows, every=10) == nearest(rows, 5, 10)
    needed = asked[0].needed
    asking = np.flatnonzero(asked[0].queries[:-1] > 0)
    assert needed[asking].sum() < 0.5 * len(asking) * (asked[0].rows > 0).sum()


def test_search_beyond_doubles():
    a, b = np.array([[2**40, 1]]), np.array([[2**20, 1], [-(2**20), 3], [2**40, 0]])
    assert voronoi_knn._products(a, b).tolist() == [[2**60 + 1, -(2**60) + 3, 2**63 - 1]]


# fill-in-middle


def brute_fim(doc_id, text):
    text = text or ""
    units = TOKENS.findall(text)
    n, digest = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(" \t\n\x0b\x0c\r\x1c\x85 abé中😀<>PSM"), max_size=60), st.integers(-3, 500))
def test_fim_of_any_text(text, doc_id):
    assert fill_middle.transformed(doc_id, text) == brute_fim(doc_id, text)


@given(st.integers(0, 2**200))
def test_ranked_bits(mask):
    places = [i for i in range(201) if mask >> i & 1]
    assert [fill_middle.ranked_bit(mask, 201, r + 1) for r in range(len(places))] == places


def test_fim_rows(spark, monkeypatch):
    monkeypatch.setattr(fill_middle, "BATCH_BYTES", 1000)
    texts = [None, "", "  ", "a", "holds <S> itself", "<", "long " * 40_000, "x" * 300_000, " lead and trail \n", "é中😀 " * 50, "a", "a"]
    rows = [(i if i % 4 else None, t, "o", 1, "f") for i, t in enumerate(texts * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int, form string").repartition(3)
    made = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in made), key=repr) == sorted(((i, *brute_fim(i, t)) for i, t, *_ in rows), key=repr)
    by_output = defaultdict(set)
    for i, t, *_ in rows:
        by_output[brute_fim(i, t)[4]].add(t or "")
    assert all(r["back"] in by_output[r["output"]] for r in made) and {r["form"] for r in made} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


# source divergence


def brute_divergence(rows, least, top):
    """rows: (text, lang, source). Exact integers of Python."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [([t.translate(low) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")], lang or "", source or "") for text, lang, source in rows]
    out = []
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        kept = [t for t, n in Counter(t for d in own for t in set(d[0])).items() if n >= least]
        counts = {s: Counter(t for d in own if d[2] == s for t in d[0]) for s in {d[2] for d in own}}
        counts[None] = Counter(t for d in own for t in d[0])
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept} for s, c in counts.items()}
        for s in counts:
            if s is None:
                continue
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in counts if o not in (None, s)]
            terms = [(p[None][t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, r + 1) for r, (v, item) in enumerate(found)]
    return sorted(out)


def divergence_rows():
    r = random.Random(9)
    vocabulary = [f"Wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["é", "ÉÉ", "中文", "😀", "x" * 5000]
    text = lambda n: " ".join(r.choice(vocabulary[: r.choice([5, 30, 65])]) + r.choice(["", ",", "1", "_"]) for _ in range(n))
    rows = [(text(r.randrange(40)), r.choice(["en", "en", "de", None]), r.choice(["a", "a", "b", "ç", None, "😀", "c,d"])) for _ in range(160)]
    rows += [(None, "en", "silent"), ("", "fr", "x"), ("12 34", "fr", "y"), ("alone here", "it", "only"), ("tiny " * 90_000, "en", "a"), ("", "", "b")]
    return rows + rows[:20]


@pytest.mark.parametrize("small", [False, True])
def test_divergence(spark, monkeypatch, small):
    if small:  # chunks of a few terms, flushes within a task, texts cut into pieces
        monkeypatch.setattr(divergence, "CELLS", 30)
        monkeypatch.setattr(divergence, "HELD", 20)
        monkeypatch.setattr(divergence, "PIECE", 64)
    rows = divergence_rows()
    docs = spark.createDataFrame([(None if i % 3 else 1, *x, "z", 5) for i, x in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, chunk int").repartition(3)
    got = [tuple(r) for r in divergence.source_divergence(docs, min_documents=4, top=6).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert sorted(got) == brute_divergence(rows, 4, 6)


def test_divergence_of_an_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


@given(st.integers(0, 10**12), st.integers(1, 10**15))
def test_probabilities_are_exact(count, rest):
    total = count + 5 + rest
    assert int(divergence.probabilities(np.array([count]), total)[0]) == 1 + 10**9 * (count + 5) // total
