"""Confirming a large component: intersections of many sets as products."""

import random

import numpy as np
import pyarrow as pa

from docloom.llm import near_dedup


def test_shared_sizes_are_those_of_the_sets(monkeypatch):
    monkeypatch.setattr(near_dedup, "WIDE", 7)
    r = random.Random(3)
    texts = [[r.randrange(12) for _ in range(r.randrange(0, 30))] for _ in range(40)]
    column = pa.chunked_array([pa.array(texts, pa.list_(pa.int64()))])
    sets = near_dedup._sets(column, 3)
    left, right = near_dedup._members(column.slice(0, 15), 3), near_dedup._members(column.slice(15), 3)
    assert left[2].tolist() == [len(s) for s in sets[:15]]
    assert near_dedup.shared_sizes(left, right).tolist() == [[len(a & b) for b in sets[15:]] for a in sets[:15]]


def test_links_across_are_those_of_all_pairs():
    r = random.Random(4)
    base = [r.randrange(1000) for _ in range(60)]
    texts = [base[: 60 - i % 9] + [2000 + i % 4] * (i % 3) for i in range(30)]
    rows = pa.table({"label": pa.array(range(30)), "w": pa.array(texts, pa.list_(pa.int64()))})
    left, right = rows.slice(0, 10), rows
    sets = near_dedup._sets(rows.column("w"), 3)
    want = {(max(i, j), min(i, j)) for i in range(10) for j in range(30) if i != j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    got = near_dedup._across(3, 85)(left, right)
    assert set(zip(got.column("a").to_pylist(), got.column("b").to_pylist(), strict=True)) == want and 0 < len(want) < 290
    assert np.all(got.column("a").to_numpy() > got.column("b").to_numpy())
