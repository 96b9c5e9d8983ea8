"""The pipeline's stages on small tables with null and repeated ids, repeated rows, ties, empty and long texts and extra columns."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from docloom.llm import decontaminate, licenses, mixing, near_dedup, quality

WORDS = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string"


def texts():
    r = random.Random(9)
    vocabulary = [f"word{i}" for i in range(400)]
    some = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    item = some(40)
    rows = [None, "", " \n ", "one", some(60), some(120), some(3000)]
    base = some(150)
    rows += [base, base, base + " tail", f"{some(50)} {item} {some(50)}", item.upper(), some(90), some(90)]
    rows += [some(70) for _ in range(12)]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 7, None, None, 8, 8, None] + [20 + i // 2 for i in range(12)]
    return item, [(i, t, "en", [None, "a", "b"][n % 3], len(t or ""), f"r{n}") for n, (i, t) in enumerate(zip(ids, rows, strict=True))]


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    item, rows = texts()
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(5, item), (6, None), (7, "too short")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(4, 26)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, item, rows


def shingles(t, k=5):
    w = re.findall(WORDS, (t or "").lower())
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def alike(a, b):
    n = len(a & b)
    return bool(n) and 100 * n >= 80 * (len(a) + len(b) - n)


def one_of_each(rows):
    sets = [shingles(x[1]) for x in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if alike(sets[a], sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    return sets, group


def test_stages_against_brute_force(spark, case):
    folder, item, rows = case
    docs = corpus_pipeline.table(spark, folder, "documents")
    kept = corpus_pipeline.quality(spark, docs, folder).collect()
    assert {r["row"] for r in kept} == {x[5] for x in rows if len(re.findall(WORDS, x[1] or "")) >= 50}  # no text repeats its windows
    unique = corpus_pipeline.near_dedup(spark, docs, folder).collect()
    sets, group = one_of_each(rows)
    for g in set(group):
        members = [rows[i] for i in range(len(rows)) if group[i] == g]
        stay = [r for r in unique if r["row"] in {m[5] for m in members}]
        assert len(stay) == 1
        with_id = [m[0] for m in members if m[0] is not None]
        assert stay[0]["doc_id"] == (min(with_id) if with_id else None)
    clean = {r["row"] for r in corpus_pipeline.decontamination(spark, docs, folder).collect()}
    want = shingles(item)
    assert clean == {x[5] for x in rows if len(shingles(x[1]) & want) < 0.8 * len(want)}
    assert docs.columns == corpus_pipeline.decontamination(spark, docs, folder).columns == corpus_pipeline.near_dedup(spark, docs, folder).columns


def test_mix_takes_what_the_plan_says(spark, case):
    folder, _, rows = case
    docs = corpus_pipeline.table(spark, folder, "documents")
    plan, mix = Counter(), Counter()
    for r in mixing.mix_plan(docs).collect():
        plan[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    mixed = corpus_pipeline.mixing(spark, docs, folder).collect()
    originals = {x[5]: re.findall(WORDS, x[1] or "") for x in rows}
    for r in mixed:
        w = re.findall(WORDS, r["text"])
        assert w == originals[r["row"]][: len(w)] and r["n_chars"] == len(r["text"])
        mix[r["source"]] += len(w)
    assert {s: n for s, n in plan.items() if n} == dict(mix)
    targets = {r["source"]: r["target"] for r in mixing.mix_plan(docs).collect()}
    assert all(abs(plan[s] - targets[s]) <= 3 for s in targets)
    assert sorted(map(tuple, mixed), key=repr) == sorted(map(tuple, corpus_pipeline.mixing(spark, docs.repartition(5), folder).collect()), key=repr)


def test_mix_of_rows_that_are_all_the_same(spark):
    docs = spark.createDataFrame([(None, "a b c d", "s")] * 7 + [(1, "a b c d", "t")] * 4, "doc_id long, text string, source string")
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == 11
    for s in "st":
        part = [r for r in plan if r["source"] == s]
        assert abs(sum(r["taken"] for r in part) - part[0]["target"]) < len(part)


def test_run_is_the_chain_of_stages(spark, case):
    folder, item, rows = case
    got = corpus_pipeline.run(spark, folder).collect()
    docs = corpus_pipeline.table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, folder))
    mix = docs.collect()
    assert sorted(r["doc_id"] or -1 for r in got) == sorted(r["doc_id"] or -1 for r in mix)
    assert len(mix) > 10 and all(len(shingles(r["text"]) & shingles(item)) < 0.8 * len(shingles(item)) for r in mix)
    slots = Counter((r["shard"], r["slot"]) for r in got)
    assert max(slots.values()) == 1


def test_empty_tables(spark, case):
    folder = case[0]
    docs = corpus_pipeline.table(spark, folder, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_near_dedup_by_row(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(5, long), (5, "other words in here"), (None, long), (None, "x y z q"), (None, "x y z q"), (2, "other words in here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(docs, 3, 85).collect()), key=repr)
    assert sorted((r[0], r[2]) for r in got if r[0] is not None) == [(2, 2), (5, 2), (5, 5)]
    assert sorted((r[2] is None, r[3]) for r in got if r[0] is None) == [(False, False), (True, False), (True, True)]
    assert near_dedup.deduplicated(docs, 3, 85).count() == 3


def test_item_index_partitions_by_size():
    r = random.Random(4)
    items = [(n, " ".join(f"i{n}w{r.randrange(4000)}" for _ in range(size))) for n, size in enumerate([5, 6, 9, 20, 40, 80, 200, 900])]
    index = decontaminate.ItemIndex(items)
    assert len(index.partitions) >= 6
    for n, text in items:
        w = text.split()
        cut = w[: max(5, len(w) - (len(w) - 4) // 5)]
        held = len({tuple(cut[j : j + 5]) for j in range(len(cut) - 4)}) >= 0.8 * len({tuple(w[j : j + 5]) for j in range(len(w) - 4)})
        for found, part in ((True, w), (held, cut), (False, w[: len(w) // 2])):
            assert (n in [x[0] for x in index.find("before " * 300 + " ".join(part) + " after" * 300)]) == found, (n, len(part))


def test_least_hits_bounds_the_misses():
    r = random.Random(8)
    for size in (31, 127, 1023):
        held, needed = -(-size * 8 // 10), decontaminate.least_hits(size, 16, 0.8, 1e-3)
        misses = sum(sum(x < held for x in r.sample(range(size), 16)) < needed for _ in range(20_000))
        assert misses <= 60


def test_licences_held_out_recall_and_calibration(spark):
    """Examples drawn apart from training: notices cut, damaged and put into text, and plain paragraphs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = licenses.fit_on(docs, 1500)
    r = random.Random(99)
    plain = [line for x in docs.where("doc_id % 7 = 3").collect() for line in x["text"].split("\n") if line.strip()]
    plain = [p for p in plain if not re.search("licen|rights|copyright|spdx|permission|warrant|creative commons|proprietary|redistrib|public domain", p, re.I)][:1500]
    right = found = 0
    chances, truth = [], []
    for family, notices in licenses.TEMPLATES.items():
        for notice in notices:
            for _ in range(6):
                w = [x for x in notice.split() if r.random() > 0.04]
                text = f"{r.choice(plain)[:80]} {' '.join(w)}" if r.random() < 0.5 else " ".join(w)
                got = model.scan(text)
                right, found = right + (got is not None and got[0] == family), found + 1
                p = model.probabilities(set(licenses.ngrams(licenses.tokens(text))))
                chances.append(float(p.max()))
                truth.append(model.families[int(p.argmax())] == family)
    assert right >= 0.9 * found, (right, found)
    assert sum(model.scan(p) is not None for p in plain) <= 0.005 * len(plain)
    error = 0.0
    for low in (0.0, 0.2, 0.4, 0.6, 0.8):
        part = [i for i, c in enumerate(chances) if low < c <= low + 0.2]
        error += abs(sum(chances[i] for i in part) - sum(truth[i] for i in part)) / len(chances)
    assert error <= 0.1, error


def test_quality_columns_of_symbols_and_repeats(spark):
    texts = ["# a * b $ % & | < > c", "x y z x y z x", "a b c d a b c", "q " * 60, None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["row"]["doc_id"]: (r["n_words"], r["n_symbols"], r["n_repeat_words"], r["base_failed"]) for r in quality.score_documents(docs, quality.fit_ratio(docs, labels, bins=64)).collect()}
    assert got == {0: (11, 8, 0, True), 1: (7, 0, 7, True), 2: (7, 0, 6, True), 3: (60, 0, 60, True), 4: (0, 0, 0, True)}
    many = docs.select(F.explode(F.array_repeat("text", 3)).alias("text")).withColumn("doc_id", F.lit(None).cast("long"))
    assert quality.kept_documents(many, quality.fit_ratio(many, labels, bins=64)).count() == 0
