"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import decontaminate, licenses, line_dedup, mixing, near_dedup, quality, sharding, substring_dedup, suffix_array, warc

BLANK = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, source string, chunk string, w int, label string"


def corpus():
    r = random.Random(11)
    vocabulary = [f"word{i}" for i in range(300)] + ["Ünï", "naïve"]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    base = [r.choice(vocabulary) for _ in range(120)]
    texts = [None, "", "   \n\t", "a", "a", "A b", "x" * 5000]
    for i in range(40):
        w = [r.choice(vocabulary) for _ in range(r.randrange(5, 150))]
        if i % 3 == 0:
            w[3:3] = passage.split()
        texts.append("\n".join(" ".join(w[j : j + 12]) for j in range(0, len(w), 12)) + ("\nCommon line\n" if i % 2 else ""))
    for i in range(16):
        w = list(base)
        for _ in range(i % 5):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [texts[9], texts[9], texts[20]]
    return [(i, t, [None, "s1", "s2", "s3"][i % 4], "x", 1, "y") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup(docs, rows, empty):
    keys = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")]
    counts = Counter(k for _, t, *_ in rows for k in set(keys(t)) if k)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup_lines(docs).collect()}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t), strict=True) if counts[k] < 10]
        assert got[i] == (len(lines), len(lines) - len(kept), "\n".join(kept)), i
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_keys_fold_the_case_of_ascii_letters_only(spark):
    forms = ["Straße A", "strasse a", "straße a", "É x", "é x", "\u212a k", "k \u212a", "K k", "\u0130I", "\u0130i", "i\u0307i", "ΣΑΣ b", "ΣΑΣ B", "σας b"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(forms)], "i int, x string").select("i", line_dedup.line_keys(F.col("x"))[0].alias("k")).collect()
    keys = {r["i"]: bytes(r["k"]) for r in rows}
    fold = [x.translate({c: c + 32 for c in range(65, 91)}) for x in forms]
    assert all((keys[i] == keys[j]) == (fold[i] == fold[j]) for i in keys for j in keys)


def test_line_runs_give_only_lines_not_seen_before(spark):
    runs = line_dedup.LineRuns()
    batch = lambda *t: spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    assert line_dedup.first_seen_lines(batch("a\nb"), runs).count() == 2
    assert [r["line"] for r in line_dedup.first_seen_lines(batch("A \nc"), runs).collect()] == ["c"]
    assert line_dedup.first_seen_lines(batch("b\nc"), runs).count() == 0


def test_licenses():
    model = licenses.train(["nothing to see here at all", "some words of an ordinary text about the weather"] * 20)
    assert model.scan("Released under the MIT License.")[0] == "MIT"
    assert model.scan("foo bar. Licensed under the Apache License, Version 2.0. And more text follows here")[0] == "Apache-2.0"
    assert model.scan("This work is licensed under the GNU General Public License, version 3.")[0] == "GPL"
    assert model.scan("The terms of the agreement were to be discussed at the meeting.") is None
    held = [f for f, texts in licenses.TEMPLATES.items() for t in texts if (model.scan(t) or ("",))[0] == f]
    assert len(held) >= 0.9 * sum(map(len, licenses.TEMPLATES.values()))


def test_license_table(docs, empty):
    model = licenses.train(["plain text"] * 5)
    assert licenses.scan_licenses(docs, model).count() == 0 and licenses.scan_licenses(empty, model).count() == 0


def test_quality(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(7, 40)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    ratios = quality.fit_ratio(docs, labels, bins=256)
    got = {r["row"]["doc_id"]: r for r in quality.score_documents(docs, ratios).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        w = re.findall(BLANK, t or "")
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        counts, covered = Counter(grams), set()
        for j, g in enumerate(grams):
            covered |= {j, j + 1, j + 2} if counts[g] > 1 else set()
        lines = [x for x in (t or "").split("\n") if re.search(BLANK, x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    kept = quality.kept_documents(docs, ratios)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality.score_documents(empty, quality.fit_ratio(empty, labels, bins=8)).count() == 0


def test_differencing_balances():
    r = np.random.default_rng(5)
    sizes = r.integers(1, 1000, 200).astype(float)
    labels = sharding.place_items(sizes, np.zeros(7))
    sums = np.bincount(labels, weights=sizes, minlength=7)
    assert sums.max() - sums.min() <= 5
    uneven = np.array([5000.0, 0, 0, 0, 0, 0, 0])
    sums = uneven + np.bincount(sharding.place_items(sizes, uneven), weights=sizes, minlength=7)
    assert sums.max() - sums.min() <= 0.02 * sums.mean()


def test_sharding(docs, rows, empty):
    got = {r["doc_id"]: r for r in sharding.shard_documents(docs, 5).collect()}
    assert len(got) == len(rows)
    shard_of, slots = {}, {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"]) == (len(b) + 16, zlib.crc32(b))
        assert shard_of.setdefault(b, got[i]["shard"]) == got[i]["shard"]
        slots.setdefault(got[i]["shard"], []).append(got[i]["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty, 5).count() == 0


def test_suffix_array(docs, rows, empty):
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], i)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_array.dedup_repeats(docs).collect()}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = True
        runs = sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1]))
        assert got[i] == (len(b), int(gone.sum()), runs, bytes(x for x, g in zip(b, gone, strict=False) if not g)), i
    assert suffix_array.dedup_repeats(empty).count() == 0


@pytest.mark.parametrize("hot", [suffix_array.HOT, 3])
def test_suffix_array_with_copies_repeated_and_null_ids(monkeypatch, spark, hot):
    monkeypatch.setattr(suffix_array, "HOT", hot)
    r = random.Random(5)
    make = lambda n: "".join(r.choice("abcdefghij é") for _ in range(n))
    long, passages = make(3000), [make(n) for n in (49, 50, 51, 90, 400)]
    texts = [long, long, long[:1500] + "#" + long[1500:], "ab" * 300, "ab" * 200 + make(60), passages[4] * 3, passages[4] * 2 + make(30) + passages[4]]
    texts += [make(r.randrange(80)) + r.choice(passages) + make(r.randrange(80)) + r.choice(passages) for _ in range(40)]
    ids = [*range(len(texts) - 4), 3, 5, None, None]
    r.shuffle(ids)
    last, least = 1 << 62, {}
    for i, t in zip(ids, texts, strict=True):
        b = t.encode()
        for j in range(len(b) - 49):
            least[b[j : j + 50]] = min(least.get(b[j : j + 50], last), last if i is None else i)
    want = []
    for i, t in zip(ids, texts, strict=True):
        b, gone = t.encode(), set()
        for j in range(len(b) - 49):
            if least[b[j : j + 50]] < (last if i is None else i):
                gone.update(range(j, j + 50))
        want.append((i, len(b), len(gone), sum(j - 1 not in gone for j in gone), bytes(x for j, x in enumerate(b) if j not in gone)))
    rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = [(x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in suffix_array.dedup_repeats(rows).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("window", [35, 9])
def test_substring_dedup(docs, rows, empty, window):
    counts = Counter(tuple(w[j : j + window]) for _, t, *_ in rows for w in [re.findall(BLANK, t or "")] for j in range(len(w) - window + 1))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.dedup_substrings(docs, window).collect()}
    for i, t, *_ in rows:
        w = re.findall(BLANK, t or "")
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if counts[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        assert got[i] == (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)), i
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<title>T &amp; U</title><script>x<y</script><p>one&nbsp;&#233;<b>two</b><br>three &unknown; &lt;x&gt;"), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    records = warc.derivatives(warc.responses(pages))
    got = {(r["page_id"], r["record_type"]): r for r in records.collect()}
    assert len(got) == 6
    assert got[1, "conversion"]["block"] == "T & U\none étwo\nthree &unknown; <x>"
    assert got[1, "metadata"]["block"].startswith("title: T & U\r\n")
    for r in got.values():
        assert r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(r["block"].encode()).digest()).decode()
        assert r["content_length"] == len(r["block"].encode())
    assert len({r["refers_to"] for r in got.values()}) == 3 and len({r["record_id"] for r in got.values()}) == 6
    warc.write_warc(records, str(tmp_path / "out"))
    assert sum(r[0].startswith("WARC/1.1") for r in spark.read.text(str(tmp_path / "out")).collect()) == 6


def brute_groups(rows, k, percent):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(BLANK, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    group = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n) and group[a] < group[b]:
                    group[b], changed = group[a], True
    return {i: (len(s), group[i]) for i, s in sets.items()}


@pytest.mark.parametrize(("chunk", "percent", "dense"), [(400, 85, 512), (3, 70, 512), (400, 85, 2)])
def test_near_dedup(monkeypatch, docs, rows, empty, chunk, percent, dense):
    monkeypatch.setattr(near_dedup, "DENSE", dense)
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    want = brute_groups(rows, 3, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, 3, percent).collect()}
    assert got == want
    assert near_dedup.near_duplicates(empty, 3, percent).count() == 0


def test_mixing(docs, rows, empty):
    plan = mixing.mix_plan(docs).collect()
    sizes = Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len(re.findall(BLANK, t or ""))
    order = [*sorted(s for s in sizes if s), None]
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    left, open_sources, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_sources:
        over = {s for s in open_sources if left * weight[s] / sum(weight[x] for x in open_sources) >= 2 * sizes[s]}
        for s in over or open_sources:
            target[s] = 2 * sizes[s] if over else left * weight[s] / sum(weight[x] for x in open_sources)
        left -= sum(target[s] for s in over)
        open_sources = open_sources - over if over else set()
    taken = Counter()
    for r in plan:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    words = sum(len(re.findall(BLANK, r["text"] or "")) for r in mixing.mixed(docs).collect())
    assert words == sum(taken.values())
    assert mixing.mix_plan(empty).count() == 0


def test_decontamination(spark, docs, empty):
    r = random.Random(2)
    item = [f"bench{i}" for i in range(30)]
    long = [f"w{r.randrange(5000)}" for _ in range(20000)]
    part = item[:26]  # 22 of 26 shingles
    half = item[:15]
    texts = [(1, " ".join(long[:9000] + item + long[9000:])), (2, " ".join(part)), (3, " ".join(half)), (4, None), (5, " ".join(item).upper().replace(" ", ",  "))]
    items = spark.createDataFrame([(7, " ".join(item)), (8, "a b"), (9, None)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): (x["n_shingles"], x["n_shared"]) for x in decontaminate.contained_items(spark.createDataFrame(texts, "doc_id long, text string"), items).collect()}
    assert got == {(1, 7): (26, 26), (2, 7): (26, 22), (5, 7): (26, 26)}
    assert decontaminate.contained_items(empty, items).count() == 0 and decontaminate.contained_items(docs, items.limit(0)).count() == 0
