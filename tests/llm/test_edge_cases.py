"""Null, repeated and tied rows, empty and very long texts, clashing columns, and whole small tables against brute force."""

import base64
import gzip
import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import decontaminate, licenses, line_dedup, mixing, near_dedup, sharding, substring_dedup, suffix_array, warc

WORDS = r"[^\x20\x09-\x0D]+"
#: Columns besides doc_id and text have names that the operators use inside.
SCHEMA = "doc_id long, text string, source string, row string, chunk int, size int, label string, bucket long, key string"


def odd_rows():
    r = random.Random(21)
    words = [f"t{i}" for i in range(200)]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = some(80)
    texts = [None, None, "", " ", "x", "x", some(20_000), "long" * 30_000, shared, shared, f"{some(30)}\n{shared}\n{some(10)}", "same line\n" * 30]
    texts += [f"same line\n{some(12)}" for _ in range(12)]
    ids = [1, None, 2, 3, 4, 4, 5, None, 6, 6, None, 7] + [7, None, *range(8, 18)]
    return [(i, t, [None, "s"][n % 2], "r", 1, 2, "l", 3, "k") for n, (i, t) in enumerate(zip(ids, texts, strict=True))]


@pytest.fixture(scope="module")
def odd():
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, odd):
    return spark.createDataFrame(odd, SCHEMA).repartition(3)


def test_lines(docs, odd):
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r") for x in (t or "").split("\n")]
    counts = Counter(k for _, t, *_ in odd for k in set(keys(t)) if k)
    want = []
    for i, t, *_ in odd:
        kept = [x for x, k in zip((t or "").split("\n"), keys(t), strict=True) if counts[k] < 10]
        want.append((i, len(keys(t)), len(keys(t)) - len(kept), "\n".join(kept)))
    for batches in (1, 4):
        got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup_lines(docs, batches=batches).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_runs_are_disjoint_and_keep_all_counts(spark):
    r = random.Random(6)
    runs, counts = line_dedup.LineRuns(threshold=4), Counter()
    for _ in range(6):
        batch = [r.randrange(40) for _ in range(30)]
        counts.update(batch)
        runs.add(spark.createDataFrame([(str(x),) for x in batch], "key string"))
    held = [row["key"] for run in [*runs._open(), *runs.settled] for row in run.collect()]
    assert len(held) == len(set(held)) == len(counts)
    assert {row["key"] for row in runs.frequent().collect()} == {str(k) for k, n in counts.items() if n >= 4}


def test_shards(docs, odd):
    got = sharding.shard_documents(docs, 4).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len((t or "").encode()) + 16) for i, t, *_ in odd)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    shard_of = {}
    assert all(shard_of.setdefault(r["text_crc32"], r["shard"]) == r["shard"] for r in got)


def test_shards_of_a_whole_table_are_even(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums, groups = Counter(), Counter()
    for r in sharding.shard_documents(docs).collect():
        sums[r["shard"]] += r["size"]
        groups[r["text_crc32"], r["size"]] += r["size"]
    assert set(sums) == set(range(40)) and max(sums.values()) - min(sums.values()) <= max(0.01 * sum(sums.values()) / 40, max(groups.values()))


def test_repeated_rows_of_a_benchmark(spark):
    item = " ".join(f"b{i}" for i in range(20))
    docs = spark.createDataFrame([(None, item), (1, item), (1, item), (2, None), (3, "")], "doc_id long, text string")
    items = spark.createDataFrame([(5, item), (5, item), (6, "")], "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(docs, items).collect())
    assert got == {(None, 5): 2, (1, 5): 4}
    assert decontaminate.without_items(docs, items).count() == 2 and decontaminate.without_items(docs, items.limit(0)).count() == 5


def test_repeated_rows_of_licences(spark):
    model = licenses.train(["plain words of no kind"] * 5)
    rows = [(None, "Released under the MIT License."), (1, "x\nReleased under the MIT License."), (1, "x\nReleased under the MIT License."), (2, None), (3, "y" * 200_000)]
    got = sorted(((r["doc_id"], r["paragraph_no"], r["family"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()), key=repr)
    assert got == [(1, 1, "MIT"), (1, 1, "MIT"), (None, 0, "MIT")]
    same = [licenses.fit_on(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), 3).weights for n in (1, 3)]
    assert np.array_equal(*same)


def test_warc_files_are_read_back(spark, tmp_path):
    html = "<html lang='en'><title>A &amp; B</title><body><p>one</p><p>two\r\n\r\nthree</p></body></html>"
    pages = spark.createDataFrame([(1, "http://a/", html, "x"), (1, "http://a/", html, "x"), (2, None, None, "y"), (None, "u", "<p>" + "w " * 50_000, "z")], "page_id long, url string, html string, block string")
    records = warc.derivatives(warc.responses(pages))
    warc.write_warc(records, str(tmp_path / "out"))
    found = []
    for file in Path(tmp_path / "out").glob("*.gz"):
        data = gzip.decompress(file.read_bytes())
        while data:
            head, data = data.split(b"\r\n\r\n", 1)
            lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            block, data = data[: int(fields["Content-Length"])], data[int(fields["Content-Length"]) :]
            assert lines[0] == "WARC/1.1" and data.startswith(b"\r\n\r\n")
            data = data[4:]
            assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
            found.append((fields["WARC-Type"], fields["WARC-Record-ID"], fields["WARC-Refers-To"], fields["X-Source-Payload-Digest"], block.decode()))
    want = [(r["record_type"], r["record_id"], r["refers_to"], r["source_digest"], r["block"]) for r in records.collect()]
    assert Counter(found) == Counter(want) and len(found) == 8
    source = {r["record_id"]: r["payload"] for r in warc.responses(pages).collect()}
    for _, _, refers, digest, _ in found:
        assert digest == "sha1:" + base64.b32encode(hashlib.sha1(source[refers].encode()).digest()).decode()


def test_mix_of_odd_rows(docs, odd):
    plan = mixing.mix_plan(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in plan) == Counter((i, len(re.findall(WORDS, t or ""))) for i, t, *_ in odd)
    mixed = mixing.mixed(docs).collect()
    assert sum(len(re.findall(WORDS, r["text"] or "")) for r in mixed) == sum(r["taken"] for r in plan)
    assert mixing.mixed(docs).columns == docs.columns


def test_near_dedup_keeps_other_columns(docs, odd):
    rows = near_dedup.deduplicated(docs, 3, 85)
    assert rows.columns == docs.columns
    sets = [{tuple(w[j : j + 3]) for j in range(len(w) - 2)} or ({tuple(w)} if w else None) for _, t, *_ in odd for w in [re.findall(WORDS, (t or "").lower())]]
    blank = sum(s is None for s in sets)
    distinct = len({frozenset(s) for s in sets if s})
    assert blank + 1 <= rows.count() <= blank + distinct


def test_near_pairs_of_a_table_are_found(spark):
    """Recall against all pairs of the documents whose id is divisible by 20."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = re.findall(WORDS, r["text"].translate({c: c + 32 for c in range(65, 91)}))
        sets[r["doc_id"]] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} or {tuple(w)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, 3, 85).collect()}
    assert all(got[i][0] == len(s) for i, s in sets.items())
    pairs = missed = 0
    for a in [i for i in sets if i % 20 == 0]:
        for b, s in sets.items():
            n = len(sets[a] & s)
            if a != b and 100 * n >= 85 * (len(sets[a]) + len(s) - n):
                pairs += 1
                missed += got[a][1] != got[b][1]
    assert pairs > 5 and not missed


def test_repeated_bytes_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], (r["text"] or "").encode()) for r in docs.collect())
    seen, want = {}, {}
    for i, b in rows:
        gone = np.zeros(len(b), dtype=bool)
        for j in range(len(b) - 49):
            if seen.setdefault(b[j : j + 50], i) < i:
                gone[j : j + 50] = True
        want[i] = (len(b), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffix_array.dedup_repeats(docs.repartition(5), with_bytes=False).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 1000


def test_repeated_windows_of_a_table(spark, docs, odd):
    for rows, table in ((odd, docs), ([(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()], None)):
        table = table if table is not None else spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
        counts = Counter(tuple(w[j : j + 35]) for _, t, *_ in rows for w in [re.findall(WORDS, t or "")] for j in range(len(w) - 34))
        want = []
        for i, t, *_ in rows:
            w = re.findall(WORDS, t or "")
            gone = {x for j in range(len(w) - 34) if counts[tuple(w[j : j + 35])] > 1 for x in range(j, j + 35)}
            want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
        got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup_substrings(table, with_text=False).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_contained_items_equal_brute_force(spark):
    r = random.Random(31)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "naïve", "42"]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(r.choice([1, 2, 3, 4, 5, 6, 9, 20, 40])))) for i in range(40)] + [(40, None), (41, ""), (42, "..."), (3, "w1 w2"), (3, "w1 w2")]
    texts = [(d, " ".join(some(r.randrange(0, 12)) + [x for x in (r.choice(items)[1] or "").upper().split() if r.random() < 0.97] + some(r.randrange(0, 12)))) for d in range(150)] + [(None, "w1, w2!"), (7, None), (8, "")]

    def words(text):
        return re.findall(r"\w+", (text or "").lower())

    def runs(w, n):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = []
    for d, text in texts:
        for i, item in items:
            n = min(5, len(words(item)))
            if n and (shared := len(runs(words(item), n) & runs(words(text), n))) >= 0.8 * (size := len(runs(words(item), n))) - 1e-9:
                want.append((d, i, size, shared))
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    given = spark.createDataFrame(items, "item_id long, text string")
    got = [(x["doc_id"], x["item_id"], x["n_shingles"], x["n_shared"]) for x in decontaminate.contained_items(frame, given).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(size == 1 for *_, size, _ in want)
    long_hits = {d for d, i, size, _ in want if len(words(dict(items)[i])) >= 5}
    assert {x["doc_id"] for x in decontaminate.without_items(frame, given).collect()} >= {d for d, _ in texts} - long_hits - {7, 8}


def test_named_characters(spark):
    from html.entities import html5

    names = [n[:-1] for n in html5 if n.endswith(";")]
    texts = [f"a&{n};b" for n in names] + ["&nosuch;", "&amp;lt;", "&eacute", "&frac12;&there4;", "x & y"]
    got = [r["x"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(warc.decode_entities(F.col("t")).alias("x")).collect()]
    want = [f"a{warc.ENTITIES.get(n, html5[n + ';'])}b" for n in names] + ["&nosuch;", "&lt;", "&eacute", "½∴", "x & y"]
    assert got == want


def test_a_long_unclosed_comment_and_script(spark):
    pages = [(1, "http://x", f"<p>a</p><!-- {'b ' * 200_000}"), (2, "http://y", f"<p>a</p><script>{'c ' * 200_000}"), (3, None, "<p>" * 50_000 + "z")]
    texts = {r["page_id"]: r["block"] for r in warc.derivatives(warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string"))).where("record_type = 'conversion'").collect()}
    assert texts[1].startswith("a") and texts[2].startswith("a\nc c") and texts[3] == "z"
