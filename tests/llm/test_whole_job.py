"""Cases of the first review: each failed before its operator did the whole job."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.llm import licenses, quality, substring_dedup

SMALL = ["0.001", "0.01", "0.1"]


@pytest.mark.parametrize("sf", SMALL)
def test_quality_keeps_trusted_documents_alike_with_their_labels_hidden(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text").repartition(8)
    labels = spark.read.parquet(f"/root/testdata/sf{sf}/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0

    held = {r["doc_id"] for r in labels.where("quality = 1").where(fold).collect()}

    def kept(shown):
        rows = quality.score_documents(docs, quality.fit_ratio(docs, shown)).select("row.doc_id", "base_failed", "kept").collect()
        return {r["doc_id"]: r["kept"] for r in rows if r["doc_id"] in held and not r["base_failed"]}

    shown, hidden = kept(labels), kept(labels.where(~fold))
    rate = lambda x: sum(x.values()) / len(x)
    assert len(hidden) > 5 and rate(hidden) >= 0.97 and abs(rate(shown) - rate(hidden)) <= 0.03


def test_quality_scores_without_a_documents_own_counts(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(6)] + [(None, " ".join(f"n{j}" for j in range(60)))], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    scored = {r["row"]["doc_id"]: r["score"] for r in quality.score_documents(docs, quality.fit_ratio(docs, labels)).collect()}
    # no bin is shared, so no document's n-grams tell anything about it
    assert len(scored) == 7 and all(abs(x) < 0.05 for x in scored.values()), scored


def test_quality_counts_every_trusted_document(spark):
    docs = spark.range(10_400).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert sum(quality.fit_ratio(docs, labels, bins=8).trusted) == 3 * 10_400


def test_substring_dedup_with_null_and_repeated_ids(spark):
    r = random.Random(3)
    make = lambda n: [f"v{r.randrange(3000)}" for _ in range(n)]
    passages, window = [make(40), make(60)], 9
    texts = [make(r.randrange(20)) + passages[i % 2] + make(r.randrange(20)) for i in range(8)] + [make(80) for _ in range(6)]
    texts += [texts[8] + texts[8][:30], texts[9], []]
    ids = [None if i % 4 == 0 else 3 if i % 4 == 1 else i for i in range(len(texts))]
    counts = Counter(tuple(w[j : j + window]) for w in texts for j in range(len(w) - window + 1))
    want = []
    for i, w in zip(ids, texts, strict=True):
        gone = {x for j in range(len(w) - window + 1) if counts[tuple(w[j : j + window])] > 1 for x in range(j, j + window)}
        want.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in zip(ids, texts, strict=True)], "doc_id long, text string").repartition(3)
    got = [(x["doc_id"], x["n_words"], x["n_removed"], x["kept_text"]) for x in substring_dedup.dedup_substrings(docs, window).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_licenses_in_short_forms():
    model = licenses.train(["nothing to see here at all", "some words of an ordinary text about the weather"] * 20)
    forms = {"All rights reserved.": "proprietary", "Copyright 2024 Someone. All rights reserved.": "proprietary"}
    forms |= {t: f for f, titles in licenses.TITLES.items() for t in titles} | {"The MIT License (MIT)": "MIT"}
    ids = {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "BSD-3-Clause": "BSD", "GPL-2.0-only": "GPL", "LGPL-2.1-or-later": "LGPL", "AGPL-3.0-only": "AGPL-3.0"}
    ids |= {"CC-BY-4.0": "CC-BY", "CC-BY-NC-4.0": "CC-BY-NC", "CC-BY-SA-4.0": "CC-BY-SA", "CC0-1.0": "CC0", "MPL-2.0": "MPL-2.0"}
    forms |= {f"// SPDX-License-Identifier: {x}": f for x, f in ids.items()}
    assert {x: (model.scan(x) or (None,))[0] for x in forms} == forms
    for plain in ("The rights of all were reserved for later.", "the license", "SPDX-License-Identifier:", "We met at MIT."):
        assert model.scan(plain) is None, plain


def test_licenses_wrapped_over_short_lines():
    model = licenses.train(["nothing to see here at all", "some words of an ordinary text about the weather"] * 20)
    notice = ["Licensed under the Apache License, Version 2.0 (the \"License\");", "you may not use this file", "", "except in compliance", "with the License."]
    found = model.scan_lines(["with the rain", *notice, "of the weather"])
    assert {i: x[0] for i, x in found.items()} == dict.fromkeys((1, 2, 4, 5), "Apache-2.0")
