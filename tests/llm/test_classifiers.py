"""The classifiers by held-out accuracy, and their bounds."""

import os
import random

import numpy as np
import pytest

from tracewright.llm import quality_classifier, toxicity
from tracewright.llm.common import is_held_out

DATA = "/root/testdata/sf0.01"


def planted(rng, n, bad):
    words = [f"{a}{b}n" for a in "bcdfglm" for b in "aeiou"]
    out = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if i % 3 == 0:
            text = bad(rng, text)
        out.append((i, " ".join(text), rng.choice(["en", "de", None]), int(i % 3 == 0)))
    return out + [(n, None, "en", 0), (n + 1, "", None, 0), (n + 2, "x", "xx", 0), (None, "x", "xx", 0), (0, out[0][1], "en", 1)]


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable")) + 1
    return (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def check(got, rows, at, flip):
    assert len(got) == len(rows)
    truth = {i: y for i, _, _, y in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == is_held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= at) for r in got)
    y = np.array([truth[r["doc_id"]] for r in held])
    assert auc(np.array([r["score"] for r in held]) * (-1 if flip else 1), y) > 0.97


def test_quality(spark):
    rows = planted(random.Random(1), 600, lambda rng, t: [w.upper() + "!!" for w in t])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(i, 1 - y) for i, _, _, y in rows if i is not None and i != 5] + [(5, None), (None, 1)], "doc_id long, quality int")
    check(quality_classifier.classify(docs, labels).collect(), rows, 0.5, True)
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity(spark):
    rows = planted(random.Random(2), 600, lambda rng, t: t[: len(t) // 2] + ["vile" + rng.choice(["an", "er", "ul"])] + t[len(t) // 2 :])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows if i is not None and i != 5] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.classify(docs, labels).collect()
    check(got, rows, 0.7, False)
    assert all(r["flagged"] == (r["score"] >= r["threshold"]) for r in got)
    assert toxicity.classify(docs.limit(0), labels).count() == 0 and toxicity.classify(docs, labels.limit(0)).count() == len(rows)


def test_learning_skips_held_out_rows(spark):
    rows = planted(random.Random(3), 200, lambda rng, t: [w.upper() for w in t])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    labels = [(i, 1 - y) for i, _, _, y in rows if i is not None]
    turned = [(i, 1 - q if is_held_out(i) else q) for i, q in labels]
    one, two = (quality_classifier.fit(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, turned))
    assert (one == two).all() and one.any()


def test_long_text_pools_like_a_short_one():
    net, rng = toxicity.Net(1), np.random.default_rng(1)
    rows = rng.integers(0, toxicity.BUCKETS, (150_000, 3)).astype(np.int32)
    x = net.embedding[rows].sum(1)
    whole = np.concatenate([np.maximum(net.responses(x, i).max(0), 0) for i in range(3)])
    assert np.allclose(net.pooled(rows), whole, atol=1e-5)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_held_out_rows_of_the_tables(spark, name):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = (quality_classifier if name == "quality" else toxicity).classify(docs, labels)
    rows = got.filter("held_out").join(labels.select("doc_id", name), "doc_id").collect()
    assert auc(np.array([r["score"] for r in rows]), np.array([r[name] for r in rows])) > 0.9
