"""Cases that an operator or a stage of the pipeline once left out."""

from collections import Counter

import corpus_pipeline
from datetime import date

import numpy as np

from tracewright.llm import decontaminate, quality_rules, toxicity, url_lists

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_lines_of_small_sources_go(spark):
    head = lambda i, n: "Head\n" if i < n else ""
    rows = [(i, f"{head(i, 5)}own line {i}", "en", "thirty", 0) for i in range(30)]  # fewer than ten texts hold it
    rows += [(100 + i, f"{head(i, 6)}other line {i}", "en", "six", 0) for i in range(6)]
    rows += [(200 + i, f"{head(i, 8)}third line {i}", "en", "hundred", 0) for i in range(100)]  # 8 %
    rows += [(400 + i, f"{head(i, 5)}fourth line {i}", "en", "rare", 0) for i in range(100)]  # 5 %, as natural lines are
    got = corpus_pipeline.lines(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert Counter(r["source"] for r in got if r["text"].startswith("Head")) == {"rare": 5}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)


def words_of(seed, n):
    return " ".join(f"t{seed}q{i}" for i in range(n))


def test_a_repeated_id_loses_no_group(spark):
    a, b, c = words_of(1, 60), words_of(2, 60), words_of(3, 60)
    rows = [(5, a, "en", "s", 0), (5, b, "en", "s", 0), (3, b, "en", "s", 0), (7, a, "en", "s", 0)]
    rows += [(8, c, "en", "s", 0), (8, words_of(4, 60), "en", "s", 0), (8, c, "en", "s", 0), (None, c, "en", "s", 0)]
    rows += [(None, words_of(5, 60), "en", "s", 0)] * 3 + [(None, words_of(6, 60), "en", "s", 0)]
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect())
    assert got == Counter([(5, a), (3, b), (8, c), (8, words_of(4, 60)), (None, words_of(5, 60)), (None, words_of(6, 60))])


def test_rules_judge_rows(spark):
    good, bad = words_of(1, 60), "few words"
    rows = [(None, good, "en", "s", 0), (None, bad, "en", "s", 0), (1, good, "en", "s", 0), (1, bad, "en", "s", 0), (2, None, "en", "s", 0), (3, good, None, "s", 0)]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = Counter((r["doc_id"], r["text"]) for r in quality_rules.keep_good(spark.createDataFrame(rows, DOCS), labels).collect())
    assert got == Counter([(None, good), (1, good), (3, good)])


def test_leaks_go_by_row(spark):
    item = "the old farmer walks over the long bridge to a small market and buys seven red apples"
    rows = [(None, f"x {item} y", "en", "s", 0), (None, "clean text", "en", "s", 0), (1, item, "en", "s", 0), (1, "other clean text", "en", "s", 0), (2, None, "en", "s", 0)]
    benchmark = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in decontaminate.without_leaks(spark.createDataFrame(rows, DOCS), benchmark).collect())
    assert got == Counter([(None, "clean text"), (1, "other clean text"), (2, None)])


def leaked(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    return sorted((r["doc_id"], r["item_id"]) for r in found)


def test_short_items_are_found_after_any_word(spark):
    items = [
        "Which planet is closest to the sun in our system?", "Name the tallest tree of them all", "In which sea do all rivers of this land end?",
        "Anna Lind walks home from the old market with bread", "Anna Lind has a dog and Anna Lind has no cat",
    ]
    heads = ["Q1) ", "A heading line\n", "Then they asked ", "He said (see Exercise 12) ", "Ask Bo ", "They met in Rome “done.” "]
    texts = [head + item + " and so on" for head in heads for item in items] + ["Then they asked Which planet is farthest from the sun in our system?"]
    assert leaked(spark, texts, items) == [(i, i % len(items)) for i in range(len(heads) * len(items))]


def test_items_of_few_literals_match_by_value(spark):
    items = ["What is 17 + 25?", "3 5 8 13 21 34 55 89 144 233", "Ana Bea Cleo 5 kg 7 kg 9 kg", "two words", "12 cm", "What are 4 and 8 and 9 and 3 and 5"]
    texts = ["So: What is 17 + 25? Tell me", "x 3 5 8 13 21 34 55 89 144 233 y", "We saw. Ana Bea Cleo 5 kg 7 kg 9 kg", "What is 18 + 25?", "x 3 5 8 13 21 34 55 89 144 234 y",
             "two words", "12 cm", "Ask What is 17 + 25 now"]
    assert leaked(spark, texts, items) == [(0, 0), (1, 1), (2, 2), (7, 0)]
    left = decontaminate.items_left_out(spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert sorted((r["item_id"], r["n_tokens"]) for r in left) == [(3, 2), (4, 1)]


def test_thresholds_use_all_labels_left(spark):
    rows = [(i, False, "en" if i % 2 else "de", 0.9 - 0.4 * (i % 2) if i % 4 < 2 else 0.1) for i in range(4000)]
    rows += [(5000, False, "fr", 0.3), (5001, False, "fr", 0.1)] + [(6000 + i, True, "en", 0.95) for i in range(50)]
    scored = spark.createDataFrame(rows, "doc_id long, held_out boolean, lang string, score double")
    labels = spark.createDataFrame([(r[0], int(r[3] > 0.2 and not r[1])) for r in rows], "doc_id long, toxic int")
    cuts = toxicity.thresholds(scored, labels, [0, 1, 2])
    assert set(cuts) == {"", "de", "en"} and 0.1 < cuts["en"] <= 0.5 < cuts["de"] + 0.3  # too few texts in fr
    counts = np.zeros((2, 2 * toxicity.BIN_EDGE + 1), int)
    counts[0, 100], counts[1, 200] = 5, 5
    assert abs(toxicity.calibrate(counts) - 1 / (1 + np.exp((480 - 150.5) / 16))) < 1e-12


def test_lists_name_deep_hosts_and_paths(spark):
    host = ".".join("abcdefghijkl") + ".org"
    urls = [f"http://{host}/one/two//three.html?q=/x", f"https://{host}/", "http://b.org/one/", "http://b.org/onetwo"]
    keys = [".".join("bcdefghijkl") + ".org", f"{host}/one/two", "k.l.org/one", "l.org/one/two//three.html", "b.org/one", "b.org/on"]
    entries = spark.createDataFrame([("L", "block", k, "add", date(2024, 1, 1)) for k in keys], "list string, kind string, key string, action string, day date")
    asked = spark.createDataFrame([(i, u, date(2024, 2, 1)) for i, u in enumerate(urls)], "id long, url string, fetched_on date")
    got = {r["id"]: (r["n_entries"], r["matched_key"]) for r in url_lists.evaluate(asked, entries).collect()}
    assert got == {0: (4, keys[1]), 1: (1, keys[0]), 2: (1, "b.org/one"), 3: (0, None)}
