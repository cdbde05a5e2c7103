"""Quality rules whose cutoffs are certified on labelled rows to reject few good documents."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_rows

WINDOW_WORDS = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
# A rule rejects texts above its cutoff. The grid is fixed beforehand and tried from lenient to strict.
CUTOFFS = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.015, 0.01, 0.005)
RULES = {
    "symbols": "n_symbols / nullif(word_chars, 0)",
    "duplicate_lines": "n_dup_lines / nullif(n_lines, 0)",
    "repeated_words": "n_repeat_words / nullif(n_words, 0)",
    "same_words": "n_same_words / nullif(n_words, 0)",
    "capitals": "n_capitals / nullif(word_chars, 0)",
    "exclamations": "n_exclamations / nullif(word_chars, 0)",
}
# Of the good documents of a stratum no more than this share is rejected by the rules together ...
MAX_FALSE_REJECTION = 0.03
# ... but for this probability over all strata and rules.
FAILURE = 0.05
# Strata are the values of a closed column; more of them are taken for a mistake.
MAX_STRATA = 2_000
MEASURES = (
    "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " n_lines long, n_same_words long, n_capitals long, n_exclamations long, row_key long"
)


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of a text, in the order of MEASURES; zeros for null and empty texts."""
    if not text:
        return (0,) * 9
    raw = text.encode()
    words = raw.split()
    n = len(words)
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    word_chars = int(bytes_.sum() - bytes_[128:192].sum() - bytes_[list(SPACES)].sum())  # continuation bytes start no character
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeated = 0
    if n >= WINDOW_WORDS:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        windows = [joined[a:b] for a, b in zip(starts[: n - 4].tolist(), ends[4:].tolist(), strict=True)]
        if len(found := Counter(windows)) < len(windows):
            at = np.flatnonzero([found[w] > 1 for w in windows])
            step = np.zeros(n + 1, np.int64)
            np.add.at(step, at, 1)
            np.add.at(step, at + WINDOW_WORDS, -1)
            repeated = int((np.cumsum(step) > 0).sum())
    same = sum(map(bytes.__eq__, words, words[1:]))
    capitals, exclamations = int(bytes_[65:91].sum()), int(bytes_[33])
    symbols = int(bytes_[list(SYMBOLS)].sum())
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), same, capitals, exclamations


def measures(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """The counts of every whole text, with its stratum ('' for null) and its row_key."""
    columns = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col(stratum).cast("string"), F.lit("")), F.col("text").cast("string"), row_key(stratum)
    )
    return map_rows(columns, MEASURES, lambda doc_id, stratum, text, key: [(doc_id, stratum, *measure(text), key)])


def row_key(stratum: str) -> F.Column:
    """Hash of what a verdict depends on, so that rows of one doc_id, or of none, are told apart."""
    return F.xxhash64(F.coalesce(F.col(stratum).cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def tail(n: int, k: int, p: float) -> float:
    """Exact probability of k or fewer of n, each with probability p."""
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)
    ]
    top = max(logs)
    return math.exp(top) * sum(math.exp(x - top) for x in logs) if n else 1.0


def strictest_cutoff(n_good: int, above: list[int], risk: float, failure: float) -> float | None:
    """The strictest cutoff whose false rejections are certified below ``risk``, or None.

    ``above``: good documents above each cutoff of the grid. Cutoffs are tested in their fixed order until one fails,
    so that a whole sequence fails wrongly with probability ``failure`` at most.
    """
    best = None
    for cutoff, k in zip(CUTOFFS, above, strict=True):
        if k > risk * n_good or tail(n_good, k, risk) > failure:
            break
        best = cutoff
    return best


def certify(measured: DataFrame, labels: DataFrame, risk: float = MAX_FALSE_REJECTION, failure: float = FAILURE) -> DataFrame:
    """(stratum, a cutoff per rule): null where the labels are too few to certify any.

    The labelled rows are a holdout for cutoffs that were learnt from nothing. Risk is shared by the rules, failure by
    all rules of all strata (Bonferroni). Only counts per stratum, rule and grid step reach the driver. Rows without a
    quality label are left out; a doc_id labelled twice counts as good if any label says so.
    """
    good = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max("quality").alias("quality")
    )
    steps = lambda rate: sum((F.coalesce(F.expr(rate), F.lit(0.0)) > c).cast("int") for c in CUTOFFS)
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), steps(rate).alias("passed")) for name, rate in RULES.items()])
    held = measured.filter(~base_failed()).join(good.filter("quality = 1"), F.col("doc_id") == F.col("_id"))
    counts = held.select("stratum", F.explode(rows).alias("r")).groupBy("stratum", "r.rule", "r.passed").count()
    strata = measured.select("stratum").distinct().limit(MAX_STRATA + 1).collect()
    if len(strata) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata")
    found: dict[tuple[str, str], np.ndarray] = {}
    for row in counts.collect():
        per_step = found.setdefault((row["stratum"], row["rule"]), np.zeros(len(CUTOFFS) + 1, np.int64))
        per_step[row["passed"]] += row["count"]
    tests, out = max(1, len(strata) * len(RULES)), []
    for (stratum,) in strata:
        cutoffs = []
        for rule in RULES:
            per_step = found.get((stratum, rule), np.zeros(len(CUTOFFS) + 1, np.int64))
            above = per_step[::-1].cumsum()[::-1][1:].tolist()
            cutoffs.append(strictest_cutoff(int(per_step.sum()), above, risk / len(RULES), failure / tests))
        out.append((stratum, *cutoffs))
    schema = ", ".join(["stratum string", *[f"max_{rule} double" for rule in RULES]])
    return measured.sparkSession.createDataFrame(out, schema)


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """``judge`` with the row_key and the failed rules as an array."""
    measured = cut_lineage(measures(docs, stratum))
    cutoffs = certify(measured, labels)
    fails = F.array_compact(F.array(*[F.when(F.expr(rate) > F.col(f"max_{rule}"), rule) for rule, rate in RULES.items()]))
    marked = measured.join(F.broadcast(cutoffs), "stratum")  # a row per stratum, bounded by MAX_STRATA
    found = marked.withColumn("failed_rules", fails).withColumn("base_failed", base_failed())
    return found.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``kept`` and the rules it fails (``failed_rules``).

    Null and empty texts have no words and fail the base. A null stratum is a stratum of its own. Repeated rows are
    judged alike. An empty table gives no row.
    """
    return judged(docs, labels, stratum).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, each by its own verdict, whether it has a doc_id or shares one."""
    kept = judged(docs, labels, stratum).filter("kept").select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct()
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (row_key(stratum) == F.col("_key")), "left_semi")
