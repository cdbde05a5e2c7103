"""Keyword screening and leakage scans of text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literals import required_literals
from ..lookups import EXCLUDE_TERMS, FORBIDDEN_PATTERNS, REVIEW_TERMS
from .scale import compute_once


def _term(text: Column, pattern: str) -> Column:
    """The pattern where it occurs, else null. It is tried only on texts that hold a literal it needs."""
    found = F.when(text.rlike(pattern), F.lit(pattern))
    literals = required_literals(pattern)
    return found if literals is None else F.when(reduce(Column.__or__, [text.contains(x) for x in literals]), found)


def matched_terms(text: Column, patterns: Sequence[str]) -> Column:
    """Sorted array of the patterns that occur; null for a null text.

    Finding a literal costs a fraction of a pattern, and the literals come from the syntax tree of each pattern, so that a text without
    them can't match. Patterns are literal arguments, so each is compiled once per task.
    """
    found = F.array_sort(F.array_compact(F.array(*[_term(text, p) for p in patterns])))
    return F.when(text.isNotNull(), found)


def keyword_screen(pool: DataFrame, exclude: Sequence[str] = EXCLUDE_TERMS, review: Sequence[str] = REVIEW_TERMS) -> DataFrame:
    """Screen status per text: exclude, review or candidate, with the matched terms. ``pool``: item_id, text."""
    low = F.col("_low")
    rows = compute_once(pool, "_low", F.lower("text")).select(
        "item_id", matched_terms(low, exclude).alias("exclude_terms"), matched_terms(low, review).alias("review_terms"),
        F.length("text").alias("text_chars"),
    )
    screen = F.when(F.size("exclude_terms") > 0, "exclude").when(F.size("review_terms") > 0, "review").otherwise("candidate")
    return rows.withColumn("screen", screen)


def screen_totals(screened: DataFrame) -> DataFrame:
    return screened.groupBy("screen").agg(F.count(F.lit(1)).alias("n_items"))


def leakage_scan(visible: DataFrame, patterns: Sequence[str] = FORBIDDEN_PATTERNS) -> DataFrame:
    """(key, pattern) for every forbidden pattern in a visible text. ``visible``: key, text."""
    return visible.select("key", F.explode(matched_terms(F.col("text"), patterns)).alias("pattern"))


def changed_slices(visible: DataFrame, expected: DataFrame) -> DataFrame:
    """Units whose visible log differs from the designated slice. Both: unit_id, sha256."""
    rows = expected.join(visible.withColumnRenamed("sha256", "_seen"), "unit_id", "left")
    return rows.filter(~F.col("sha256").eqNullSafe(F.col("_seen"))).select("unit_id")


def data_assets(pool: DataFrame, paths: DataFrame) -> DataFrame:
    """Data files of each pool item, in long form: (item_id, asset).

    The prefix condition is an equality on the first path segment. ``paths``: path.
    """
    split = paths.filter(F.contains("path", F.lit("/environment/data/"))).select(
        F.substring_index("path", "/", 1).alias("item_id"), F.regexp_replace("path", r"^[^/]*/", "").alias("asset")
    )
    return split.join(pool.select("item_id"), "item_id", "left_semi")
