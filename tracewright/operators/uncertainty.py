"""Repeated attempts, scenario-level metrics, advantages and bootstrap intervals."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..session import cut_lineage, send_package

# Cumulative Poisson(1) probabilities; beyond 16 events the remaining mass is below 1e-14.
POISSON_STEPS = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(16)]


def poisson_weight(u: Column) -> Column:
    """Poisson(1) count by inversion of a uniform."""
    out = F.lit(0)
    for step in POISSON_STEPS:
        out = out + F.when(u >= step, 1).otherwise(0)
    return out


def paired_bootstrap(groups: DataFrame, n_draws: int = 10_000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Interval of the mean difference between two arms, resampling groups: one row.

    ``groups``: grp, value_a, value_b (null where the arm has no denominator). Both arms share the
    draws. A group enters draw ``b`` with a Poisson(1) weight from the hash of (seed, b, group): no
    draw needs to pick groups by position. Groups are spread once, and a task sums each draw over its own
    groups, so ``n_draws`` rows leave a task whatever the number of groups. Draws in which an arm has no
    group are counted, not dropped silently.
    """
    spread = groups.repartition(groups.sparkSession.sparkContext.defaultParallelism, "grp")
    rows = spread.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    rows = rows.withColumn("w", poisson_weight(uniform(F.lit(seed), F.col("draw"), F.col("grp"))))
    has = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.col("w")).otherwise(0))
    total = lambda c: F.sum(F.col(c) * F.col("w"))
    draws = rows.groupBy("draw").agg(
        F.try_divide(total("value_a"), has("value_a")).alias("mean_a"),
        F.try_divide(total("value_b"), has("value_b")).alias("mean_b"),
    ).withColumn("diff", F.col("mean_b") - F.col("mean_a"))
    return _interval(groups, draws, level)


# Odd multipliers of 31 bits that mix the 31-bit keys of a group and a draw within 64 bits; a weight is read from 24 of them.
SPREAD = (0x5851F42D, 0x4C957F2D)
WEIGHT_STEPS = [math.ceil(step * 2**24) for step in POISSON_STEPS]
# Draws whose weights are held at once for a batch of groups.
DRAWS_AT_ONCE = 500


def draw_keys(n_draws: int, seed: int) -> np.ndarray:
    """31-bit key of each draw, from its md5."""
    return np.array([int(hashlib.md5(f"{seed}|draw|{b}".encode()).hexdigest()[:8], 16) >> 1 for b in range(n_draws)], np.uint64)


def poisson_weights(groups: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Poisson(1) weight of each group (row) in each draw (column), a function of their keys alone."""
    x = (groups[:, None] ^ draws) * np.uint64(SPREAD[0])
    x = ((x >> np.uint64(31)) ^ (x & np.uint64(0x7FFFFFFF))) * np.uint64(SPREAD[1])
    x = (x >> np.uint64(31)) & np.uint64(0xFFFFFF)
    return np.searchsorted(np.array(WEIGHT_STEPS, np.uint64), x.ravel(), side="right").reshape(x.shape)


def grouped_bootstrap(groups: DataFrame, n_draws: int = 10_000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """``paired_bootstrap`` for any number of groups: the same row, from vectors of draw sums instead of a row per group and draw.

    ``groups``: grp, value_a, value_b. A task weighs its groups in Arrow batches, some draws at a time, and sends one row of sums per
    draw; those rows are added in two steps, so no task meets more than the square root of their number. A weight depends on
    (seed, draw, group) only, so a task that is run again gives the same sums. A null group is a group like others.
    """
    send_package(groups.sparkSession)
    keys = draw_keys(n_draws, seed)
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("grp").cast("string")))
    rows = groups.select(
        F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), 1).alias("key"), F.col("value_a").cast("double"), F.col("value_b").cast("double")
    )
    names = ["sum_a", "n_a", "sum_b", "n_b"]
    schema = ", ".join(f"{n} array<double>" for n in names)

    def row(sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([s], pa.list_(pa.float64())) for s in sums], names)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, n_draws))
        for batch in batches:
            group = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            parts = []
            for column in batch.columns[1:]:
                value = column.to_numpy(zero_copy_only=False)
                known = ~np.isnan(value)
                parts += [np.where(known, value, 0.0), known.astype(float)]
            for at in range(0, n_draws, DRAWS_AT_ONCE):
                some = slice(at, at + DRAWS_AT_ONCE)
                sums[:, some] += np.array(parts) @ poisson_weights(group, keys[some])
        yield row(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, n_draws))
        for batch in batches:
            for k, column in enumerate(batch.columns):
                sums[k] += column.flatten().to_numpy().reshape(-1, n_draws).sum(axis=0)
        yield row(sums)

    spread = rows.repartition(groups.sparkSession.sparkContext.defaultParallelism)  # groups are few bytes, their weights are the work
    partial = spread.mapInArrow(weigh, schema)
    steps = max(1, math.isqrt(partial.rdd.getNumPartitions()))
    total = partial.repartition(steps).mapInArrow(add, schema).repartition(1).mapInArrow(add, schema)
    total = cut_lineage(total)
    sums = total.select(F.explode(F.arrays_zip(*names)).alias("d")).select("d.*")
    mean = lambda side: F.when(F.col(f"n_{side}") > 0, F.col(f"sum_{side}") / F.col(f"n_{side}"))
    return _interval(groups, sums.select((mean("b") - mean("a")).alias("diff")), level)


def _interval(groups: DataFrame, draws: DataFrame, level: float) -> DataFrame:
    """The observed difference, and the interval of ``draws`` (diff, null where an arm had no group)."""
    tail = (1 - level) / 2
    observed = groups.agg((F.avg("value_b") - F.avg("value_a")).alias("observed"), F.count(F.lit(1)).alias("n_groups"))
    summary = draws.agg(
        F.percentile("diff", F.lit(tail)).alias("low"), F.percentile("diff", F.lit(1 - tail)).alias("high"),
        F.count_if(F.col("diff").isNull()).alias("n_missing"), F.count(F.lit(1)).alias("n_draws"),
    )
    return observed.join(summary, F.lit(True)).withColumn("missing_share", F.col("n_missing") / F.col("n_draws"))


def pass_at_k(attempts: DataFrame) -> DataFrame:
    """Per unit: attempts, successes, pass@1 (share) and pass@k (any). ``attempts``: unit_id, strict."""
    won = F.col("strict") == 1.0
    return attempts.groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("n_attempts"), F.count_if(won).alias("n_successes"),
        F.avg(won.cast("double")).alias("pass_at_1"), F.max(won.cast("int")).alias("pass_at_k"),
    )


def solve_distribution(per_unit: DataFrame) -> DataFrame:
    """Units by attempts and successes."""
    return per_unit.groupBy("n_attempts", "n_successes").agg(F.count(F.lit(1)).alias("n_units"))


def scenario_attempts(rows: DataFrame) -> DataFrame:
    """Windows of one (scenario, view) combined per attempt index, never across attempts.

    ``rows``: scenario, representation, attempt_id, positive, tp, alert, valid.
    """
    return rows.groupBy("scenario", "representation", "attempt_id").agg(
        F.bool_or("positive").alias("positive"), F.bool_or(F.col("tp") > 0).alias("detected"),
        F.bool_or("alert").alias("alerted"), F.bool_and("valid").alias("all_valid"), F.sum("tp").alias("tp"),
        F.count(F.lit(1)).alias("n_windows"),
    )


def advantages(attempts: DataFrame) -> DataFrame:
    """Reward minus the mean of its prompt group. ``attempts``: prompt_group, attempt_id, reward.

    The mean is grouped and joined back rather than windowed, so no group has to fit one task.
    """
    means = attempts.groupBy("prompt_group").agg(F.avg("reward").alias("group_mean"))
    return attempts.join(means, "prompt_group").withColumn("advantage", F.col("reward") - F.col("group_mean"))


def reward_variation(attempts: DataFrame, threshold: float = 0.10) -> DataFrame:
    """One row: prompt groups, those without reward variation, and whether too few vary."""
    flat = attempts.groupBy("prompt_group").agg((F.min("reward") == F.max("reward")).alias("flat"))
    out = flat.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if("flat").alias("n_flat"))
    share = F.try_divide(F.col("n_groups") - F.col("n_flat"), F.col("n_groups"))
    return out.withColumn("varied_share", share).withColumn("too_sparse", share < threshold)


def cell_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Precision, sensitivity, specificity, balanced accuracy and no-report rate by every rollup of ``by``.

    ``rows``: ``by`` columns, positive, valid, strict, tp, fp, n_targets, n_findings, alert.
    """
    positive, clean = F.col("positive"), F.col("valid") & ~F.col("alert")
    out = rows.rollup(*by).agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.coalesce("tp", F.lit(0))).alias("tp"), F.sum(F.coalesce("fp", F.lit(0))).alias("fp"),
        F.avg(F.when(positive, (F.col("strict") == 1.0).cast("double"))).alias("sensitivity"),
        F.avg(F.when(~positive, clean.cast("double"))).alias("specificity"),
        F.avg((F.coalesce("n_findings", F.lit(0)) == 0).cast("double")).alias("no_report_rate"),
    )
    return out.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn(
        "balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2
    )


def failure_sensitivity(rows: DataFrame, *by: str) -> DataFrame:
    """Success with unresolved attempts counted as failures, and with them left out.

    ``rows``: ``by`` columns, strict, resolved.
    """
    won = F.col("strict") == 1.0
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_attempts"), F.count_if(~F.col("resolved")).alias("n_unresolved"),
        F.avg((won & F.col("resolved")).cast("double")).alias("success_all"),
        F.avg(F.when(F.col("resolved"), won.cast("double"))).alias("success_resolved"),
    )
