"""Step eligibility, selection and early stopping per arm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lookups import FALSE_ALERT_SLACK, MANIPULATION_TARGET, MIN_IMPROVEMENT, PATIENCE, VALIDITY_SLACK


def eligible_steps(evaluations: DataFrame) -> DataFrame:
    """Evaluations with the base row (step 0) of their arm, ``eligible`` and the failed conditions.

    ``evaluations``: arm, step, D, false_alert_rate, validity, positive_recall.
    """
    base = evaluations.filter("step = 0").select(
        "arm", F.col("D").alias("base_D"), F.col("false_alert_rate").alias("_f0"), F.col("validity").alias("_v0"),
        F.col("positive_recall").alias("base_recall"),
    )
    rows = evaluations.join(base, "arm")
    alert_ok = F.coalesce(F.col("false_alert_rate") <= F.col("_f0") + FALSE_ALERT_SLACK, F.lit(False))
    valid_ok = F.coalesce(F.col("validity") >= F.col("_v0") - VALIDITY_SLACK, F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(F.col("D").isNull(), "D undefined"),
        F.when(~alert_ok, "false-alert rate above base"),
        F.when(~valid_ok, "validity below base"),
    ))
    return rows.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0).drop("_f0", "_v0")


def select_step(evaluations: DataFrame) -> DataFrame:
    """Per arm the eligible step with the greatest D, the earliest on ties, and the manipulation check."""
    rows = eligible_steps(evaluations)
    key = F.when(F.col("eligible"), F.struct(F.col("D").alias("d"), (-F.col("step")).alias("s"), F.col("positive_recall").alias("r")))
    best = rows.groupBy("arm").agg(F.max(key).alias("_b"), F.first("base_D").alias("base_D"), F.first("base_recall").alias("_r0"))
    passed = (
        (F.col("_b.s") < 0)
        & (F.col("_b.d") - F.col("base_D") >= MANIPULATION_TARGET)
        & (F.coalesce("_b.r", F.lit(0.0)) > F.coalesce("_r0", F.lit(0.0)))
    )
    return best.select(
        "arm", F.coalesce(-F.col("_b.s"), F.lit(0)).alias("selected_step"),
        F.coalesce("_b.d", "base_D").alias("selected_D"), "base_D",
        F.coalesce(passed, F.lit(False)).alias("manipulation_check_passed"),
    )


def fold_steps(steps: Column) -> Column:
    """Walk the evaluations of an arm in step order: last accepted best, misses in a row, stop step."""
    start = F.struct(
        F.lit(None).cast("double").alias("best"), F.lit(0).alias("misses"), F.lit(None).cast("long").alias("stop")
    )

    def step(state: Column, x: Column) -> Column:
        gain = x["eligible"] & (state["best"].isNull() | (x["D"] >= state["best"] + MIN_IMPROVEMENT))
        misses = F.when(gain, F.lit(0)).otherwise(state["misses"] + 1)
        return F.struct(
            F.when(gain, x["D"]).otherwise(state["best"]).alias("best"), misses.alias("misses"),
            F.when(state["stop"].isNotNull(), state["stop"]).when(misses >= PATIENCE, x["step"].cast("long")).alias("stop"),
        )

    return F.aggregate(steps, start, step)


def early_stop(evaluations: DataFrame) -> DataFrame:
    """Per arm: did four evaluations in a row bring no eligible gain over the last accepted best?

    The gain is measured against the last accepted value, so this is a fold and no running maximum.
    The list of an arm is bounded by its iteration cap (a few hundred steps).
    """
    rows = eligible_steps(evaluations)
    ordered = F.array_sort(F.collect_list(F.struct("step", "D", "eligible")))
    folded = rows.groupBy("arm").agg(F.count(F.lit(1)).alias("n_evaluations"), fold_steps(ordered).alias("_s"))
    return folded.select("arm", "n_evaluations", F.col("_s.stop").isNotNull().alias("stopped"), F.col("_s.stop").alias("stop_step"))
