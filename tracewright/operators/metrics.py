"""Evaluation rows, hierarchical means and the per-task development score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import last_segment
from ..lookups import TASKS


def unit_rows(trials: DataFrame, units: DataFrame, invalid_as_zero: bool = False) -> DataFrame:
    """One evaluation row per trial of a known unit.

    ``trials``: task_name, reward STRUCT<reward>, diagnostics STRUCT<schema_valid, n_findings, n_high,
    n_targets, tp, fp, strict_success>, termination. Recall of an invalid output is null, hence left
    out of means; ``invalid_as_zero=True`` counts it as zero on positive units.
    """
    rows = trials.withColumn("unit_id", last_segment(F.col("task_name"))).join(
        units.select("unit_id", "task", "label", "group_id", "representation"), "unit_id"
    )
    d = lambda name: F.col(f"diagnostics.{name}")
    valid = F.coalesce(d("schema_valid"), F.lit(False))
    high = F.when(valid, F.coalesce(d("n_high"), F.lit(0))).otherwise(0)
    counted = valid & (F.coalesce(d("n_targets"), F.lit(0)) != 0)
    positive = F.col("label").isin("positive", "attack")
    recall = F.when(counted, d("tp") / d("n_targets"))
    clean_recall = F.when(counted, F.when(d("fp") == 0, d("tp") / d("n_targets")).otherwise(0.0))
    if invalid_as_zero:
        lost = positive & ~valid
        recall, clean_recall = (F.when(lost, 0.0).otherwise(c) for c in (recall, clean_recall))
    return rows.select(
        "unit_id", "task", "label", F.col("group_id").alias("grp"), F.col("representation").alias("rep"),
        positive.alias("positive"), F.coalesce(F.col("reward.reward"), F.lit(0.0)).alias("reward"),
        F.when(valid, F.coalesce(d("strict_success"), F.lit(0.0))).otherwise(0.0).alias("strict"),
        valid.alias("valid"),
        F.when(F.col("task") == "classification", valid & (high == 1)).otherwise(high > 0).alias("alert"),
        recall.alias("recall"), clean_recall.alias("fp_free_recall"),
        F.when(valid, d("fp")).alias("fp"), F.when(valid, d("n_findings")).alias("n_findings"), "termination",
    )


def hierarchical_mean(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean of attempts in a unit, units in a view, views in a group, groups. Nulls are left out.

    Four chained aggregates, each with a map-side partial step.
    """
    level = rows.filter(F.col(value).isNotNull())
    for keys in (["grp", "rep", "unit_id"], ["grp", "rep"], ["grp"], []):
        level = level.groupBy(*by, *keys).agg(F.avg(value).alias(value))
    return level


def dev_score(rows: DataFrame) -> DataFrame:
    """Per task, and for all tasks as ``*``: P, N, false_alert_rate, validity, recall, reward, group counts.

    The hierarchical means of all measures run as one chain keyed by (task, measure).
    """
    whole = F.col("task") == "classification"
    number = lambda c: c.cast("double")
    found = F.when(whole, F.col("strict")).otherwise(F.col("fp_free_recall"))
    clean = F.when(whole, F.col("strict")).otherwise(number(F.col("valid") & ~F.col("alert")))
    entry = lambda task, name, value: F.struct(task.alias("task"), F.lit(name).alias("measure"), value.alias("v"))
    task = F.col("task")
    entries = F.array(
        entry(task, "P", F.when(F.col("positive"), found)),
        entry(task, "N", F.when(~F.col("positive"), clean)),
        entry(task, "false_alert_rate", F.when(~F.col("positive"), number(F.col("alert")))),
        entry(task, "ordinary_recall", F.when(F.col("positive"), F.col("recall"))),
        entry(F.lit("*"), "false_alert_rate", F.when(~F.col("positive"), number(F.col("alert")))),
    )
    long = rows.select("grp", "rep", "unit_id", F.explode(entries).alias("e")).select("grp", "rep", "unit_id", "e.*")
    means = hierarchical_mean(long, "v", "task", "measure")
    pick = lambda name: F.max(F.when(F.col("measure") == name, F.col("v"))).alias(name)
    means = means.groupBy("task").agg(pick("P"), pick("N"), pick("false_alert_rate"), pick("ordinary_recall"))

    scope = rows.withColumn("task", F.explode(F.array("task", F.lit("*"))))
    groups = scope.select("task", "positive", "grp").distinct().groupBy("task").agg(
        F.count_if("positive").alias("n_positive_groups"), F.count_if(~F.col("positive")).alias("n_negative_groups")
    )
    plain = scope.groupBy("task").agg(
        F.avg(number(F.col("valid"))).alias("validity"), F.avg("reward").alias("natural_mean_reward"),
        F.count(F.lit(1)).alias("n_records"),
    )
    return plain.join(groups, "task").join(means, "task", "left")


def overall_d(per_task: DataFrame) -> DataFrame:
    """One row: D, the mean over tasks of (P + N) / 2, null unless every task has it."""
    half = (F.col("P") + F.col("N")) / 2
    defined = per_task.filter(F.col("task").isin(*TASKS) & half.isNotNull())
    out = defined.agg(F.avg(half).alias("_d"), F.count(F.lit(1)).alias("available_tasks"))
    return out.select(F.when(F.col("available_tasks") == len(TASKS), F.col("_d")).alias("D"), "available_tasks")


def termination_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("termination").agg(F.count(F.lit(1)).alias("n_trials"))


def trivial_policy(units: DataFrame) -> DataFrame:
    """P and N of a policy that reports nothing, per task: 0 and 1 where such groups exist."""
    known = units.filter((F.col("label") != "quarantined") & F.col("task").isin(*TASKS))
    positive = F.col("label").isin("positive", "attack")
    present = known.groupBy("task").agg(F.bool_or(positive).alias("_p"), F.bool_or(~positive).alias("_n"))
    tasks = units.sparkSession.createDataFrame([(t,) for t in TASKS], "task string")
    return tasks.join(present, "task", "left").select(
        "task", F.when(F.col("_p"), 0.0).alias("P"), F.when(F.col("_n"), 1.0).alias("N")
    )
