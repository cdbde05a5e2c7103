"""Hierarchical balanced sampling: task, class, kind, group, view, unit, each uniform in its parent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..lookups import TASKS
from ..session import cut_lineage
from .scale import chunked_row_number, hash_bucket

BRANCH = ["task", "cls", "kind"]
CELL = [*BRANCH, "group_id", "representation"]


def sampling_tree(units: DataFrame) -> DataFrame:
    """Eligible units with their class and kind. Positives share one kind."""
    positive = F.col("label").isin("positive", "attack")
    return units.filter((F.col("label") != "quarantined") & F.col("task").isin(*TASKS)).withColumn(
        "cls", F.when(positive, "positive").otherwise("negative")
    ).withColumn("kind", F.when(positive, "positive").otherwise(F.col("label")))


def cell_probabilities(tree: DataFrame) -> DataFrame:
    """Per cell (task, class, kind, group, view): units and the probability of each of them.

    Children are counted by grouping, level by level, never by a window over a parent: a kind may
    hold a third of all groups.
    """
    cells = tree.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_units"))
    groups = cells.groupBy(*BRANCH, "group_id").agg(F.count(F.lit(1)).alias("n_views"))
    kinds = groups.groupBy(*BRANCH).agg(F.count(F.lit(1)).alias("n_groups"))
    # at most 4 tasks x 2 classes x a few kinds from here on
    classes = kinds.groupBy("task", "cls").agg(F.count(F.lit(1)).alias("n_kinds"))
    tasks = classes.groupBy("task").agg(F.count(F.lit(1)).alias("n_classes"))
    total = tasks.agg(F.count(F.lit(1)).alias("n_tasks"))
    branches = kinds.join(classes, ["task", "cls"]).join(tasks, "task").join(total, F.lit(True))
    rows = cells.join(groups, [*BRANCH, "group_id"]).join(branches, BRANCH)
    share = F.lit(1.0)
    for level in ("n_tasks", "n_classes", "n_kinds", "n_groups", "n_views", "n_units"):
        share = share / F.col(level)
    return rows.withColumn("probability", share)


def unit_probabilities(units: DataFrame) -> DataFrame:
    """Marginal probability of every eligible unit; they sum to one."""
    tree = sampling_tree(units)
    return tree.join(cell_probabilities(tree).select(*CELL, "probability"), CELL)


def missing_strata(units: DataFrame) -> DataFrame:
    """(task, class) pairs without a unit."""
    present = sampling_tree(units).select("task", "cls").distinct()
    wanted = units.sparkSession.createDataFrame(
        [(t, c) for t in TASKS for c in ("positive", "negative")], "task string, cls string"
    )
    return wanted.join(present, ["task", "cls"], "left_anti")


def draw_units(units: DataFrame, n_draws: int, seed: int) -> DataFrame:
    """``n_draws`` independent draws with replacement.

    A draw walks down the tree: one hash uniform per level picks child ``floor(u * n) + 1``, which
    is looked up by an equi-join on (parent, child number). Children of open levels are numbered in
    hash buckets. No global sort and no cumulative weights. The tree and its cells are written once,
    since every level reads them.
    """
    tree = cut_lineage(sampling_tree(units).select("unit_id", "label", *CELL))
    cells = cut_lineage(cell_probabilities(tree))
    by_name = lambda name: uniform(F.lit("rank"), F.col(name))
    groups = cells.groupBy(*BRANCH, "group_id").agg(F.max("n_views").alias("n_views"), F.max("n_groups").alias("n_groups"))
    groups = groups.withColumn("_h", by_name("group_id"))
    groups = chunked_row_number(groups, BRANCH, ["_h", "group_id"], hash_bucket(F.col("_h")), "group_no").drop("_h")
    in_group = Window.partitionBy(*BRANCH, "group_id").orderBy("representation")
    views = cells.withColumn("view_no", F.row_number().over(in_group))
    members = tree.withColumn("_h", by_name("unit_id"))
    members = chunked_row_number(members, CELL, ["_h", "unit_id"], hash_bucket(F.col("_h")), "unit_no").drop("_h")

    # the closed levels: a handful of rows, one per (task, class, kind)
    order = Window.orderBy("task")
    kinds = cells.groupBy(*BRANCH).agg(F.max("n_groups").alias("n_groups"))
    kinds = kinds.withColumn("task_no", F.dense_rank().over(order)).withColumn(
        "class_no", F.dense_rank().over(Window.partitionBy("task").orderBy(F.desc("cls")))
    ).withColumn("kind_no", F.row_number().over(Window.partitionBy("task", "cls").orderBy("kind")))
    kinds = cut_lineage(kinds.withColumn("n_kinds", F.max("kind_no").over(Window.partitionBy("task", "cls"))).withColumn(
        "n_classes", F.max("class_no").over(Window.partitionBy("task"))
    ))
    n_tasks = kinds.select(F.max("task_no")).scalar()

    pick = lambda level, n: (F.floor(uniform(F.lit(seed), F.col("draw_index"), F.lit(level)) * n) + 1).cast("long")
    draws = units.sparkSession.range(n_draws).withColumnRenamed("id", "draw_index")
    drawn = draws.withColumn("task_no", pick("task", n_tasks)).join(
        kinds.select("task", "task_no", "n_classes").distinct(), "task_no"
    )
    drawn = drawn.withColumn("class_no", pick("class", F.col("n_classes"))).join(
        kinds.select("task", "cls", "class_no", "n_kinds").distinct(), ["task", "class_no"]
    )
    drawn = drawn.withColumn("kind_no", pick("kind", F.col("n_kinds"))).join(
        kinds.select(*BRANCH, "kind_no", "n_groups"), ["task", "cls", "kind_no"]
    ).select("draw_index", *BRANCH, "n_groups")
    drawn = drawn.withColumn("group_no", pick("group", F.col("n_groups"))).drop("n_groups")
    drawn = drawn.join(groups.drop("n_groups"), [*BRANCH, "group_no"])
    drawn = drawn.withColumn("view_no", pick("view", F.col("n_views"))).drop("n_views")
    drawn = drawn.join(views.select(*CELL, "view_no", "n_units", "probability"), [*BRANCH, "group_id", "view_no"])
    drawn = drawn.withColumn("unit_no", pick("unit", F.col("n_units")))
    drawn = drawn.join(members, [*CELL, "unit_no"])
    return drawn.select(
        "draw_index", "unit_id", "task", "cls", F.col("label").alias("kind"), "group_id", "representation", "probability"
    )


def exposure_by_task(draws: DataFrame) -> DataFrame:
    """Share of the draws per task, zero for a task without draws."""
    counts = draws.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    tasks = draws.sparkSession.createDataFrame([(t,) for t in TASKS], "task string")
    total = draws.agg(F.count(F.lit(1)).alias("n_draws"))
    rows = tasks.join(counts, "task", "left").join(total, F.lit(True))
    n = F.coalesce("n", F.lit(0))
    return rows.select("task", n.alias("n_drawn"), F.try_divide(n, F.col("n_draws")).alias("frequency"))


def exposure_by_class(draws: DataFrame) -> DataFrame:
    counts = draws.groupBy("task", "cls").agg(F.count(F.lit(1)).alias("n_drawn"))
    total = draws.agg(F.count(F.lit(1)).alias("n_draws"))
    return counts.join(total, F.lit(True)).select(
        "task", "cls", "n_drawn", (F.col("n_drawn") / F.col("n_draws")).alias("frequency")
    )


def exposure_by_group(draws: DataFrame) -> DataFrame:
    return draws.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_drawn"))


def exposure_totals(draws: DataFrame) -> DataFrame:
    """One row: draws, distinct units, distinct groups."""
    return draws.agg(
        F.count(F.lit(1)).alias("n_draws"), F.count_distinct("unit_id").alias("distinct_units"),
        F.count_distinct("group_id").alias("distinct_groups"),
    )


def groups_never_drawn(draws: DataFrame, units: DataFrame) -> DataFrame:
    eligible = units.filter("label <> 'quarantined'").select("group_id").distinct()
    return eligible.join(draws.select("group_id").distinct(), "group_id", "left_anti")


def materialise_draws(draws: DataFrame, slices: DataFrame, n_draws: int) -> DataFrame:
    """One dataset row per draw, repeats included, named by the zero-padded draw number."""
    width = len(str(n_draws))
    name = F.concat_ws("_", F.lpad(F.col("draw_index").cast("string"), width, "0"), F.col("unit_id"))
    return draws.join(slices, "unit_id").withColumn("name", name)
