"""Constrained allocation of groups to splits.

The reference shape of the search is kept (stratified random candidates, arg-best by feasibility,
violations and score, a ladder of fractions), but a candidate is described by how many groups of
each stratum go to each split. Strata are (data set, label, tasks, OS), all closed sets, so the cost
of scoring thousands of candidates does not depend on the number of groups; groups are touched
twice: to count strata, and to deal out the winning candidate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..lookups import SPLITS, TASKS
from ..session import cut_lineage
from .scale import chunked_row_number, hash_bucket

STRATUM = ["dataset", "label", "tasks", "os"]


def _cell_label(label: Column) -> Column:
    """Mixed groups count as benign."""
    return F.when(label == "attack", "attack").otherwise("benign")


def margin_cells() -> Column:
    """Array of the (margin, cell) pairs a group or stratum counts in. Each margin counts it once per cell."""
    pair = lambda margin, cell: F.struct(F.lit(margin).alias("margin"), cell.alias("cell"))
    return F.concat(
        F.array(pair("dataset", F.col("dataset"))),
        F.transform("tasks", lambda t: pair("task_label", F.concat_ws("/", t, _cell_label(F.col("label"))))),
        F.transform("os", lambda o: pair("os", o)),
    )


def split_margins(groups: DataFrame, assignment: DataFrame) -> DataFrame:
    """Groups per split for every margin cell and in all: (margin, cell, split, n_groups)."""
    placed = groups.join(assignment.select("group_id", "split"), "group_id")
    everything = F.array(F.struct(F.lit("all").alias("margin"), F.lit("all").alias("cell")))
    cells = placed.select("split", F.explode(F.concat(everything, margin_cells())).alias("c"))
    return cells.groupBy("c.margin", "c.cell", "split").agg(F.count(F.lit(1)).alias("n_groups"))


def margin_table(margins: DataFrame) -> DataFrame:
    """Margins as a cross-tab: one column per split, zero-filled."""
    wide = margins.groupBy("margin", "cell").pivot("split", list(SPLITS)).agg(F.sum("n_groups"))
    return wide.fillna(0, list(SPLITS))


def strata_counts(groups: DataFrame) -> DataFrame:
    """Strata with their number of groups and a text key."""
    counted = groups.groupBy(*STRATUM).agg(F.count(F.lit(1)).alias("n"))
    key = F.concat_ws(
        "|", "dataset", "label", F.concat_ws(",", "tasks"), F.concat_ws(",", "os")
    )
    return counted.withColumn("stratum", key)


def _lottery(u: str, weights: Sequence[Column]) -> Column:
    """Index drawn in proportion to three weights."""
    point = F.col(u) * (weights[0] + weights[1] + weights[2])
    return F.when(point < weights[0], 0).when(point < weights[0] + weights[1], 1).otherwise(2)


def candidate_rows(strata: DataFrame, ladder: Sequence[tuple[float, float, float]], n_candidates: int, block: int = 64) -> DataFrame:
    """Strata repeated for every rung and candidate, spread over the cluster in blocks of candidates."""
    last = F.lit(n_candidates - 1)
    rows = strata.withColumn("rung", F.explode(F.array(*[F.lit(i) for i in range(len(ladder))])))
    rows = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), last, F.lit(block)))).repartition("rung", "_block")
    each = F.sequence(F.col("_block"), F.least(F.col("_block") + block - 1, last))
    return rows.withColumn("candidate", F.explode(each)).drop("_block")


def candidate_counts(rows: DataFrame, ladder: Sequence[tuple[float, float, float]], seed: int) -> DataFrame:
    """Groups of each stratum per split, for the rung and candidate of each row.

    A split gets the whole part of its quota; the remaining one or two groups are drawn in
    proportion to the fractional parts, without giving one split both.
    """
    columns = rows.columns
    for j in range(3):
        fractions = F.array(*[F.lit(float(rung[j])) for rung in ladder])
        rows = rows.withColumn(f"f{j}", F.get(fractions, F.col("rung")))
    quota = [F.col(f"f{j}") * F.col("n") for j in range(3)]
    for j in range(3):
        rows = rows.withColumn(f"b{j}", F.floor(quota[j])).withColumn(f"w{j}", quota[j] - F.floor(quota[j]))
    rows = rows.withColumn("_left", F.col("n") - F.col("b0") - F.col("b1") - F.col("b2"))
    draw = lambda k: uniform(F.lit(seed), F.col("rung"), F.col("candidate"), F.col("stratum"), F.lit(k))
    one = F.when(F.col("_left") >= 1, _lottery("_u1", [F.col(f"w{j}") for j in range(3)]))
    rows = rows.withColumn("_u1", draw(1)).withColumn("_one", one)
    rest = [F.when(F.col("_one") == j, F.lit(0.0)).otherwise(F.col(f"w{j}")) for j in range(3)]
    rows = rows.withColumn("_u2", draw(2)).withColumn("_two", F.when(F.col("_left") >= 2, _lottery("_u2", rest)))
    hit = lambda c, j: F.when(F.col(c) == j, 1).otherwise(0)
    kept = [(F.col(f"b{j}") + hit("_one", j) + hit("_two", j)).cast("long").alias(f"k{j}") for j in range(3)]
    return rows.select(*columns, "f0", "f1", "f2", *kept)


def score_candidates(candidates: DataFrame, min_dev_groups: int = 2, min_train_positive: int = 2) -> DataFrame:
    """Score and violations per candidate: (rung, candidate, score, n_violations).

    The score is the sum over margin cells of the squared distance to the target fractions. Cells
    that no group fills violate the constraints too: the number of met constraints is subtracted.
    """
    cells = candidates.select(
        "rung", "candidate", "f0", "f1", "f2", "k0", "k1", "k2", F.explode(margin_cells()).alias("c")
    )
    sums = cells.groupBy("rung", "candidate", "f0", "f1", "f2", "c.margin", "c.cell").agg(
        *[F.sum(f"k{j}").alias(f"k{j}") for j in range(3)]
    )
    n = F.col("k0") + F.col("k1") + F.col("k2")
    gap = sum(F.pow(F.col(f"k{j}") / n - F.col(f"f{j}"), F.lit(2)) for j in range(3))
    task, kind = F.substring_index("cell", "/", 1), F.substring_index("cell", "/", -1)
    constrained = (F.col("margin") == "task_label") & task.isin(*TASKS)
    met = F.count_if(constrained & (F.col("k1") >= min_dev_groups)) + F.count_if(
        constrained & (kind == "attack") & (F.col("k0") >= min_train_positive)
    )
    return sums.groupBy("rung", "candidate").agg(
        F.round(F.sum(gap), 9).alias("score"), (F.lit(3 * len(TASKS)) - met).alias("n_violations")
    )


def best_candidate(scored: DataFrame) -> DataFrame:
    """Per rung, the best candidate by (infeasible, violations, score), earliest on ties."""
    key = F.struct((F.col("n_violations") > 0).alias("infeasible"), "n_violations", "score", "candidate")
    return scored.groupBy("rung").agg(F.min(key).alias("k")).select("rung", "k.*")


def choose_rung(attempts: DataFrame) -> DataFrame:
    """First feasible rung, or the last one tried: one row."""
    key = F.struct(
        F.col("infeasible"), F.when(F.col("infeasible"), -F.col("rung")).otherwise(F.col("rung")).alias("_order"),
        "rung", "candidate", "score", "n_violations",
    )
    return attempts.agg(F.min(key).alias("k")).select("k.rung", "k.candidate", "k.score", "k.n_violations", "k.infeasible")


def deal_groups(groups: DataFrame, quotas: DataFrame, seed: int) -> DataFrame:
    """Shuffle the groups of each stratum by hash and deal them out: (group_id, split).

    ``quotas``: the counts of the chosen candidate per stratum.
    """
    # data sets come from the data, so the size of the strata decides how this is joined
    rows = groups.join(quotas.select(*STRATUM, "rung", "candidate", "k0", "k1"), STRATUM)
    rows = rows.withColumn("_u", uniform(F.lit(seed), F.col("rung"), F.col("candidate"), F.col("group_id")))
    ranked = chunked_row_number(rows, STRATUM, ["_u", "group_id"], hash_bucket(F.col("_u")), "_rank")
    split = (
        F.when(F.col("_rank") <= F.col("k0"), SPLITS[0])
        .when(F.col("_rank") <= F.col("k0") + F.col("k1"), SPLITS[1])
        .otherwise(SPLITS[2])
    )
    return ranked.select("group_id", split.alias("split"))


def search(groups: DataFrame, ladder: Sequence[tuple[float, float, float]], seed: int, n_candidates: int = 4000,
           min_dev_groups: int = 2, min_train_positive: int = 2) -> tuple[DataFrame, DataFrame]:
    """The strata, and the best candidate per rung with its score: the log of attempts."""
    strata = cut_lineage(strata_counts(groups))
    candidates = candidate_counts(candidate_rows(strata, ladder, n_candidates), ladder, seed)
    return strata, cut_lineage(best_candidate(score_candidates(candidates, min_dev_groups, min_train_positive)))


def allocate(groups: DataFrame, ladder: Sequence[tuple[float, float, float]], seed: int, n_candidates: int = 4000,
             min_dev_groups: int = 2, min_train_positive: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns (assignment, chosen, attempts): rows per group, the chosen rung, the log per rung.

    Only the counts of the chosen candidate are worked out again for dealing.
    """
    strata, attempts = search(groups, ladder, seed, n_candidates, min_dev_groups, min_train_positive)
    chosen = choose_rung(attempts)
    winner = strata.join(F.broadcast(chosen.select("rung", "candidate")), F.lit(True))  # one row
    return deal_groups(groups, candidate_counts(winner, ladder, seed), seed), chosen, attempts


def constraint_violations(groups: DataFrame, assignment: DataFrame, min_dev_groups: int = 2,
                          min_train_positive: int = 2) -> DataFrame:
    """Messages of the violated constraints of an assignment."""
    margins = split_margins(groups, assignment).filter("margin = 'task_label'")
    wanted = [
        (f"{task}/{label}", task, label, split, low)
        for task in TASKS
        for label, split, low in (
            ("attack", "dev", min_dev_groups), ("benign", "dev", min_dev_groups), ("attack", "train", min_train_positive)
        )
    ]
    schema = "cell string, task string, label string, split string, low int"
    lookup = groups.sparkSession.createDataFrame(wanted, schema)
    counts = lookup.join(margins.select("cell", "split", "n_groups"), ["cell", "split"], "left")
    counts = counts.withColumn("n_groups", F.coalesce("n_groups", F.lit(0))).filter("n_groups < low")
    message = F.format_string("%s has %d %s groups for %s (< %d)", "split", "n_groups", "label", "task", "low")
    return counts.select(message.alias("violation"))


def split_files(files: DataFrame, mapping: DataFrame, assignment: DataFrame) -> DataFrame:
    """Carry group and split to the files."""
    return files.join(mapping, "rel_path").join(assignment, "group_id")


def split_conflicts(files_with_split: DataFrame) -> DataFrame:
    """Contents that occur in more than one split. Must be empty."""
    return (
        files_with_split.groupBy("sha256").agg(F.size(F.collect_set("split")).alias("n_splits")).filter("n_splits > 1")
    )
