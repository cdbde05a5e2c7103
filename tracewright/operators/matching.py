"""Grounded matching of findings to targets, rewards, and end-to-end grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as E
from ..functions import timestamps as T
from ..lookups import HIGH
from ..session import cut_lineage
from .evidence import entity_kind, task_precision
from .validation import explode_findings, validate_payloads

ATTEMPT = ["unit_id", "attempt_id"]
FINDING = [*ATTEMPT, "finding_index"]


def unit_rules(units: DataFrame) -> DataFrame:
    """What matching needs of a unit: kind, precision, case rule, and where its lines are."""
    return units.select(
        "unit_id", "rel_path", "start_line", "representation",
        entity_kind(F.col("task")).alias("kind"),
        F.coalesce(task_precision(F.col("dataset"), F.col("task")), F.lit("second")).alias("precision"),
        (F.col("os") == "windows").alias("case_insensitive"),
    )


def _normalised(findings: DataFrame, units: DataFrame) -> DataFrame:
    rows = findings.filter("task <> 'classification'").join(unit_rules(units), "unit_id")
    return rows.withColumn("ts_norm", T.norm_timestamp(F.col("timestamp"), F.col("precision"))).withColumn(
        "ent_norm", E.norm_entity(F.col("kind"), F.col("entity"), F.col("case_insensitive"))
    )


def grounded_findings(normalised: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings with a referenced line that carries their time and, for hosts and paths, their entity.

    References are few and name lines exactly, so the corpus is probed by (rel_path, line_no).
    """
    refs = normalised.select(
        *FINDING, "rel_path", "representation", "kind", "precision", "case_insensitive", "ts_norm", "ent_norm",
        F.explode("source_lines").alias("_ref"), "start_line",
    ).withColumn("line_no", F.col("start_line") + F.col("_ref") - 1)
    found = refs.join(lines.select("rel_path", "line_no", "line"), ["rel_path", "line_no"])
    time = T.to_precision(T.line_time(F.col("line"), F.col("representation")), F.col("precision"))
    hay = F.when(F.col("kind") == "path", E.norm_path(F.col("line"), F.col("case_insensitive"))).otherwise(F.lower("line"))
    shows = (F.col("kind") == "technique") | F.contains(hay, F.col("ent_norm"))
    return found.filter((time == F.col("ts_norm")) & shows).select(*FINDING).distinct()


def assign_findings(findings: DataFrame, units: DataFrame, targets: DataFrame, lines: DataFrame) -> DataFrame:
    """Outcome per finding: low_confidence, fp, ungrounded, neutral, redundant or tp.

    ``targets``: unit_id, target_id, target_order, status, stamp, aliases, one row per stamp. A finding takes the first
    supported target it hits in list order, else the last ambiguous one; of the findings on one
    supported target the first is ``tp``.
    """
    rows = cut_lineage(_normalised(findings, units))  # read three times below
    grounded = grounded_findings(rows.filter((F.col("verdict") == HIGH) & F.col("ts_norm").isNotNull()), lines)
    names = targets.join(unit_rules(units).select("unit_id", "kind", "case_insensitive"), "unit_id")
    names = names.select(
        "unit_id", "target_id", "target_order", "status", F.col("stamp").alias("ts_norm"), "kind", "case_insensitive",
        F.explode("aliases").alias("alias"),
    )
    names = names.withColumn("ent_norm", E.norm_entity(F.col("kind"), F.col("alias"), F.col("case_insensitive")))
    names = names.select("unit_id", "target_id", "target_order", "status", "ts_norm", "ent_norm").distinct()
    supported = F.col("status") == "supported_positive"
    entry = F.struct("target_order", "target_id", "status")
    hits = rows.join(names, ["unit_id", "ts_norm", "ent_norm"]).groupBy(*FINDING).agg(
        F.coalesce(F.min(F.when(supported, entry)), F.max(F.when(~supported, entry))).alias("_hit")
    )
    rows = rows.join(grounded.withColumn("_grounded", F.lit(True)), FINDING, "left").join(hits, FINDING, "left")
    before_cover = (
        F.when(F.col("verdict") != HIGH, "low_confidence")
        .when(F.col("ts_norm").isNull(), "fp")
        .when(F.col("_grounded").isNull(), "ungrounded")
        .when(F.col("_hit").isNull(), "fp")
        .when(F.col("_hit.status") != "supported_positive", "neutral")
        .otherwise("covers")
    )
    rows = rows.withColumn("outcome", before_cover)
    takes = F.col("outcome").isin("neutral", "covers")
    rows = rows.withColumn("target_id", F.when(takes, F.col("_hit.target_id")))
    turn = F.row_number().over(Window.partitionBy(*ATTEMPT, "target_id", "outcome").orderBy("finding_index"))
    rows = rows.withColumn("_turn", turn)
    final = F.when(F.col("outcome") != "covers", F.col("outcome")).when(F.col("_turn") == 1, "tp").otherwise("redundant")
    return rows.select(*FINDING, "verdict", final.alias("outcome"), "target_id")


def match_counts(assignments: DataFrame) -> DataFrame:
    """Per attempt: tp, fp (ungrounded included) and the matched targets (at most 32)."""
    return assignments.groupBy(*ATTEMPT).agg(
        F.count_if(F.col("outcome") == "tp").alias("tp"),
        F.count_if(F.col("outcome").isin("fp", "ungrounded")).alias("fp"),
        F.sort_array(F.collect_set(F.when(F.col("outcome") == "tp", F.col("target_id")))).alias("matched_targets"),
    )


def strict_reward(task: Column, label: Column, valid: Column, n_high: Column, n_targets: Column, tp: Column, fp: Column) -> Column:
    """Binary success; invalid output scores zero."""
    classified = (n_high > 0) == (label == "attack")
    found_all = (tp == n_targets) & (fp == 0)
    clean = (fp == 0) & (n_high == 0)
    success = F.when(task == "classification", classified).when(label == "positive", found_all).otherwise(clean)
    return F.when(valid & success, 1.0).otherwise(0.0)


def dense_reward(task: Column, label: Column, valid: Column, n_high: Column, n_targets: Column, tp: Column, fp: Column) -> Column:
    """(tp / n) / (1 + fp) on positive windows; binary otherwise."""
    graded = valid & (task != "classification") & (label == "positive")
    share = F.when(n_targets == 0, F.lit(0.0)).otherwise((tp / n_targets) / (1 + fp))
    return F.when(graded, share).otherwise(strict_reward(task, label, valid, n_high, n_targets, tp, fp))


def grade(payloads: DataFrame, units: DataFrame, targets: DataFrame, lines: DataFrame) -> DataFrame:
    """Diagnostics row per (unit, attempt): validity, counts, both rewards, termination."""
    # read several times below, and small next to the lines: validate once
    checked = cut_lineage(validate_payloads(payloads).drop("payload"))
    findings = explode_findings(checked)
    counts = match_counts(assign_findings(findings, units, targets, lines))
    wanted = targets.filter("status = 'supported_positive'").select("unit_id", "target_id").distinct()
    wanted = wanted.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_targets"))
    rows = checked.select(*ATTEMPT, "task", "schema_valid", "first_error", "n_findings", "n_high")
    rows = rows.join(units.select("unit_id", "label"), "unit_id").join(wanted, "unit_id", "left").join(counts, ATTEMPT, "left")
    graded = F.col("schema_valid") & (F.col("task") != "classification")
    for name in ("n_targets", "tp", "fp"):
        rows = rows.withColumn(name, F.when(graded, F.coalesce(name, F.lit(0))))
    args = [F.col(c) for c in ("task", "label", "schema_valid", "n_high", "n_targets", "tp", "fp")]
    return rows.withColumn("strict_success", strict_reward(*args)).withColumn("dense_reward", dense_reward(*args)).withColumn(
        "termination", F.when(F.col("schema_valid"), "graded").otherwise("invalid_output")
    )


def oracle_findings(units: DataFrame, window_targets: DataFrame, targets: DataFrame, evidence: DataFrame,
                    lines: DataFrame, max_lines: int = 32) -> DataFrame:
    """The finding that proves each supported target of each positive window.

    (unit_id, target_id, timestamp, entity, source_lines): time and alias of the first evidence line,
    and the first ``max_lines`` evidence lines, counted from the window start. Evidence lines of one
    target in one window are at most the lines of a window.
    """
    here = window_targets.filter("status = 'supported_positive'").select("rel_path", "window_index", "target_id")
    span = units.filter("task <> 'classification' and label = 'positive'").select(
        "unit_id", "rel_path", "window_index", "start_line", "end_line", "representation"
    )
    rows = here.join(span, ["rel_path", "window_index"]).join(
        evidence.select("target_id", "rel_path", "line_no"), ["target_id", "rel_path"]
    ).filter("line_no between start_line and end_line")
    picked = rows.groupBy("unit_id", "target_id", "rel_path", "representation", "start_line").agg(
        F.slice(F.array_sort(F.collect_list("line_no")), 1, max_lines).alias("_lines")
    )
    picked = picked.withColumn("line_no", F.get("_lines", F.lit(0)))
    shown = picked.join(lines.select("rel_path", "line_no", "line"), ["rel_path", "line_no"]).join(
        targets.select("target_id", "entity_kind", "aliases"), "target_id"
    )
    return shown.select(
        "unit_id", "target_id", T.extract_raw_time(F.col("line"), F.col("representation")).alias("timestamp"),
        E.alias_on_line(F.col("entity_kind"), F.col("aliases"), F.col("line")).alias("entity"),
        F.transform("_lines", lambda x: x - F.col("start_line") + 1).alias("source_lines"),
    )


def oracle_payloads(units: DataFrame, findings: DataFrame, field_of_task: dict[str, str]) -> DataFrame:
    """Payload text per unit from the proving findings, valid under the payload rules.

    At most 32 findings make a valid payload; a unit with more keeps them all and fails validation,
    as it would when submitted.
    """
    field = F.create_map(*[F.lit(x) for pair in field_of_task.items() for x in pair])[F.col("task")]
    rows = findings.join(units.select("unit_id", "task"), "unit_id")
    item = F.to_json(F.map_from_entries(F.array(
        F.struct(F.lit("timestamp").alias("k"), F.col("timestamp").alias("v")),
        F.struct(field.alias("k"), F.col("entity").alias("v")),
        F.struct(F.lit("verdict").alias("k"), F.lit(HIGH).alias("v")),
    )))
    opening = F.concat(F.lit('{"source_lines":'), F.to_json("source_lines"), F.lit(","))
    item = F.concat(opening, F.regexp_replace(item, r"^\{", ""))
    texts = rows.select("unit_id", item.alias("_item")).groupBy("unit_id").agg(
        F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("_item")), ","), F.lit("]")).alias("payload")
    )
    verdict = F.when(F.col("label") == "attack", HIGH).otherwise("LOW_SUSPICIOUS")
    whole = F.concat(F.lit('[{"source_lines":[],"verdict":"'), verdict, F.lit('"}]'))
    out = units.select("unit_id", "task", "label", "n_lines").join(texts, "unit_id", "left")
    text = F.when(F.col("task") == "classification", whole).otherwise(F.coalesce("payload", F.lit("[]")))
    return out.select("unit_id", F.lit(0).alias("attempt_id"), "task", "n_lines", text.alias("payload"))


def gate_report(graded: DataFrame, problems: DataFrame) -> DataFrame:
    """Per split: units, oracle passes and failures, leakage problems.

    ``graded``: split, unit_id, strict_success. ``problems``: split, unit_id, problem.
    """
    scores = graded.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_units"), F.count_if(F.col("strict_success") == 1.0).alias("oracle_pass"),
        F.count_if(F.col("strict_success") < 1.0).alias("oracle_failures"),
    )
    leaks = problems.groupBy("split").agg(F.count(F.lit(1)).alias("leakage_problems"))
    return scores.join(leaks, "split", "left").fillna(0, ["leakage_problems"])
