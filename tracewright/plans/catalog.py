"""Registered queries: every operator family on the given tables, in full."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import normalize as NZ
from ..functions import timestamps as T
from ..lookups import FINDING_FIELD
from ..operators import compat as C
from ..operators import components as G
from ..operators import edges as ED
from ..operators import evidence as E
from ..operators import inventory as I
from ..operators import matching as M
from ..operators import metrics as MT
from ..operators import neardup as ND
from ..operators import sampling as SA
from ..operators import screening as SC
from ..operators import selection as SE
from ..operators import splits as SP
from ..operators import uncertainty as U
from ..operators import validation as V
from ..operators import windows as W
from ..session import cut_lineage, shared_dir
from ..sources import logtree as LT
from ..sources import manifests as MF
from ..streaming import early_stop as ES
from ..streaming import log_stream, sinks, spend
from . import bindings as B
from .chain import LogChain

LADDER = [(0.5, 0.1, 0.4), (0.5, 0.15, 0.35), (0.5, 0.2, 0.3)]
SPLIT_SEED = 20261003
N_CANDIDATES = 4_000
N_DRAWS = 5_000
N_BOOTSTRAP = 10_000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def _joined(column: str) -> Column:
    """Arrays as text, for results that are compared across engines."""
    return F.array_join(column, ",")


def _round(column: str, digits: int = 9) -> Column:
    return F.round(F.col(column), digits).alias(column)


# --- times and names ----------------------------------------------------------------------------


@query
def time_formats(spark, sf):
    rows = B.raw_times(spark, sf)
    return rows.select(
        "event_id", "written_as", T.classify_format(F.col("raw")).alias("ts_format"),
        F.substring(_text(T.parse_record_time(F.col("raw"))), 1, 19).alias("local_second"),
        T.norm_timestamp(F.col("raw"), F.lit("minute")).alias("local_minute"),
    )


@query
def entity_norms(spark, sf):
    ev = B.log_events(spark, sf)
    rows = ev.select(
        "event_id", F.concat(F.lit(" ["), F.upper("host_name"), F.lit("]. ")).alias("host"),
        F.concat(F.lit("Create-"), F.initcap("command"), F.lit("  X")).alias("technique"),
        F.replace("path_name", F.lit("\\"), F.lit("\\\\")).alias("path"),
    )
    return rows.select(
        "event_id", NZ.norm_host(F.col("host")).alias("host_norm"),
        NZ.norm_technique(F.col("technique")).alias("technique_norm"),
        NZ.norm_path(F.concat(F.lit("'"), F.col("path"), F.lit("' ")), F.lit(True)).alias("path_norm"),
        F.coalesce(NZ.suspicious_host(NZ.norm_host(F.col("host"))), F.lit("none")).alias("suspicion"),
    )


@query
def file_names(spark, sf):
    """Names written from the attributes of the files, and what is read from them again."""
    written = B.doc_files(spark, sf).select("rel_path", "dataset", B.file_name().alias("filename"))
    rows = written.withColumn("p", N.parse_file_name(F.col("filename"))).select("rel_path", "dataset", "filename", "p.*")
    scenario = F.col("scenario")
    return rows.select(
        "rel_path", "filename", "representation", "host", "scenario", N.file_name_time(F.col("start_token")).alias("window_start"),
        N.file_name_time(F.col("end_token")).alias("window_end"), N.scenario_key(F.col("dataset"), F.col("host"), scenario).alias("scenario_key"),
        N.scenario_label(scenario).alias("label"), N.viewed_scenario_key(F.col("dataset"), scenario).alias("viewed_key"),
    )


# --- inventory ----------------------------------------------------------------------------------


@query
def file_profile(spark, sf):
    out = I.time_profile(B.timed_log_lines(spark, sf))
    return out.select(
        "rel_path", "lines", _joined("ts_formats").alias("ts_formats"),
        F.substring(_text("first_time"), 1, 19).alias("first_time"), F.substring(_text("last_time"), 1, 19).alias("last_time"),
        "parse_failures", "nonmonotonic",
    )


@query
def inventory_summary(spark, sf):
    return I.corpus_summary(B.doc_files(spark, sf))


@query
def source_summary(spark, sf):
    return I.source_summary(B.doc_files(spark, sf), B.DOC_SIZES)


@query
def duplicate_contents(spark, sf):
    return I.duplicate_contents(B.doc_files(spark, sf))


def _scanned(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Files and lines of the documents written out as a log tree and scanned in blocks."""
    root = f"{shared_dir(spark).rstrip('/')}/tracewright-tree-{uuid.uuid4().hex}"
    LT.write_tree(B.doc_tree(spark, sf), root)
    return LT.scan_tree(spark, root, blockBytes=B.TREE_BLOCK)


@query
def scanned_files(spark, sf):
    """The inventory record of every file of the tree."""
    files, lines = _scanned(spark, sf)
    out = I.file_records(files.drop("lines"), lines)
    return out.select(
        "rel_path", "dataset", "task", "filename", "representation", "host", "scenario", "scenario_key", "label", "os", "window_start",
        "window_end", "sha256", "bytes", "lines", "parse_failures", "nonmonotonic",
    )


@query
def scanned_lines(spark, sf):
    return _scanned(spark, sf)[1].select("rel_path", "line_no", "line", "line_bytes")


# --- provenance ---------------------------------------------------------------------------------


@query
def edges_same_key(spark, sf):
    return ED.same_key_edges(B.doc_files(spark, sf))


@query
def edges_identical(spark, sf):
    return ED.identical_content_edges(B.doc_files(spark, sf))


@query
def edges_overlap(spark, sf):
    return ED.distinct_edges(ED.overlap_edges(B.doc_files(spark, sf)))


@query
def edges_view_name(spark, sf):
    return ED.view_name_edges(B.doc_files(spark, sf))


@query
def edges_point_in_window(spark, sf):
    files = B.doc_files(spark, sf)
    return ED.distinct_edges(ED.annotation_time_edges(files, B.doc_annotations(files)))


@query
def edges_campaign_day(spark, sf):
    return ED.campaign_day_links(B.doc_files(spark, sf))


def _inventory(spark, sf) -> DataFrame:
    """The file inventory, written once: hashing reads every text, the rules only need the result."""
    return cut_lineage(B.doc_files(spark, sf).drop("text"))


def _edges(files, linear: bool):
    return ED.build_edges(files, B.doc_annotations(files), linear)


@query
def edges_dedup(spark, sf):
    return _edges(_inventory(spark, sf), linear=True)


@query
def edge_histogram(spark, sf):
    return ED.rule_histogram(_edges(_inventory(spark, sf), linear=True))


def _grouped(spark, sf) -> tuple[DataFrame, DataFrame]:
    files = _inventory(spark, sf)
    return files, cut_lineage(G.group_files(files, _edges(files, linear=True)))


@query
def components(spark, sf):
    return _grouped(spark, sf)[1]


@query
def components_weak(spark, sf):
    files = _inventory(spark, sf)
    return G.group_files(files, _edges(files, linear=True), include_weak=True)


@query
def group_table(spark, sf):
    out = G.group_table(*_grouped(spark, sf))
    return out.select(
        "group_id", "dataset", "label", *[_joined(c).alias(c) for c in ("os", "tasks", "representations")], "n_files"
    )


@query
def group_members(spark, sf):
    return G.group_members(*_grouped(spark, sf))


# --- splits -------------------------------------------------------------------------------------


def _groups(spark, sf) -> DataFrame:
    return cut_lineage(G.group_table(*_grouped(spark, sf)))


@query
def split_attempts(spark, sf):
    attempts = SP.search(_groups(spark, sf), LADDER, SPLIT_SEED, N_CANDIDATES)[1]
    return attempts.select("rung", "candidate", "score", "n_violations")


def _allocated(spark, sf):
    groups = _groups(spark, sf)
    assignment, chosen, _ = SP.allocate(groups, LADDER, SPLIT_SEED, N_CANDIDATES)
    return groups, assignment, chosen


@query
def split_best_candidate(spark, sf):
    return _allocated(spark, sf)[2].select("rung", "candidate", "score", "n_violations")


@query
def split_assignment(spark, sf):
    return _allocated(spark, sf)[1]


@query
def split_manifest(spark, sf):
    """The nested manifest written, read back and summed over the parts of each group."""
    files, mapping = _grouped(spark, sf)
    groups = cut_lineage(G.group_table(files, mapping))
    assignment = SP.allocate(groups, LADDER, SPLIT_SEED, N_CANDIDATES)[0]
    rows = files.join(mapping, "rel_path").join(assignment.select("group_id", "split"), "group_id")
    path = f"{shared_dir(spark).rstrip('/')}/tracewright-manifest-{uuid.uuid4().hex}"
    nested = MF.nested_split_manifest(rows, groups, part_files=100)
    MF.write_manifest(nested, path, "split")
    entries = MF.read_manifest(spark, path, nested.schema).withColumn("f", F.explode("files"))
    attributes = ["split", "group_id", "dataset", "label", *[_joined(c).alias(c) for c in ("os", "tasks")]]
    return entries.select(*attributes, "f", F.size("hosts").alias("h"), F.size("scenario_keys").alias("k")).groupBy(
        "split", "group_id", "dataset", "label", "os", "tasks"
    ).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("f.lines").alias("lines"), F.min("f.rel_path").alias("first_path"),
        F.max("f.sha256").alias("last_sha256"), (F.max("k") > 0).alias("keyed"), (F.max("h") > 0).alias("hosted"),
    )


@query
def split_margins(spark, sf):
    groups, assignment, _ = _allocated(spark, sf)
    return SP.split_margins(groups, assignment)


@query
def split_table(spark, sf):
    groups, assignment, _ = _allocated(spark, sf)
    return SP.margin_table(SP.split_margins(groups, assignment))


@query
def split_violations(spark, sf):
    groups, assignment, _ = _allocated(spark, sf)
    return SP.constraint_violations(groups, assignment, min_dev_groups=20, min_train_positive=40)


@query
def split_invariants(spark, sf):
    """Contents in two splits: none, since copies share a group."""
    files, mapping = _grouped(spark, sf)
    groups = cut_lineage(G.group_table(files, mapping))
    assignment, _, _ = SP.allocate(groups, LADDER, SPLIT_SEED, N_CANDIDATES)
    return SP.split_conflicts(SP.split_files(files, mapping, assignment)).agg(F.count(F.lit(1)).alias("n_conflicts"))


# --- windows ------------------------------------------------------------------------------------


@query
def tumbling_windows(spark, sf):
    out = W.tumbling_windows(B.doc_files(spark, sf), B.SCHEMA_VERSION, B.DOC_SIZES)
    return out.select("unit_id", "rel_path", "window_index", "n_windows", "start_line", "end_line", "n_lines")


@query
def duplicate_units(spark, sf):
    return W.duplicate_units(W.tumbling_windows(B.doc_files(spark, sf), B.SCHEMA_VERSION, B.DOC_SIZES))


@query
def slice_hash(spark, sf):
    files = B.doc_files(spark, sf)
    slices = W.window_slices(B.doc_lines(spark, sf), files, B.DOC_SIZES).unionByName(W.whole_slices(files))
    return slices.select("rel_path", "window_index", F.sha2("slice", 256).alias("sha256"))


@query
def slice_hash_text(spark, sf):
    slices = W.text_slices(B.doc_files(spark, sf), B.DOC_SIZES)
    return slices.select("rel_path", "window_index", F.sha2("slice", 256).alias("sha256"))


@query
def window_labels(spark, sf):
    return LogChain(spark, sf).units.select(
        "unit_id", "rel_path", "window_index", "label", "n_supported", "n_ambiguous", "quarantine_reason"
    )


UNIT_TEXTS = [  # task, representation, dataset, os, template
    ("classification", None, None, None, "Judge the {n_lines} lines of {scenario} ({os}). Give {required_fields}."),
    (None, None, None, None, "{task}: lines {start_line} to {end_line} of {rel_path}. Name {entity_field}; give {required_fields}, or {optional_fields}. {hint}"),
    ("lm", "raw", None, None, "Raw records of {dataset}, window {window_index} of {n_windows}: {{task}} asks for {entity_field}."),
]


@query
def unit_texts(spark, sf):
    """The task text of every unit, and the marks that nothing fills."""
    templates = spark.createDataFrame(UNIT_TEXTS, "task string, representation string, dataset string, os string, template string")
    out = W.render_text(LogChain(spark, sf).units, templates)
    return out.select("unit_id", "text", _joined("unknown_names").alias("unknown_names"))


@query
def unit_summary(spark, sf):
    return W.unit_summary(LogChain(spark, sf).units)


@query
def sealed_units(spark, sf):
    return W.guard_sealed(LogChain(spark, sf).units).groupBy("split").agg(F.count(F.lit(1)).alias("n_units"))


@query
def shifted_windows(spark, sf):
    chain = LogChain(spark, sf)
    out = W.shifted_windows(
        chain.units, chain.evidence_status, chain.files, B.SCHEMA_VERSION, shifts=(-15, -10, -5, 5, 10, 15)
    )
    return out.select("unit_id", "parent_id", "start_line", "end_line", "label", _round("weight"))


# --- evidence -----------------------------------------------------------------------------------


@query
def evidence_lines(spark, sf):
    return LogChain(spark, sf).evidence


@query
def targets_status(spark, sf):
    out = LogChain(spark, sf).targets
    return out.select(
        "target_id", "scenario_key", "entity_kind", _joined("aliases").alias("aliases"), "precision", "status", "reason",
        "merged_records", "n_evidence",
    )


@query
def target_stamps(spark, sf):
    return LogChain(spark, sf).stamps.select("target_id", "stamp_norm").distinct()


@query
def target_details(spark, sf):
    """What the records of each target say besides its entity, one row per value."""
    return E.target_details(LogChain(spark, sf).annotations)


@query
def target_records(spark, sf):
    """The full record of each target, with its written times and extra keys as texts."""
    chain = LogChain(spark, sf)
    out = E.target_records(chain.targets, E.target_details(chain.annotations))
    pairs = F.array_sort(F.transform(F.map_entries("extra"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "/"))))
    return out.select("target_id", "status", _joined("timestamps").alias("timestamps"), F.array_join(pairs, ";").alias("extra"))


@query
def quarantined_targets(spark, sf):
    out = E.quarantined_targets(LogChain(spark, sf).targets)
    return out.select("target_id", "status", "reason", _joined("aliases").alias("aliases"))


@query
def target_summary(spark, sf):
    return E.target_summary(LogChain(spark, sf).targets)


@query
def unplaced_targets(spark, sf):
    chain = LogChain(spark, sf)
    return E.unplaced_targets(chain.targets, chain.files).select("target_id", "scenario_key")


@query
def unit_truth(spark, sf):
    """Ground truth of each investigation unit."""
    return LogChain(spark, sf).unit_targets.select(
        "unit_id", "target_id", "target_order", "status", "stamp", _joined("aliases").alias("aliases")
    )


@query
def window_targets(spark, sf):
    return LogChain(spark, sf).window_targets


# --- grading ------------------------------------------------------------------------------------


@query
def payload_validity(spark, sf):
    out = V.validate_payloads(LogChain(spark, sf).payloads)
    return out.select("unit_id", "attempt_id", "schema_valid", "n_findings", "n_high")


@query
def payload_errors(spark, sf):
    """The first rule that each payload breaks; empty for a sound one."""
    out = V.validate_payloads(LogChain(spark, sf).payloads)
    return out.select("unit_id", "attempt_id", F.coalesce("first_error", F.lit("")).alias("first_error"))


def _findings(chain: LogChain) -> DataFrame:
    return cut_lineage(V.explode_findings(V.validate_payloads(chain.payloads)))


@query
def match_outcomes(spark, sf):
    chain = LogChain(spark, sf)
    return M.assign_findings(_findings(chain), chain.units, chain.unit_targets, chain.lines)


@query
def graded_attempts(spark, sf):
    chain = LogChain(spark, sf)
    out = M.grade(chain.payloads, chain.units, chain.unit_targets, chain.lines)
    return out.select(
        "unit_id", "attempt_id", "schema_valid", "n_targets", "tp", "fp", "strict_success", _round("dense_reward"), "termination"
    )


@query
def oracle_audit(spark, sf):
    """Grade the proving findings of every unit: passes and failures per split."""
    chain = LogChain(spark, sf)
    findings = M.oracle_findings(chain.units, chain.window_targets, chain.targets, chain.evidence, chain.lines)
    payloads = M.oracle_payloads(chain.units, findings, FINDING_FIELD)
    graded = M.grade(payloads, chain.units, chain.unit_targets, chain.lines).join(chain.units.select("unit_id", "split"), "unit_id")
    visible = chain.lines.join(chain.files.select("rel_path", "u"), "rel_path").select(
        F.expr("case when u div 16 % 10 < 5 then 'train' when u div 16 % 10 < 6 then 'dev' else 'test' end").alias("split"),
        F.concat_ws("#", "split", "rel_path", "line_no").alias("key"), F.col("line").alias("text"),
    )
    leaks = SC.leakage_scan(visible).withColumn("split", F.substring_index("key", "#", 1))
    return M.gate_report(graded, leaks)


@query
def line_count_errors(spark, sf):
    chain = LogChain(spark, sf)
    slices = W.window_slices(chain.lines, chain.files, B.LOG_SIZES)
    counted = slices.select("rel_path", "window_index", (F.size(F.split("slice", "\n")) - 1).cast("long").alias("n_found"))
    whole = chain.files.filter("task = 'classification'").select("rel_path", F.lit(0).cast("long").alias("window_index"), F.col("lines").cast("long").alias("n_found"))
    units, counted = chain.units, counted.unionByName(whole)
    found = units.select("unit_id", "rel_path", "window_index").join(counted, ["rel_path", "window_index"])
    return V.line_count_errors(found, units).agg(F.count(F.lit(1)).alias("n_errors"))


# --- compatibility scoring ----------------------------------------------------------------------


def _compat_inputs(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Scenarios, chunks, findings and truth of the submissions."""
    chain = LogChain(spark, sf)
    files = chain.files
    scenarios = files.groupBy("dataset", "task", "scenario").agg(
        F.min("label").alias("label"), F.sum("lines").alias("log_lines")
    ).withColumn("precision", F.coalesce(E.task_precision(F.col("dataset"), F.col("task")), F.lit("second")))
    scenarios = cut_lineage(scenarios)
    place = chain.units.select("unit_id", "dataset", "scenario")
    chunks = chain.payloads.select("unit_id", "attempt_id").join(
        chain.units.select("unit_id", "dataset", "task", "scenario"), "unit_id"
    ).withColumnRenamed("unit_id", "chunk_id")
    findings = _findings(chain).join(place, "unit_id").withColumnRenamed("unit_id", "chunk_id")
    return scenarios, chunks, findings, cut_lineage(C.truth_pairs(chain.annotations))


def _compat(spark, sf) -> DataFrame:
    return C.compat_counts(*_compat_inputs(spark, sf))


def _compared(spark, sf) -> DataFrame:
    inputs = _compat_inputs(spark, sf)
    scored = C.scored_findings(inputs[0], *inputs[2:], more_defensive=True)
    ours, theirs = C.compat_counts(*inputs, scored=scored), C.compat_counts(*inputs, more_defensive=True, scored=scored)
    return C.compare_scores(ours, theirs, C.ATTEMPT, ["tp", "fp", "fn"])


@query
def compat_counts(spark, sf):
    return _compat(spark, sf).select(
        "dataset", "task", "scenario", "attempt_id", "chunks", "tp", "fp", "fn", "tn", _round("accuracy")
    )


@query
def compat_rates(spark, sf):
    return C.compat_rates(_compat(spark, sf), "dataset", "task").select(
        "dataset", "task", "tp", "fp", "fn", "tn", _round("tpr"), _round("fpr")
    )


@query
def scorer_diff(spark, sf):
    """Strict against defensive counts of the same submissions."""
    return _compared(spark, sf)


@query
def scorer_diff_totals(spark, sf):
    return C.mismatch_totals(_compared(spark, sf))


# --- evaluation ---------------------------------------------------------------------------------


def _rows(spark, sf, **kw) -> DataFrame:
    return MT.unit_rows(B.trials(spark, sf), B.trial_units(spark, sf), **kw)


@query
def unit_rows(spark, sf):
    return _rows(spark, sf).select(
        "unit_id", "task", "label", "grp", "rep", "positive", "reward", "strict", "valid", "alert", _round("recall"),
        _round("fp_free_recall"), "fp", "n_findings", "termination",
    )


@query
def hier_mean(spark, sf):
    return MT.hierarchical_mean(_rows(spark, sf), "recall", "task").select("task", _round("recall"))


_SCORE = ["P", "N", "false_alert_rate", "ordinary_recall", "validity", "natural_mean_reward"]


@query
def dev_score(spark, sf):
    out = MT.dev_score(_rows(spark, sf))
    return out.select("task", *[_round(c) for c in _SCORE], "n_records", "n_positive_groups", "n_negative_groups")


@query
def overall_d(spark, sf):
    return MT.overall_d(MT.dev_score(_rows(spark, sf))).select(_round("D"), "available_tasks")


@query
def invalid_as_zero(spark, sf):
    out = MT.dev_score(_rows(spark, sf, invalid_as_zero=True))
    return out.select("task", _round("P"), _round("ordinary_recall"))


@query
def termination_histogram(spark, sf):
    return MT.termination_histogram(_rows(spark, sf))


@query
def trivial_policy(spark, sf):
    return MT.trivial_policy(B.trial_units(spark, sf))


@query
def trivial_policy_d(spark, sf):
    return MT.overall_d(MT.trivial_policy(B.trial_units(spark, sf)))


@query
def eligible_steps(spark, sf):
    out = SE.eligible_steps(B.evaluations(spark, sf))
    return out.select("arm", "step", "D", "eligible", F.array_join("reasons", "; ").alias("reasons"))


@query
def select_step(spark, sf):
    return SE.select_step(B.evaluations(spark, sf))


@query
def early_stop(spark, sf):
    return SE.early_stop(B.evaluations(spark, sf))


# --- sampling -----------------------------------------------------------------------------------


@query
def unit_probability(spark, sf):
    out = SA.unit_probabilities(B.trial_units(spark, sf))
    return out.select("unit_id", "task", "cls", "kind", _round("probability", 15))


def _draws(spark, sf) -> DataFrame:
    return SA.draw_units(B.trial_units(spark, sf), N_DRAWS, 10_007)


@query
def draw_rows(spark, sf):
    """One named row per draw, with what the drawn unit shows."""
    shown = B.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("unit_id"), F.col("o_orderpriority").alias("slice"))
    return SA.materialise_draws(_draws(spark, sf), shown, N_DRAWS).select("draw_index", "name", "unit_id", "slice")


@query
def draws(spark, sf):
    return _draws(spark, sf).select(
        "draw_index", "unit_id", "task", "cls", "kind", "group_id", "representation", _round("probability", 15)
    )


@query
def exposure(spark, sf):
    return SA.exposure_by_task(_draws(spark, sf)).select("task", "n_drawn", _round("frequency"))


@query
def exposure_class(spark, sf):
    return SA.exposure_by_class(_draws(spark, sf)).select("task", "cls", "n_drawn", _round("frequency"))


@query
def exposure_group(spark, sf):
    return SA.exposure_by_group(_draws(spark, sf))


@query
def exposure_totals(spark, sf):
    return SA.exposure_totals(_draws(spark, sf))


@query
def groups_never_drawn(spark, sf):
    return SA.groups_never_drawn(_draws(spark, sf), B.trial_units(spark, sf))


@query
def missing_strata(spark, sf):
    """Strata of the units that have no trial at all."""
    units = B.trial_units(spark, sf)
    tried = B.trials(spark, sf).select(F.substring_index("task_name", "/", -1).alias("unit_id")).distinct()
    return SA.missing_strata(units.join(tried, "unit_id", "left_anti"))


# --- screening ----------------------------------------------------------------------------------


@query
def keyword_screen(spark, sf):
    out = SC.keyword_screen(B.pool(spark, sf))
    return out.select("item_id", "screen", _joined("exclude_terms").alias("exclude_terms"), _joined("review_terms").alias("review_terms"))


@query
def screen_totals(spark, sf):
    return SC.screen_totals(SC.keyword_screen(B.pool(spark, sf)))


@query
def leakage_scan(spark, sf):
    """Forbidden patterns in what a unit shows: its file name, scenario and text."""
    files = B.doc_files(spark, sf)
    visible = files.select(
        F.col("rel_path").alias("key"), F.concat_ws("\n", "scenario_key", "text").alias("text")
    )
    return SC.leakage_scan(visible)


@query
def changed_slices(spark, sf):
    """Files whose text would change if its numbers were masked."""
    files = B.doc_files(spark, sf)
    expected = files.select(F.col("rel_path").alias("unit_id"), "sha256")
    visible = files.select(F.col("rel_path").alias("unit_id"), F.sha2(F.regexp_replace("text", r"\d", "#"), 256).alias("sha256"))
    return SC.changed_slices(visible, expected)


# --- repeated attempts and intervals ------------------------------------------------------------


@query
def pass_at_k(spark, sf):
    return U.pass_at_k(_rows(spark, sf)).select("unit_id", "n_attempts", "n_successes", _round("pass_at_1"), "pass_at_k")


@query
def solve_distribution(spark, sf):
    return U.solve_distribution(U.pass_at_k(_rows(spark, sf)))


@query
def scenario_attempts(spark, sf):
    chain = LogChain(spark, sf)
    graded = M.grade(chain.payloads, chain.units, chain.unit_targets, chain.lines)
    rows = graded.join(chain.units.select("unit_id", "scenario_key", "representation"), "unit_id").select(
        F.col("scenario_key").alias("scenario"), "representation", "attempt_id",
        F.col("label").isin("positive", "attack").alias("positive"), F.coalesce("tp", F.lit(0)).alias("tp"),
        (F.coalesce("n_high", F.lit(0)) > 0).alias("alert"), F.col("schema_valid").alias("valid"),
    )
    return U.scenario_attempts(rows)


@query
def advantages(spark, sf):
    rows = B.trials(spark, sf).select(
        F.col("task_name").alias("prompt_group"), "attempt_id", F.coalesce("reward.reward", F.lit(0.0)).alias("reward")
    )
    return U.advantages(rows).select("prompt_group", "attempt_id", "reward", _round("advantage"))


@query
def reward_variation(spark, sf):
    rows = B.trials(spark, sf).select(F.col("task_name").alias("prompt_group"), F.coalesce("reward.reward", F.lit(0.0)).alias("reward"))
    return U.reward_variation(rows).select("n_groups", "n_flat", _round("varied_share"), "too_sparse")


@query
def cell_metrics(spark, sf):
    rows = MT.unit_rows(B.trials(spark, sf), B.trial_units(spark, sf)).withColumn("tp", F.col("recall").isNotNull().cast("long"))
    out = U.cell_metrics(rows, "task", "rep")
    names = ("sensitivity", "specificity", "no_report_rate", "precision", "balanced_accuracy")
    return out.select("task", "rep", "level", "n_rows", "tp", "fp", *[_round(c) for c in names])


@query
def failure_sensitivity(spark, sf):
    rows = _rows(spark, sf).withColumn("resolved", F.col("termination") == "graded")
    return U.failure_sensitivity(rows, "task").select(
        "task", "n_attempts", "n_unresolved", _round("success_all"), _round("success_resolved")
    )


@query
def bootstrap_ci(spark, sf):
    """Difference in success between the two views, resampling the customer groups of each nation."""
    rows = _rows(spark, sf)
    customers = B.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("grp"), F.concat_ws("/", "c_nationkey", "c_mktsegment").alias("cohort")
    )
    means = rows.join(customers, "grp").groupBy(F.col("cohort").alias("grp")).agg(
        F.avg(F.when(F.col("rep") == "edge", F.col("strict"))).alias("value_a"),
        F.avg(F.when(F.col("rep") == "raw", F.col("strict"))).alias("value_b"),
    )
    out = U.paired_bootstrap(means, N_BOOTSTRAP, seed=11)
    return out.select(
        _round("observed"), "n_groups", _round("low"), _round("high"), "n_missing", "n_draws", _round("missing_share")
    )


@query
def bootstrap_groups(spark, sf):
    """The same difference, resampling the customers themselves."""
    means = _rows(spark, sf).groupBy("grp").agg(
        F.avg(F.when(F.col("rep") == "edge", F.col("strict"))).alias("value_a"),
        F.avg(F.when(F.col("rep") == "raw", F.col("strict"))).alias("value_b"),
    )
    out = U.grouped_bootstrap(cut_lineage(means), N_BOOTSTRAP, seed=11)
    return out.select(
        _round("observed"), "n_groups", _round("low"), _round("high"), "n_missing", "n_draws", _round("missing_share")
    )


@query
def near_dups(spark, sf):
    return ND.near_duplicate_links(B.doc_files(spark, sf))


@query
def families(spark, sf):
    return ND.families(B.doc_files(spark, sf)).select("rel_path", "family")


@query
def family_representatives(spark, sf):
    return ND.family_representatives(ND.families(B.doc_files(spark, sf)))


@query
def similar_contents(spark, sf):
    """Pairs of contents whose runs of five words have a similarity of 0.8 or more."""
    texts = B.doc_texts(spark, sf)
    sets = partial(ND.run_sets, texts, common=ND.common_runs(texts))
    pairs = ND.similar_contents(sets(copies=True), again=lambda wanted: sets(only=wanted))[1]
    return pairs.select("a", "b", "n_shared", "n_all", _round("similarity"))


@query
def similar_families(spark, sf):
    return ND.similar_families(B.doc_files(spark, sf), texts=B.doc_texts(spark, sf)).select("rel_path", "family")


# --- metered usage ------------------------------------------------------------------------------


@query
def cap_breaches(spark, sf):
    """First event at which the spend of an event type reaches a cap."""
    usage = B.table(spark, sf, "events").select(
        F.col("event_type").alias("phase"), "ts", "event_id", (F.col("value") * 60).alias("seconds"), F.lit(18.36).alias("rate_per_hour")
    )
    out = spend.cap_breaches(usage, caps={"click": 40.0, "view": 60.0, "error": 1e9}, total=80.0)
    return out.select("phase", "event_id", _round("usd", 6), "cap")


# --- streams ------------------------------------------------------------------------------------


@query
def stream_hit_counts(spark, sf):
    """Technique hits of each closed hour, from the events read as a stream."""
    hits = log_stream.indicator_hits(B.streamed_lines(B.event_stream(spark, sf)))
    out = sinks.drain(log_stream.hit_counts(hits), "append")
    return out.select(F.substring(_text("window_start"), 1, 19).alias("window_start"), "technique", "n_hits")


@query
def stream_spend(spark, sf):
    """Running spend per phase, from the events read as a stream."""
    usage = B.event_stream(spark, sf).select(
        F.col("event_type").alias("phase"), (F.col("value") * 60).alias("seconds"), F.lit(18.36).alias("rate_per_hour")
    )
    return sinks.drain(spend.running_spend(usage)).select("phase", _round("usd", 6), "over")


def _arriving(spark, rows: DataFrame, part: str, n_parts: int) -> DataFrame:
    """All ``rows`` as a stream of ``n_parts`` batches: a row comes in the batch that ``part`` names."""
    stored = f"{shared_dir(spark).rstrip('/')}/tracewright-arriving-{uuid.uuid4().hex}"
    rows = cut_lineage(rows.withColumn("_part", F.expr(part)))
    for k in range(n_parts):
        rows.filter(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(stored)
    schema = rows.drop("_part").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(stored)


@query
def stream_early_stop(spark, sf):
    """Arms that stopped improving, from evaluations that come in five batches, some steps a batch late."""
    stream = _arriving(spark, B.evaluations(spark, sf), "least(greatest((step + 36) div 24, 0) + if(step % 13 = 5, 1, 0), 4)", 5)
    return sinks.drain(ES.early_stop_alerts(stream), "update", latest_by="arm").select("arm", "stop_step", "n_evaluations")


@query
def stream_cap_breaches(spark, sf):
    """The usage at which each cap falls, from events that come in four batches, a seventh of them half a day late."""
    usage = B.table(spark, sf, "events").select(
        F.col("event_type").alias("phase"), "ts", "event_id", (F.col("value") * 60).alias("seconds"), F.lit(18.36).alias("rate_per_hour")
    )
    part = "least((day(ts + if(event_id % 7 = 0, interval 12 hours, interval 0 hours)) - 1) div 8, 3)"
    stream = _arriving(spark, usage, part, 4)
    events = spend.breach_events(stream, {"click": 40.0, "view": 60.0, "error": 1e9}, 80.0, "1 day")
    return sinks.drain(events, "append").select("phase", "event_id", _round("usd", 6), "cap")
