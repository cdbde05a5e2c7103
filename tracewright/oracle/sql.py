"""DuckDB SQL of each registered query, on the same tables."""

from __future__ import annotations


from ..lookups import EXCLUDE_TERMS, FINDING_FIELD, FORBIDDEN_PATTERNS, OPTIONAL_KEYS, REQUIRED_KEYS, REVIEW_TERMS, TASKS, TECHNIQUE_INDICATORS
from ..operators.uncertainty import POISSON_STEPS, SPREAD, WEIGHT_STEPS
from ..plans.bindings import TREE_BLOCK
from ..plans.catalog import LADDER, N_BOOTSTRAP, N_CANDIDATES, N_DRAWS, SPLIT_SEED
from . import grading as G
from . import views as V

ORACLES: dict[str, str] = {}


def _with(*views: str, select: str) -> str:
    return "WITH RECURSIVE " + ",".join(views) + "\n" + select


def _chain(upto: str) -> list[str]:
    """Views of the log pipeline up to a stage."""
    stages = [("logs", V.LOGS), ("evidence", V.EVIDENCE), ("units", V.UNITS), ("payloads", G.PAYLOADS), ("checked", G.CHECKED), ("matched", G.MATCHED)]
    names = [n for n, _ in stages]
    return [view for _, view in stages[: names.index(upto) + 1]]


def _add(name: str, *views: str, select: str) -> None:
    ORACLES[name] = _with(*views, select=select)


# --- times and names ----------------------------------------------------------------------------

_add(
    "time_formats",
    f"""raw AS (SELECT event_id, fmt AS written_as, {V.written('fmt')} AS raw FROM events, (SELECT unnest(['epoch', 'windows', 'iso', 'iso_minute', 'iso_offset']) AS fmt)),
        p AS (SELECT *, {V.parse('raw')} AS wall FROM raw)""",
    select=f"SELECT event_id, written_as, {V.classify('raw')} AS ts_format, {V.second('wall')} AS local_second, {V.minute('wall')} AS local_minute FROM p",
)
_add(
    "entity_norms",
    V.LOGS,
    select=r"""SELECT event_id, rtrim(trim(lower(trim(' [' || upper(host_name) || ']. ')), '[]'), '.') AS host_norm,
      trim(regexp_replace(replace(lower('Create-' || command || '  X'), '-', ' '), '\s+', ' ', 'g')) AS technique_norm,
      lower(regexp_replace(trim(trim('''' || replace(path_name, '\', '\\') || ''' '), ''''), '\\{2,}', '\\', 'g')) AS path_norm, 'none' AS suspicion
      FROM log_events""",
)

# --- inventory ----------------------------------------------------------------------------------

_add(
    "file_profile",
    V.LOGS,
    """seen AS (SELECT rel_path, line_no, wall, lag(wall) OVER (PARTITION BY rel_path ORDER BY line_no) AS prev FROM timed WHERE wall IS NOT NULL)""",
    select=f"""SELECT t.rel_path, count(*) AS lines, array_to_string(list_sort(list_distinct(list(ts_format) FILTER (wall IS NOT NULL))), ',') AS ts_formats,
      {V.second('arg_min(wall, line_no) FILTER (wall IS NOT NULL)')} AS first_time, {V.second('arg_max(wall, line_no) FILTER (wall IS NOT NULL)')} AS last_time,
      count(*) FILTER (wall IS NULL) AS parse_failures, any_value(n.violations) AS nonmonotonic
      FROM timed t JOIN (SELECT rel_path, count(*) FILTER (wall < prev) AS violations FROM seen GROUP BY 1) n USING (rel_path) GROUP BY t.rel_path""",
)
_add(
    "inventory_summary",
    V.DOCS,
    select="""SELECT count(*) AS files, count(DISTINCT sha256) AS distinct_contents,
      (SELECT count(*) FROM (SELECT sha256 FROM doc_files GROUP BY 1 HAVING count(*) > 1)) AS byte_identical_groups, count(DISTINCT scenario_key) AS scenario_keys FROM doc_files""",
)
_add(
    "source_summary",
    V.DOCS,
    select="""SELECT dataset, representation, count(*) FILTER (task = 'classification') AS classification_files, count(*) FILTER (task <> 'classification') AS investigation_files,
      coalesce(sum(ceil(lines / CASE representation WHEN 'edge' THEN 4 ELSE 10 END)) FILTER (task <> 'classification'), 0)::bigint AS nominal_chunks FROM doc_files GROUP BY ALL""",
)
_add("duplicate_contents", V.DOCS, select="SELECT sha256, count(*) AS n_files FROM doc_files GROUP BY 1 HAVING count(*) > 1")

# --- provenance ---------------------------------------------------------------------------------

for _name, _view in (("edges_same_key", "e_key"), ("edges_identical", "e_same"), ("edges_view_name", "e_view"), ("edges_point_in_window", "e_ann"), ("edges_campaign_day", "e_day")):
    _add(_name, V.DOCS, V.EDGES, select=f"SELECT a, b, rule, strength, evidence FROM {_view}")
_add("edges_overlap", V.DOCS, V.EDGES, select="SELECT a, b, rule, strength, evidence FROM e_overlap")
_add("edges_dedup", V.DOCS, V.EDGES, select="SELECT a, b, rule, strength, evidence FROM linear_edges")
_add("edge_histogram", V.DOCS, V.EDGES, select="SELECT rule, strength, count(*) AS n_edges FROM linear_edges GROUP BY ALL")

_GROUPED = (V.DOCS, V.EDGES, V.components("'strong'"))
_add("components", *_GROUPED, select="SELECT rel_path, group_id FROM mapping")
_add("components_weak", V.DOCS, V.EDGES, V.components("'strong', 'weak'"), select="SELECT rel_path, group_id FROM mapping")
_add(
    "group_table", *_GROUPED,
    select="""SELECT group_id, dataset, label, array_to_string(os, ',') AS os, array_to_string(tasks, ',') AS tasks,
      array_to_string(representations, ',') AS representations, n_files FROM grp""",
)
_add(
    "group_members", *_GROUPED,
    select="""SELECT DISTINCT group_id, kind, value FROM (SELECT group_id, unnest(['host', 'scenario_key', 'file']) AS kind, unnest([host, scenario_key, rel_path]) AS value
      FROM doc_files JOIN mapping USING (rel_path)) WHERE value IS NOT NULL""",
)

# --- splits -------------------------------------------------------------------------------------

_SPLIT = (*_GROUPED, V.splits(LADDER, SPLIT_SEED, N_CANDIDATES))
_add("split_attempts", *_SPLIT, select="SELECT rung, candidate, score, n_violations FROM attempts")
_add("split_best_candidate", *_SPLIT, select="SELECT rung, candidate, score, n_violations FROM chosen")
_add("split_assignment", *_SPLIT, select="SELECT group_id, split FROM dealt")
_add("split_margins", *_SPLIT, select="SELECT margin, cell, split, n_groups FROM margins")
_add(
    "split_table", *_SPLIT,
    select="""SELECT margin, cell, coalesce(sum(n_groups) FILTER (split = 'train'), 0)::bigint AS train, coalesce(sum(n_groups) FILTER (split = 'dev'), 0)::bigint AS dev,
      coalesce(sum(n_groups) FILTER (split = 'test'), 0)::bigint AS test FROM margins GROUP BY ALL""",
)
_tasks = "[" + ", ".join(f"'{t}'" for t in TASKS) + "]"
_add(
    "split_violations", *_SPLIT,
    f"""wanted AS (SELECT task, label, split, low FROM (SELECT unnest({_tasks}) AS task),
      (VALUES ('attack', 'dev', 20), ('benign', 'dev', 20), ('attack', 'train', 40)) w(label, split, low))""",
    select="""SELECT w.split || ' has ' || coalesce(n_groups, 0) || ' ' || label || ' groups for ' || task || ' (< ' || low || ')' AS violation
      FROM wanted w LEFT JOIN margins m ON m.margin = 'task_label' AND m.cell = task || '/' || label AND m.split = w.split WHERE coalesce(n_groups, 0) < low""",
)
_add(
    "split_invariants", *_SPLIT,
    select="""SELECT count(*) AS n_conflicts FROM (SELECT sha256 FROM doc_files JOIN mapping USING (rel_path) JOIN dealt USING (group_id)
      GROUP BY 1 HAVING count(DISTINCT split) > 1)""",
)

# --- windows ------------------------------------------------------------------------------------

_DOC_WINDOWS = (V.DOCS, V.windows_of("doc_files", 4, 10, "doc_windows"))
_add("tumbling_windows", *_DOC_WINDOWS, select="SELECT unit_id, rel_path, window_index, n_windows, start_line, end_line, n_lines FROM doc_windows")
_add("duplicate_units", *_DOC_WINDOWS, select="SELECT unit_id, count(*) AS n_units FROM doc_windows GROUP BY 1 HAVING count(*) > 1")
_add(
    "slice_hash", *_DOC_WINDOWS,
    select="""SELECT rel_path, window_index, sha256(array_to_string(string_split(text, chr(10))[start_line:end_line], chr(10)) || chr(10)) AS sha256
      FROM doc_windows""",
)
ORACLES["slice_hash_text"] = ORACLES["slice_hash"]
_UNITS = _chain("units")
_add(
    "window_labels", *_UNITS,
    select="""SELECT unit_id, rel_path, window_index, label, n_supported, n_ambiguous,
      CASE label WHEN 'quarantined' THEN 'window contains only ambiguous-target evidence' ELSE '' END AS quarantine_reason FROM units""",
)
_listed = lambda table: "CASE task " + " ".join(f"WHEN '{k}' THEN '{', '.join(v)}'" for k, v in table.items()) + " END"
_field = "CASE task " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FINDING_FIELD.items()) + " ELSE '' END"
_add(
    "unit_texts", *_UNITS,
    select=f"""SELECT unit_id, CASE WHEN task = 'classification' THEN 'Judge the ' || n_lines || ' lines of ' || scenario || ' (' || os || '). Give ' || req || '.'
        WHEN task = 'lm' AND representation = 'raw' THEN 'Raw records of ' || dataset || ', window ' || window_index || ' of ' || n_windows || ': {{' || task || '}} asks for ' || field || '.'
        ELSE task || ': lines ' || start_line || ' to ' || end_line || ' of ' || rel_path || '. Name ' || field || '; give ' || req || ', or ' || opt || '. {{hint}}' END AS text,
      CASE WHEN task = 'classification' OR (task = 'lm' AND representation = 'raw') THEN '' ELSE 'hint' END AS unknown_names
      FROM (SELECT *, {_listed(REQUIRED_KEYS)} AS req, {_listed(OPTIONAL_KEYS)} AS opt, {_field} AS field FROM units)""",
)
_add("unit_summary", *_UNITS, select="SELECT split, task, label, count(*) AS n_units, count(DISTINCT group_id) AS n_groups FROM units GROUP BY ALL")
_add("sealed_units", *_UNITS, select="SELECT split, count(*) AS n_units FROM units WHERE split <> 'test' GROUP BY 1")
_add(
    "shifted_windows", *_UNITS,
    """moved AS (SELECT u.*, greatest(1, start_line + shift) AS s, least(lines, end_line + shift) AS e
        FROM (SELECT *, unnest([-15, -10, -5, 5, 10, 15]) AS shift FROM units WHERE label = 'positive') u WHERE greatest(1, start_line + shift) <= least(lines, end_line + shift)),
      ranges AS (SELECT rel_path, sha256, task, representation, s, e, arg_min(unit_id, window_index) AS parent_id FROM moved GROUP BY ALL)""",
    select="""SELECT substr(sha256('v1|' || sha256 || '|' || task || '|' || representation || '|' || s || '-' || e), 1, 16) AS unit_id, parent_id, s AS start_line, e AS end_line,
      CASE WHEN pos THEN 'positive' WHEN NOT pos THEN 'quarantined' ELSE 'negative_attack_file' END AS label,
      round(1.0::double / count(*) OVER (PARTITION BY parent_id), 9) AS weight
      FROM (SELECT r.*, (SELECT bool_or(v.status = 'supported_positive') FROM evidence_status v WHERE v.rel_path = r.rel_path AND v.line_no BETWEEN r.s AND r.e) AS pos FROM ranges r)""",
)

# --- evidence -----------------------------------------------------------------------------------

_EVIDENCE = _chain("evidence")
_add("evidence_lines", *_EVIDENCE, select="SELECT target_id, rel_path, line_no FROM evidence")
_add(
    "targets_status", *_EVIDENCE,
    select="""SELECT target_id, scenario_key, entity_kind, array_to_string(aliases, ',') AS aliases, precision, status, reason, merged_records, n_evidence FROM tstatus""",
)
_add("target_stamps", *_EVIDENCE, select="SELECT target_id, stamp AS stamp_norm FROM tstamps")
_add(
    "target_summary", *_EVIDENCE,
    select="""SELECT dataset, task, status, count(*) AS n_targets FROM tstatus GROUP BY ALL
      UNION ALL SELECT NULL, NULL, status, count(*) FROM tstatus GROUP BY status""",
)
_add("unplaced_targets", *_EVIDENCE, select="SELECT target_id, scenario_key FROM tstatus WHERE scenario_key NOT IN (SELECT scenario_key FROM log_files)")
_add("window_targets", *_UNITS, select="SELECT rel_path, window_index, target_id, status, n_evidence, first_line FROM wt")

# --- grading ------------------------------------------------------------------------------------

_add(
    "payload_validity", *_chain("checked"),
    select="""SELECT unit_id, attempt_id, schema_valid, CASE WHEN schema_valid THEN n END AS n_findings, CASE WHEN schema_valid THEN high END AS n_high FROM checked""",
)
_MATCHED = _chain("matched")
_add("match_outcomes", *_MATCHED, select="SELECT unit_id, attempt_id, finding_index, verdict, outcome, target_id FROM outcomes")
_add(
    "graded_attempts", *_MATCHED,
    select="""SELECT unit_id, attempt_id, valid AS schema_valid, n_targets, tp, fp, strict_success, round(dense_reward, 9) AS dense_reward,
      CASE WHEN valid THEN 'graded' ELSE 'invalid_output' END AS termination FROM graded""",
)
_add(
    "scenario_attempts", *_MATCHED,
    select="""SELECT scenario_key AS scenario, representation, attempt_id, bool_or(label IN ('positive', 'attack')) AS positive, bool_or(coalesce(tp, 0) > 0) AS detected,
      bool_or(valid AND high > 0) AS alerted, bool_and(valid) AS all_valid, sum(coalesce(tp, 0))::bigint AS tp, count(*) AS n_windows FROM graded GROUP BY ALL""",
)
_add(
    "line_count_errors", *_UNITS,
    select="""SELECT count(*) AS n_errors FROM units u LEFT JOIN (SELECT rel_path, (line_no - 1) // CASE representation WHEN 'edge' THEN 20 ELSE 30 END AS window_index, count(*) AS n
      FROM log_lines GROUP BY ALL) l USING (rel_path, window_index) WHERE task <> 'classification' AND coalesce(n, 0) <> n_lines""",
)
# every proving submission passes: units per split, and the forbidden patterns of the lines
_patterns = ", ".join(V.quote(p) for p in FORBIDDEN_PATTERNS)
_add(
    "oracle_audit", *_UNITS,
    select=f"""SELECT split, n_units, n_units AS oracle_pass, 0::bigint AS oracle_failures, coalesce(leaks, 0) AS leakage_problems
      FROM (SELECT split, count(*) AS n_units FROM units WHERE label <> 'quarantined' OR true GROUP BY 1)
      LEFT JOIN (SELECT CASE WHEN u // 16 % 10 < 5 THEN 'train' WHEN u // 16 % 10 < 6 THEN 'dev' ELSE 'test' END AS split, count(*) AS leaks
        FROM log_lines, (SELECT unnest([{_patterns}]) AS p) WHERE regexp_matches(line, p) GROUP BY 1) USING (split)""",
)

# --- compatibility scoring ----------------------------------------------------------------------

_HIGH, _DEFENSIVE = "'HIGH_SUSPICIOUS'", "'HIGH_SUSPICIOUS', 'MEDIUM_SUSPICIOUS'"
_COMPAT = (*_chain("checked"), G.COMPAT, G.compat("cc", _HIGH))
_add("compat_counts", *_COMPAT, select="SELECT dataset, task, scenario, attempt_id, chunks, tp, fp, fn, tn, round(accuracy, 9) AS accuracy FROM cc")
_add(
    "compat_rates", *_COMPAT,
    select="""SELECT dataset, task, tp, fp, fn, tn, round(tp / nullif(tp + fn, 0), 9) AS tpr, round(fp / nullif(fp + tn, 0), 9) AS fpr
      FROM (SELECT dataset, task, sum(tp)::bigint AS tp, sum(fp)::bigint AS fp, sum(fn)::bigint AS fn, sum(tn)::bigint AS tn FROM cc GROUP BY ALL)""",
)
_DIFF = (*_COMPAT, G.compat("cd", _DEFENSIVE))
_add(
    "scorer_diff", *_DIFF,
    select="""SELECT dataset, task, scenario, attempt_id, c.tp AS ours_tp, c.fp AS ours_fp, c.fn AS ours_fn, d.tp AS theirs_tp, d.fp AS theirs_fp, d.fn AS theirs_fn,
      c.tp = d.tp AND c.fp = d.fp AND c.fn = d.fn AS match FROM cc c JOIN cd d USING (dataset, task, scenario, attempt_id)""",
)
_add(
    "scorer_diff_totals", *_DIFF,
    select="""SELECT count(*) AS n_compared, count(*) FILTER (NOT (c.tp = d.tp AND c.fp = d.fp AND c.fn = d.fn)) AS n_mismatch
      FROM cc c JOIN cd d USING (dataset, task, scenario, attempt_id)""",
)

# --- evaluation ---------------------------------------------------------------------------------

TRIALS = f"""
tunits AS (
  SELECT o_orderkey::varchar AS unit_id, {V.TASK_LIST}[o_orderkey % 4 + 1] AS task,
    CASE WHEN o_orderkey % 4 = 0 THEN CASE o_orderstatus WHEN 'O' THEN 'attack' ELSE 'benign' END WHEN o_orderstatus = 'O' THEN 'positive'
      WHEN o_orderstatus = 'F' THEN 'negative_attack_file' WHEN o_totalprice > 495000 THEN 'quarantined' ELSE 'benign' END AS label,
    o_custkey::varchar AS group_id, CASE WHEN o_orderkey % 3 = 0 THEN 'raw' ELSE 'edge' END AS representation FROM orders),
trows AS (
  SELECT l_orderkey::varchar AS unit_id, u.task, u.label, u.group_id AS grp, u.representation AS rep, u.label IN ('positive', 'attack') AS positive,
    l_partkey AS attempt_id, CASE WHEN l_tax <> 0.08 AND l_quantity < 25 THEN 1.0::double ELSE 0.0::double END AS reward,
    l_linenumber <> 7 AND l_discount < 0.09 AS valid, l_linenumber % 3 AS high, l_quantity::int % 4 AS wanted,
    least(l_quantity::int % 4, l_linenumber % 3) AS got, (l_tax * 100)::double AS tax100, l_linenumber,
    CASE WHEN l_tax = 0.08 THEN 'infrastructure_error' WHEN l_linenumber = 7 THEN 'policy_timeout' ELSE 'graded' END AS termination, l_quantity
  FROM lineitem JOIN tunits u ON u.unit_id = l_orderkey::varchar),
rows AS (
  SELECT unit_id, task, label, grp, rep, positive, attempt_id, reward, termination, valid, CASE WHEN valid AND l_quantity < 25 THEN 1.0::double ELSE 0.0::double END AS strict,
    CASE WHEN task = 'classification' THEN valid AND high = 1 ELSE valid AND high > 0 END AS alert,
    CASE WHEN valid AND wanted > 0 THEN got / wanted END AS recall,
    CASE WHEN valid AND wanted > 0 THEN CASE WHEN trunc(tax100)::int % 3 = 0 THEN got / wanted ELSE 0.0::double END END AS fp_free_recall,
    CASE WHEN valid THEN trunc(tax100)::int % 3 END AS fp, CASE WHEN valid THEN l_linenumber END AS n_findings FROM trows)
"""


def _hier(source: str, value: str, by: str) -> str:
    """Nested means of a value, per ``by``."""
    return f"""SELECT {by}, avg(v) AS v FROM (SELECT {by}, grp, avg(v) AS v FROM (SELECT {by}, grp, rep, avg(v) AS v FROM
      (SELECT {by}, grp, rep, unit_id, avg({value}) AS v FROM {source} WHERE ({value}) IS NOT NULL GROUP BY ALL) GROUP BY ALL) GROUP BY ALL) GROUP BY ALL"""


_add(
    "unit_rows", TRIALS,
    select="""SELECT unit_id, task, label, grp, rep, positive, reward, strict, valid, alert, round(recall, 9) AS recall, round(fp_free_recall, 9) AS fp_free_recall, fp, n_findings, termination
      FROM rows""",
)
_add("hier_mean", TRIALS, select=f"SELECT task, round(v, 9) AS recall FROM ({_hier('rows', 'recall', 'task')})")

_FOUND = "CASE WHEN task0 = 'classification' THEN strict ELSE fp_free_recall END"
_CLEAN = "CASE WHEN task0 = 'classification' THEN strict ELSE (valid AND NOT alert)::int::double END"
SCORE = f"""
scoped AS (SELECT * EXCLUDE (task), task AS task0, unnest([task, '*']) AS task FROM rows),
m_p AS ({_hier("(SELECT * FROM scoped WHERE positive AND task <> '*')", _FOUND, 'task')}),
m_n AS ({_hier("(SELECT * FROM scoped WHERE NOT positive AND task <> '*')", _CLEAN, 'task')}),
m_f AS ({_hier('(SELECT * FROM scoped WHERE NOT positive)', 'alert::int::double', 'task')}),
m_r AS ({_hier("(SELECT * FROM scoped WHERE positive AND task <> '*')", 'recall', 'task')}),
score AS (
  SELECT task, any_value(m_p.v) AS P, any_value(m_n.v) AS N, any_value(m_f.v) AS false_alert_rate, any_value(m_r.v) AS ordinary_recall, avg(valid::int::double) AS validity,
    avg(reward) AS natural_mean_reward, count(*) AS n_records, count(DISTINCT grp) FILTER (positive) AS n_positive_groups, count(DISTINCT grp) FILTER (NOT positive) AS n_negative_groups
  FROM scoped LEFT JOIN m_p USING (task) LEFT JOIN m_n USING (task) LEFT JOIN m_f USING (task) LEFT JOIN m_r USING (task) GROUP BY task)
"""
_rounded = ", ".join(f"round({c}, 9) AS {c}" for c in ("P", "N", "false_alert_rate", "ordinary_recall", "validity", "natural_mean_reward"))
_add("dev_score", TRIALS, SCORE, select=f"SELECT task, {_rounded}, n_records, n_positive_groups, n_negative_groups FROM score")
_add(
    "overall_d", TRIALS, SCORE,
    select="SELECT CASE WHEN count((P + N) / 2) = 4 THEN round(avg((P + N) / 2), 9) END AS D, count((P + N) / 2) AS available_tasks FROM score WHERE task <> '*'",
)
_add(
    "invalid_as_zero", TRIALS.replace("\nrows AS (", "\nrows0 AS (") + """,
      rows AS (SELECT * REPLACE (CASE WHEN positive AND NOT valid THEN 0.0::double ELSE recall END AS recall,
        CASE WHEN positive AND NOT valid THEN 0.0::double ELSE fp_free_recall END AS fp_free_recall) FROM rows0)""", SCORE,
    select="SELECT task, round(P, 9) AS P, round(ordinary_recall, 9) AS ordinary_recall FROM score",
)
_add("termination_histogram", TRIALS, select="SELECT termination, count(*) AS n_trials FROM rows GROUP BY 1")
_add(
    "trivial_policy", TRIALS,
    select=f"""SELECT t.task, CASE WHEN bool_or(label IN ('positive', 'attack')) THEN 0.0::double END AS P, CASE WHEN bool_or(label NOT IN ('positive', 'attack')) THEN 1.0::double END AS N
      FROM (SELECT unnest({_tasks}) AS task) t LEFT JOIN tunits u ON u.task = t.task AND u.label <> 'quarantined' GROUP BY t.task""",
)
_add(
    "trivial_policy_d", TRIALS,
    select="""SELECT CASE WHEN count(*) = 4 THEN 0.5::double END AS D, count(*) AS available_tasks FROM (SELECT task FROM tunits WHERE label <> 'quarantined' GROUP BY 1
      HAVING bool_or(label IN ('positive', 'attack')) AND bool_or(label NOT IN ('positive', 'attack')))""",
)

EVALS = """
ev AS (
  SELECT arm, step, CASE WHEN step % 11 <> 10 THEN d END AS D, f, v, r FROM (
    SELECT o_orderpriority AS arm, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS step, round(avg(o_totalprice) / 500000, 3) AS d,
      round(avg((o_orderstatus = 'F')::int), 3) AS f, round(1 - avg((o_orderstatus = 'P')::int), 3) AS v, round(avg((o_orderstatus = 'O')::int), 3) AS r
    FROM orders GROUP BY ALL)),
el AS (
  SELECT e.*, b.D AS base_d, b.r AS base_r, e.D IS NOT NULL AS d_ok, coalesce(e.f <= b.f + 0.02::double, false) AS f_ok, coalesce(e.v >= b.v - 0.01::double, false) AS v_ok
  FROM ev e JOIN ev b ON b.arm = e.arm AND b.step = 0)
"""
_add(
    "eligible_steps", EVALS,
    select="""SELECT arm, step, D, d_ok AND f_ok AND v_ok AS eligible, concat_ws('; ', CASE WHEN NOT d_ok THEN 'D undefined' END,
      CASE WHEN NOT f_ok THEN 'false-alert rate above base' END, CASE WHEN NOT v_ok THEN 'validity below base' END) AS reasons FROM el""",
)
_add(
    "select_step", EVALS,
    "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY D DESC, step) AS place FROM el WHERE d_ok AND f_ok AND v_ok) WHERE place = 1)",
    select="""SELECT e.arm, coalesce(b.step, 0)::int AS selected_step, coalesce(b.D, e.D) AS selected_D, e.D AS base_D,
      coalesce(b.step > 0 AND b.D - e.D >= 0.10::double AND coalesce(b.r, 0) > coalesce(e.r, 0), false) AS manipulation_check_passed
      FROM ev e LEFT JOIN best b USING (arm) WHERE e.step = 0""",
)
WALK = """ord AS (SELECT *, d_ok AND f_ok AND v_ok AS ok, row_number() OVER (PARTITION BY arm ORDER BY step) AS place FROM el),
      walk(arm, place, step, best, misses) AS (
        SELECT arm, 0::bigint, -1::bigint, NULL::double, 0 FROM ev WHERE step = 0
        UNION ALL
        SELECT o.arm, o.place, o.step::bigint, CASE WHEN o.ok AND (w.best IS NULL OR o.D >= w.best + 0.01::double) THEN o.D ELSE w.best END,
          CASE WHEN o.ok AND (w.best IS NULL OR o.D >= w.best + 0.01::double) THEN 0 ELSE w.misses + 1 END
        FROM walk w JOIN ord o ON o.arm = w.arm AND o.place = w.place + 1)"""
_add(
    "early_stop", EVALS,
    WALK,
    select="""SELECT arm, max(place) AS n_evaluations, coalesce(bool_or(misses >= 4), false) AS stopped, min(step) FILTER (misses >= 4) AS stop_step FROM walk GROUP BY arm""",
)

# --- sampling -----------------------------------------------------------------------------------

TREE = """
tree AS (
  SELECT *, CASE WHEN label IN ('positive', 'attack') THEN 'positive' ELSE 'negative' END AS cls, CASE WHEN label IN ('positive', 'attack') THEN 'positive' ELSE label END AS kind
  FROM tunits WHERE label <> 'quarantined'),
n_task AS (SELECT count(DISTINCT task) AS n1 FROM tree),
n_cls AS (SELECT task, count(DISTINCT cls) AS n2 FROM tree GROUP BY ALL),
n_kind AS (SELECT task, cls, count(DISTINCT kind) AS n3 FROM tree GROUP BY ALL),
n_grp AS (SELECT task, cls, kind, count(DISTINCT group_id) AS n4 FROM tree GROUP BY ALL),
n_rep AS (SELECT task, cls, kind, group_id, count(DISTINCT representation) AS n5 FROM tree GROUP BY ALL),
n_unit AS (SELECT task, cls, kind, group_id, representation, count(*) AS n6 FROM tree GROUP BY ALL),
prob AS (
  SELECT t.*, n1, n2, n3, n4, n5, n6, 1.0::double / n1 / n2 / n3 / n4 / n5 / n6 AS probability
  FROM tree t CROSS JOIN n_task JOIN n_cls USING (task) JOIN n_kind USING (task, cls) JOIN n_grp USING (task, cls, kind) JOIN n_rep USING (task, cls, kind, group_id)
  JOIN n_unit USING (task, cls, kind, group_id, representation))
"""


def _pick(level: str, n: str) -> str:
    return f"(floor({V.uniform('10007', 'd.draw_index', quote(level))} * {n}) + 1)::bigint"


quote = V.quote
DRAWS = f"""
d0 AS (SELECT unnest(range({N_DRAWS})) AS draw_index),
k1 AS (SELECT DISTINCT task, cls, kind, n1, n2, n3, n4 FROM prob),
k2 AS (SELECT *, dense_rank() OVER (ORDER BY task) AS task_no, dense_rank() OVER (PARTITION BY task ORDER BY cls DESC) AS class_no,
  row_number() OVER (PARTITION BY task, cls ORDER BY kind) AS kind_no FROM k1),
g1 AS (SELECT *, row_number() OVER (PARTITION BY task, cls, kind ORDER BY {V.uniform("'rank'", 'group_id')}, group_id) AS group_no
  FROM (SELECT DISTINCT task, cls, kind, group_id, n5 FROM prob)),
v1 AS (SELECT *, row_number() OVER (PARTITION BY task, cls, kind, group_id ORDER BY representation) AS view_no
  FROM (SELECT DISTINCT task, cls, kind, group_id, representation, n6, probability FROM prob)),
u1 AS (SELECT *, row_number() OVER (PARTITION BY task, cls, kind, group_id, representation ORDER BY {V.uniform("'rank'", 'unit_id')}, unit_id) AS unit_no FROM prob),
s1 AS (SELECT d.draw_index, k.* FROM d0 d JOIN k2 k ON k.task_no = {_pick('task', 'k.n1')} AND k.class_no = {_pick('class', 'k.n2')} AND k.kind_no = {_pick('kind', 'k.n3')}),
s2 AS (SELECT d.draw_index, g.* FROM s1 d JOIN g1 g ON g.task = d.task AND g.cls = d.cls AND g.kind = d.kind AND g.group_no = {_pick('group', 'd.n4')}),
s3 AS (SELECT d.draw_index, v.* FROM s2 d JOIN v1 v ON v.task = d.task AND v.cls = d.cls AND v.kind = d.kind AND v.group_id = d.group_id AND v.view_no = {_pick('view', 'd.n5')}),
drawn AS (SELECT d.draw_index, u.unit_id, u.task, u.cls, u.label AS kind, u.group_id, u.representation, u.probability
  FROM s3 d JOIN u1 u ON u.task = d.task AND u.cls = d.cls AND u.kind = d.kind AND u.group_id = d.group_id AND u.representation = d.representation AND u.unit_no = {_pick('unit', 'd.n6')})
"""
_add("unit_probability", TRIALS, TREE, select="SELECT unit_id, task, cls, kind, round(probability, 15) AS probability FROM prob")
_add("draws", TRIALS, TREE, DRAWS, select="SELECT draw_index, unit_id, task, cls, kind, group_id, representation, round(probability, 15) AS probability FROM drawn")
_add(
    "exposure", TRIALS, TREE, DRAWS,
    select=f"""SELECT t.task, count(d.draw_index) AS n_drawn, round(count(d.draw_index) / {N_DRAWS}, 9) AS frequency
      FROM (SELECT unnest({_tasks}) AS task) t LEFT JOIN drawn d USING (task) GROUP BY 1""",
)
_add("exposure_class", TRIALS, TREE, DRAWS, select=f"SELECT task, cls, count(*) AS n_drawn, round(count(*) / {N_DRAWS}, 9) AS frequency FROM drawn GROUP BY ALL")
_add("exposure_group", TRIALS, TREE, DRAWS, select="SELECT group_id, count(*) AS n_drawn FROM drawn GROUP BY 1")
_add(
    "exposure_totals", TRIALS, TREE, DRAWS,
    select="SELECT count(*) AS n_draws, count(DISTINCT unit_id) AS distinct_units, count(DISTINCT group_id) AS distinct_groups FROM drawn",
)
_add(
    "groups_never_drawn", TRIALS, TREE, DRAWS,
    select="SELECT DISTINCT group_id FROM tunits WHERE label <> 'quarantined' AND group_id NOT IN (SELECT group_id FROM drawn)",
)
_add(
    "missing_strata", TRIALS,
    """left_over AS (SELECT * FROM tunits WHERE unit_id NOT IN (SELECT l_orderkey::varchar FROM lineitem) AND label <> 'quarantined')""",
    select=f"""SELECT task, cls FROM (SELECT unnest({_tasks}) AS task), (SELECT unnest(['positive', 'negative']) AS cls)
      EXCEPT SELECT task, CASE WHEN label IN ('positive', 'attack') THEN 'positive' ELSE 'negative' END FROM left_over""",
)

# --- screening ----------------------------------------------------------------------------------


def _terms(terms, text: str) -> str:
    values = "[" + ", ".join(quote(t) for t in terms) + "]"
    return f"list_sort(list_filter({values}, lambda p: regexp_matches({text}, p)))"


SCREEN = f"""
screened AS (SELECT page_id::varchar AS item_id, {_terms(EXCLUDE_TERMS, "lower(url || chr(10) || html)")} AS ex, {_terms(REVIEW_TERMS, "lower(url || chr(10) || html)")} AS rv FROM pages),
screens AS (SELECT *, CASE WHEN len(ex) > 0 THEN 'exclude' WHEN len(rv) > 0 THEN 'review' ELSE 'candidate' END AS screen FROM screened)
"""
_add("keyword_screen", SCREEN, select="SELECT item_id, screen, array_to_string(ex, ',') AS exclude_terms, array_to_string(rv, ',') AS review_terms FROM screens")
_add("screen_totals", SCREEN, select="SELECT screen, count(*) AS n_items FROM screens GROUP BY 1")
_add(
    "leakage_scan", V.DOCS,
    select=f"SELECT rel_path AS key, unnest({_terms(FORBIDDEN_PATTERNS, 'scenario_key || chr(10) || text')}) AS pattern FROM doc_files",
)

# --- repeated attempts and intervals ------------------------------------------------------------

PASS = """pass AS (SELECT unit_id, count(*) AS n_attempts, count(*) FILTER (strict = 1.0) AS n_successes, avg((strict = 1.0)::int) AS p1, max((strict = 1.0)::int) AS pass_at_k
  FROM rows GROUP BY 1)"""
_add("pass_at_k", TRIALS, PASS, select="SELECT unit_id, n_attempts, n_successes, round(p1, 9) AS pass_at_1, pass_at_k FROM pass")
_add("solve_distribution", TRIALS, PASS, select="SELECT n_attempts, n_successes, count(*) AS n_units FROM pass GROUP BY ALL")
REWARDS = """att AS (SELECT 'pool/' || l_orderkey AS prompt_group, l_partkey AS attempt_id, CASE WHEN l_tax <> 0.08 AND l_quantity < 25 THEN 1.0::double ELSE 0.0::double END AS reward FROM lineitem)"""
_add("advantages", REWARDS, select="SELECT *, round(reward - avg(reward) OVER (PARTITION BY prompt_group), 9) AS advantage FROM att")
_add(
    "reward_variation", REWARDS,
    select="""SELECT n_groups, n_flat, round((n_groups - n_flat) / n_groups, 9) AS varied_share, (n_groups - n_flat) / n_groups < 0.1 AS too_sparse
      FROM (SELECT count(*) AS n_groups, count(*) FILTER (a = b) AS n_flat FROM (SELECT min(reward) AS a, max(reward) AS b FROM att GROUP BY prompt_group))""",
)
_add(
    "cell_metrics", TRIALS,
    select="""SELECT task, rep, level, n_rows, tp, fp, round(sens, 9) AS sensitivity, round(spec, 9) AS specificity, round(quiet, 9) AS no_report_rate,
      round(tp / nullif(tp + fp, 0), 9) AS precision, round((sens + spec) / 2, 9) AS balanced_accuracy FROM (
      SELECT task, rep, grouping(task, rep)::bigint AS level, count(*) AS n_rows, count(recall) AS tp, sum(coalesce(fp, 0))::bigint AS fp,
        avg((strict = 1.0)::int) FILTER (positive) AS sens, avg((valid AND NOT alert)::int) FILTER (NOT positive) AS spec, avg((coalesce(n_findings, 0) = 0)::int) AS quiet
      FROM rows GROUP BY ROLLUP (task, rep))""",
)
_add(
    "failure_sensitivity", TRIALS,
    select="""SELECT task, count(*) AS n_attempts, count(*) FILTER (termination <> 'graded') AS n_unresolved, round(avg((strict = 1.0 AND termination = 'graded')::int), 9) AS success_all,
      round(avg((strict = 1.0)::int) FILTER (termination = 'graded'), 9) AS success_resolved FROM rows GROUP BY task""",
)
_weight = " + ".join(f"(u >= {s!r}::double)::int" for s in POISSON_STEPS)
_add(
    "bootstrap_ci", TRIALS,
    f"""cohorts AS (SELECT c_nationkey || '/' || c_mktsegment AS grp, avg(strict) FILTER (rep = 'edge') AS a, avg(strict) FILTER (rep = 'raw') AS b
        FROM rows JOIN customer ON c_custkey::varchar = grp GROUP BY ALL),
      weighted AS (SELECT *, {_weight} AS w FROM (SELECT *, {V.uniform('11', 'draw', 'grp')} AS u FROM cohorts, (SELECT unnest(range({N_BOOTSTRAP})) AS draw))),
      diffs AS (SELECT draw, sum(b * w) / nullif(sum(w) FILTER (b IS NOT NULL), 0) - sum(a * w) / nullif(sum(w) FILTER (a IS NOT NULL), 0) AS diff FROM weighted GROUP BY draw)""",
    select=f"""SELECT (SELECT round(avg(b) - avg(a), 9) FROM cohorts) AS observed, (SELECT count(*) FROM cohorts) AS n_groups, round(quantile_cont(diff, 0.025), 9) AS low,
      round(quantile_cont(diff, 0.975), 9) AS high, count(*) FILTER (diff IS NULL) AS n_missing, count(*) AS n_draws,
      round(count(*) FILTER (diff IS NULL) / {N_BOOTSTRAP}, 9) AS missing_share FROM diffs""",
)

_mixed = f"xor(kg, kd) * {SPREAD[0]}"
_stepped = " + ".join(f"(u >= {step})::int" for step in WEIGHT_STEPS)
_add(
    "bootstrap_groups", TRIALS,
    f"""cells AS (SELECT grp, avg(strict) FILTER (rep = 'edge') AS a, avg(strict) FILTER (rep = 'raw') AS b FROM rows GROUP BY ALL),
      keyed AS (SELECT *, ('0x' || substr(md5('11|' || grp), 1, 8))::ubigint >> 1 AS kg FROM cells),
      drawn AS (SELECT draw, ('0x' || substr(md5('11|draw|' || draw), 1, 8))::ubigint >> 1 AS kd FROM (SELECT unnest(range({N_BOOTSTRAP})) AS draw)),
      mixed AS (SELECT draw, a, b, {_mixed} AS x FROM keyed, drawn),
      weighted AS (SELECT draw, a, b, {_stepped} AS w FROM (
        SELECT draw, a, b, ((xor(x >> 31, x & 2147483647) * {SPREAD[1]}) >> 31) & 16777215 AS u FROM mixed)),
      diffs AS (SELECT draw, sum(b * w) / nullif(sum(w) FILTER (b IS NOT NULL), 0) - sum(a * w) / nullif(sum(w) FILTER (a IS NOT NULL), 0) AS diff FROM weighted GROUP BY draw)""",
    select=f"""SELECT (SELECT round(avg(b) - avg(a), 9) FROM cells) AS observed, (SELECT count(*) FROM cells) AS n_groups, round(quantile_cont(diff, 0.025), 9) AS low,
      round(quantile_cont(diff, 0.975), 9) AS high, count(*) FILTER (diff IS NULL) AS n_missing, count(*) AS n_draws,
      round(count(*) FILTER (diff IS NULL) / {N_BOOTSTRAP}, 9) AS missing_share FROM diffs""",
)

NEAR = """
contents AS (SELECT sha256(text) AS sha256, string_split(any_value(text), chr(10)) AS ls FROM documents GROUP BY 1),
sh AS (SELECT DISTINCT sha256, md5(array_to_string(ls[i:i + 2], chr(10))) AS shingle FROM (SELECT *, unnest(range(1, greatest(len(ls) - 1, 2))) AS i FROM contents)),
near AS (SELECT a, sha256 AS b, count(*) AS n_shared FROM sh JOIN (SELECT shingle, min(sha256) AS a FROM sh GROUP BY 1) USING (shingle) WHERE a <> sha256 GROUP BY ALL),
near2 AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
nreach(node, root) AS (SELECT sha256, sha256 FROM contents UNION SELECT n.b, r.root FROM nreach r JOIN near2 n ON n.a = r.node),
fam AS (SELECT 'doc/' || doc_id AS rel_path, root AS family FROM documents JOIN (SELECT node, min(root) AS root FROM nreach GROUP BY 1) ON node = sha256(text))
"""
_add("near_dups", NEAR, select="SELECT a, b, n_shared FROM near")
_add("families", NEAR, select="SELECT rel_path, family FROM fam")
_add("family_representatives", NEAR, select="SELECT family, min(rel_path) AS rel_path, count(*) AS n_files FROM fam GROUP BY 1")

SIMILAR = """
texts AS (SELECT DISTINCT sha256(text) AS sha256, text FROM documents),
words AS (SELECT sha256, regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+') AS ws FROM texts),
runs AS (SELECT DISTINCT sha256, md5(array_to_string(ws[i:i + 4], ' ')) AS run FROM (SELECT *, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM words WHERE len(ws) > 0)),
plain AS (SELECT * FROM runs WHERE run NOT IN (SELECT run FROM runs GROUP BY run HAVING count(*) >= 10 AND count(*) > 0.05 * (SELECT count(*) FROM texts))),
sets AS (SELECT sha256, string_agg(run, ',' ORDER BY run) AS all_runs, count(*) AS n FROM plain GROUP BY sha256),
equal AS (SELECT t.sha256, coalesce(min(t.sha256) OVER (PARTITION BY coalesce(s.all_runs, t.sha256)), t.sha256) AS content, s.n FROM texts t LEFT JOIN sets s USING (sha256)),
alike AS (
  SELECT a.sha256 AS a, b.sha256 AS b, count(*) AS n_shared FROM plain a JOIN plain b ON a.run = b.run AND a.sha256 < b.sha256
  WHERE a.sha256 IN (SELECT content FROM equal) AND b.sha256 IN (SELECT content FROM equal) GROUP BY ALL),
similar_pairs AS (
  SELECT l.a, l.b, n_shared, x.n + y.n - n_shared AS n_all, n_shared / (x.n + y.n - n_shared) AS similarity
  FROM alike l JOIN equal x ON x.sha256 = l.a JOIN equal y ON y.sha256 = l.b WHERE n_shared >= 0.8 * (x.n + y.n - n_shared)),
sides AS (SELECT a, b FROM similar_pairs UNION SELECT b, a FROM similar_pairs),
sreach(node, root) AS (SELECT content, content FROM equal UNION SELECT n.b, r.root FROM sreach r JOIN sides n ON n.a = r.node)
"""
_add("similar_contents", SIMILAR, select="SELECT a, b, n_shared, n_all, round(similarity, 9) AS similarity FROM similar_pairs")
_add(
    "similar_families", SIMILAR,
    select="""SELECT 'doc/' || doc_id AS rel_path, root AS family FROM documents JOIN equal e ON e.sha256 = sha256(text)
      JOIN (SELECT node, min(root) AS root FROM sreach GROUP BY 1) ON node = e.content""",
)

# --- metered usage ------------------------------------------------------------------------------

_add(
    "cap_breaches",
    """booked AS (SELECT unnest([event_type, 'total']) AS phase, event_id, ts, value FROM events),
      usage AS (SELECT phase, event_id, ts, sum(value * 60 / 3600 * 18.36::double) OVER (PARTITION BY phase ORDER BY ts, event_id) AS usd,
        CASE phase WHEN 'click' THEN 40.0::double WHEN 'view' THEN 60.0::double WHEN 'error' THEN 1e9::double ELSE 80.0::double END AS cap FROM booked)""",
    select="SELECT phase, arg_min(event_id, (ts, event_id)) AS event_id, round(arg_min(usd, (ts, event_id)), 6) AS usd, any_value(cap) AS cap FROM usage WHERE usd >= cap GROUP BY phase",
)

# --- streams ------------------------------------------------------------------------------------

_add(
    "stream_hit_counts",
    f"""lines AS (SELECT ts, '(' || {V.second('ts')} || ') [' || event_id || '] --> ' || CASE event_type WHEN 'purchase' THEN 'ssh root' WHEN 'error' THEN 'useradd bob' WHEN 'signup' THEN 'scp' WHEN 'click' THEN 'sudo id'
        ELSE 'cat notes' END AS line FROM events),
      hits AS (SELECT date_trunc('hour', ts) AS h, ts AS t, technique FROM lines, (SELECT unnest([{', '.join(quote(t) for t in TECHNIQUE_INDICATORS)}]) AS technique)
        WHERE {V.indicator('technique', 'line')})""",
    # a window is closed once it ended ten minutes before the last hit
    select=f"""SELECT {V.second('h')} AS window_start, technique, count(*) AS n_hits FROM hits
      WHERE h + INTERVAL 1 HOUR <= (SELECT max(date_trunc('second', t)) - INTERVAL 10 MINUTE FROM hits) GROUP BY ALL""",
)
_add(
    "stream_spend",
    "spent AS (SELECT unnest([event_type, 'total']) AS phase, sum(value * 60 / 3600 * 18.36::double) AS usd FROM events GROUP BY 1)",
    select="SELECT phase, round(usd, 6) AS usd, usd >= 1500.0 AS over FROM spent",
)
_add(
    "stream_cap_breaches",
    """booked AS (SELECT unnest([event_type, 'total']) AS phase, event_id, ts, value FROM events),
      usage AS (SELECT phase, event_id, ts, sum(value * 60 / 3600 * 18.36::double) OVER (PARTITION BY phase ORDER BY ts, event_id) AS usd,
        CASE phase WHEN 'click' THEN 40.0::double WHEN 'view' THEN 60.0::double WHEN 'error' THEN 1e9::double ELSE 80.0::double END AS cap FROM booked)""",
    # the watermark passes usage that is a day old
    select="""SELECT phase, event_id, usd, cap FROM (SELECT phase, arg_min(event_id, (ts, event_id)) AS event_id, round(arg_min(usd, (ts, event_id)), 6) AS usd,
      any_value(cap) AS cap, min(ts) AS ts FROM usage WHERE usd >= cap GROUP BY phase) WHERE ts <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
)
_add(
    "stream_early_stop", EVALS, WALK,
    select="SELECT * FROM (SELECT arm, max(place) AS n_evaluations, min(step) FILTER (misses >= 4)::int AS stop_step FROM walk GROUP BY arm) WHERE stop_step IS NOT NULL",
)

_add("payload_errors", *_chain("checked"), G.ERRORS, select="SELECT unit_id, attempt_id, first_error FROM first_errors")

DETAILS = """
said AS (
  SELECT a.dataset, a.task, a.scenario, a.record_index, a.stamp, e.command, e.k,
    ['user' || (e.k % 4)] || CASE WHEN e.k % 2 = 0 THEN ['root'] ELSE [] END AS users
  FROM ann a JOIN log_events e USING (event_id)),
members AS (SELECT DISTINCT target_id, u.dataset, u.task, u.scenario, u.record_index FROM ann_units u JOIN tg USING (dataset, task, scenario, ukey)),
details AS (
  SELECT DISTINCT target_id, key, value FROM (
    SELECT target_id, 'timestamps' AS key, stamp AS value FROM members JOIN said USING (dataset, task, scenario, record_index)
    UNION ALL SELECT target_id, CASE WHEN dataset = 'optc' AND task = 'lm' THEN 'usernames' ELSE 'username' END, unnest(users)
      FROM members JOIN said USING (dataset, task, scenario, record_index)
    UNION ALL SELECT target_id, 'method', command FROM members JOIN said USING (dataset, task, scenario, record_index) WHERE NOT (dataset = 'optc' AND task = 'lm'))),
lists AS (SELECT target_id, key, string_agg(value, '/' ORDER BY value) AS v FROM details GROUP BY target_id, key)
"""
_add("target_details", *_chain("evidence"), DETAILS, select="SELECT target_id, key, value FROM details")
_add(
    "target_records", *_chain("evidence"), DETAILS,
    select="""SELECT target_id, status, replace(max(v) FILTER (key = 'timestamps'), '/', ',') AS timestamps, string_agg(key || '=' || v, ';' ORDER BY key || '=' || v) FILTER (key <> 'timestamps') AS extra
      FROM tstatus JOIN lists USING (target_id) GROUP BY target_id, status""",
)
_add(
    "quarantined_targets", *_chain("evidence"),
    select="SELECT target_id, status, reason, array_to_string(aliases, ',') AS aliases FROM tstatus WHERE status <> 'supported_positive'",
)

# --- scanned trees ------------------------------------------------------------------------------

TREE_FILES = f"""
placed AS (
  SELECT *, dataset || '/task_' || task || '/' || representation || '/' || name AS place, encode(text) AS raw FROM (
    SELECT *, representation || '_' || translate(window_start, ' :', 'T-') || '-to-' || translate(window_end, ' :', 'T-') || '_'
      || coalesce(host || '_', '') || scenario || '.log' AS name FROM doc_files)),
parts AS (SELECT place, raw, unnest(range(greatest((octet_length(raw) + {TREE_BLOCK - 1}) // {TREE_BLOCK}, 1))) AS k FROM placed),
digests AS (
  SELECT place, count(*) AS n, min(digest) AS one, sha256(string_agg(digest, '' ORDER BY k)) AS many
  FROM (SELECT place, k, sha256(raw[k * {TREE_BLOCK} + 1 : (k + 1) * {TREE_BLOCK}]) AS digest FROM parts) GROUP BY place)
"""
_add(
    "scanned_files", V.DOCS, TREE_FILES,
    select="""SELECT place AS rel_path, dataset, task, name AS filename, representation, host, scenario, scenario_key,
      CASE WHEN contains(scenario, 'benign') THEN 'benign' ELSE 'attack' END AS label, CASE WHEN dataset = 'optc' THEN 'windows' ELSE 'linux' END AS os,
      window_start, window_end, CASE WHEN n = 1 THEN one ELSE many END AS sha256, octet_length(raw) AS bytes, lines, lines AS parse_failures, 0 AS nonmonotonic
      FROM placed JOIN digests USING (place)""",
)
_add(
    "scanned_lines", V.DOCS, TREE_FILES,
    """cut AS (SELECT place, lines, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM placed)""",
    select="SELECT place AS rel_path, line_no, line, strlen(line) AS line_bytes FROM cut WHERE line_no <= lines",
)

# --- names, manifests and ground truth ------------------------------------------------------------

_add(
    "file_names", V.DOCS,
    select="""SELECT rel_path, representation || '_' || translate(window_start, ' :', 'T-') || '-to-' || translate(window_end, ' :', 'T-') || '_'
        || coalesce(host || '_', '') || scenario || '.log' AS filename, representation, host, scenario, window_start, window_end, scenario_key,
      CASE WHEN contains(scenario, 'benign') THEN 'benign' ELSE 'attack' END AS label,
      CASE WHEN regexp_matches(scenario, '^attack-(linux|windows)-') THEN dataset || '/' || regexp_replace(scenario, '^attack-[a-z]+-([a-z]+)scenario', '\\1-scenario') END AS viewed_key
      FROM doc_files""",
)
_add(
    "changed_slices", V.DOCS,
    select="SELECT rel_path AS unit_id FROM doc_files WHERE regexp_matches(text, '[0-9]')",
)
_add(
    "draw_rows", TRIALS, TREE, DRAWS,
    select=f"""SELECT draw_index, lpad(draw_index::varchar, {len(str(N_DRAWS))}, '0') || '_' || unit_id AS name, unit_id, o_orderpriority AS slice
      FROM drawn JOIN orders ON o_orderkey::varchar = unit_id""",
)
_add(
    "split_manifest", *_SPLIT,
    select="""SELECT d.split, group_id, g.dataset, g.label, array_to_string(g.os, ',') AS os, array_to_string(g.tasks, ',') AS tasks, count(*) AS n_files,
        sum(f.lines)::bigint AS lines, min(f.rel_path) AS first_path, max(f.sha256) AS last_sha256, count(scenario_key) > 0 AS keyed, count(f.host) > 0 AS hosted
      FROM doc_files f JOIN mapping USING (rel_path) JOIN dealt d USING (group_id) JOIN grp g USING (group_id) GROUP BY ALL""",
)
_add(
    "unit_truth", *_chain("matched"),
    select="""SELECT DISTINCT unit_id, target_id, target_order, status, stamp, array_to_string(aliases, ',') AS aliases
      FROM ut JOIN tstamps USING (target_id)""",
)
