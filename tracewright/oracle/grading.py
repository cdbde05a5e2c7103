"""Submissions, validation, matching and scoring in DuckDB SQL."""

from __future__ import annotations

from ..functions.timestamps import FORMAT_PATTERNS
from ..lookups import FINDING_FIELD, OPTIONAL_KEYS, PAYLOAD_ERRORS, REQUIRED_KEYS, VERDICTS
from .views import minute, parse, precision, quote, second

_ITEM = r"""CASE WHEN attempt_id = 2 AND k = 17 THEN '17' ELSE '{' ||
    CASE WHEN attempt_id = 2 AND k = 11 THEN '' ELSE '"timestamp":"' || CASE WHEN attempt_id = 2 AND k = 16 THEN 'yesterday' ELSE time_text END || '",' END ||
    '"' || field || '":"' || CASE WHEN attempt_id = 2 AND k = 12 THEN 'a.example, b.example' WHEN attempt_id = 1 AND k % 10 = 7 THEN '10.9.9.9' ELSE entity END || '",' ||
    '"source_lines":[' || CASE WHEN attempt_id = 2 AND k = 13 THEN '' WHEN attempt_id = 2 AND k = 14 THEN local_no || ',' || local_no
      WHEN attempt_id = 2 AND k = 15 THEN local_no || '.5' WHEN attempt_id = 1 AND k % 10 = 6 THEN (local_no + 1)::varchar ELSE local_no::varchar END || '],' ||
    CASE WHEN attempt_id = 2 AND k = 8 THEN '"note":"x",' WHEN k = 21 THEN '"pid":21,' ELSE '' END ||
    '"verdict":"' || CASE WHEN attempt_id = 2 AND k = 9 THEN 'high_suspicious' WHEN k % 9 = 4 THEN 'MEDIUM_SUSPICIOUS' WHEN k % 9 = 5 THEN 'LOW_SUSPICIOUS'
      ELSE 'HIGH_SUSPICIOUS' END || '"}' END"""

_KINDS = ("(task = 'lm' AND event_type = 'purchase') OR (task = 'persistence' AND event_type = 'error') "
          "OR (task = 'exfiltration' AND event_type = 'signup')")
_FIELD = "CASE task WHEN 'lm' THEN 'external_host' WHEN 'persistence' THEN 'technique' ELSE 'file_path' END"


def _list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def _by_task(table) -> str:
    return "CASE task " + " ".join(f"WHEN '{t}' THEN {_list(v)}" for t, v in table.items()) + " END"


_ALL_KEYS = {t: REQUIRED_KEYS[t] + OPTIONAL_KEYS[t] for t in REQUIRED_KEYS}
_FORMAT = " OR ".join(f"regexp_matches(trim(ts_text), {quote(p)})" for p in FORMAT_PATTERNS.values())

# A payload is a list of items; an item is checked key by key.
PAYLOADS = rf"""
unit_events AS (
  SELECT l.rel_path, l.task, l.line_no, l.event_type, l.k, l.time_text, x.unit_id, l.line_no - x.start_line + 1 AS local_no, {_FIELD.replace('task', 'l.task')} AS field,
    CASE l.task WHEN 'lm' THEN host_name WHEN 'exfiltration' THEN replace(path_name, '\', '\\') ELSE 'Create Account' END AS entity
  FROM log_events l JOIN units x ON x.rel_path = l.rel_path AND x.window_index = (l.line_no - 1) // (CASE l.representation WHEN 'edge' THEN 20 ELSE 30 END)
  WHERE l.task <> 'classification'),
tries AS (SELECT unnest([0, 1, 2]) AS attempt_id),
bodies AS (
  SELECT unit_id, attempt_id, string_agg({_ITEM}, ',' ORDER BY line_no) AS body FROM unit_events, tries
  WHERE ({_KINDS}) OR (attempt_id = 1 AND event_type = 'click') GROUP BY ALL),
payloads AS (
  SELECT unit_id, attempt_id, task, n_lines, '[' || CASE WHEN task = 'classification' THEN CASE WHEN attempt_id = 2 AND n_lines % 3 = 0 THEN one || ',' || one ELSE one END
      ELSE coalesce(body, '') END || CASE WHEN attempt_id = 2 AND window_index % 5 = 2 THEN '] x' WHEN attempt_id = 2 AND window_index % 5 = 1 THEN '' ELSE ']' END AS payload
  FROM (SELECT u.unit_id, t.attempt_id, u.task, u.n_lines, u.window_index, b.body,
          '{{"source_lines":[],"verdict":"' || CASE WHEN (u.n_lines + t.attempt_id) % 2 = 0 THEN 'HIGH_SUSPICIOUS' ELSE 'LOW_SUSPICIOUS' END || '"}}' AS one
        FROM units u, tries t LEFT JOIN bodies b ON b.unit_id = u.unit_id AND b.attempt_id = t.attempt_id))
"""

CHECKED = rf"""
parsed AS (
  SELECT *, CASE WHEN json_valid(payload) THEN CASE WHEN json_type(payload) = 'ARRAY' THEN json_extract(payload, '$[*]') END END AS items FROM payloads),
items AS (
  SELECT unit_id, attempt_id, task, n_lines, item, idx, CASE WHEN json_type(item) = 'OBJECT' THEN json_keys(item) END AS keys,
    json_extract_string(item, '$.timestamp') AS ts_text, trim(json_extract_string(item, '$.' || {_FIELD})) AS entity,
    json_extract_string(item, '$.verdict') AS verdict, json_extract(item, '$.source_lines[*]') AS refs,
    json_type(item, '$.timestamp') AS ts_type, json_type(item, '$.source_lines') AS refs_type, json_type(item, '$.' || {_FIELD}) AS entity_type,
    json_type(item, '$.pid') AS pid_type
  FROM (SELECT unit_id, attempt_id, task, n_lines, unnest(items) AS item, unnest(range(len(items))) AS idx FROM parsed WHERE len(items) > 0)),
item_ok AS (
  SELECT *, coalesce(list_has_all(keys, {_by_task(REQUIRED_KEYS)}) AND list_has_all({_by_task(_ALL_KEYS)}, keys)
    AND verdict IN ({', '.join(quote(v) for v in VERDICTS)}) AND refs_type = 'ARRAY' AND len(refs) <= 32
    AND (len(refs) > 0 OR task = 'classification')
    AND len(list_filter(refs, lambda x: json_type(x) NOT IN ('UBIGINT', 'BIGINT'))) = 0
    AND len(list_filter(refs, lambda x: coalesce(try_cast(x AS bigint), 0) NOT BETWEEN 1 AND n_lines)) = 0
    AND len(list_distinct(refs)) = len(refs) AND (pid_type IS NULL OR pid_type IN ('NULL', 'UBIGINT'))
    AND (task = 'classification' OR (ts_type = 'VARCHAR' AND ({_FORMAT}) AND entity_type = 'VARCHAR' AND entity <> ''
      AND NOT regexp_matches(entity, CASE task WHEN 'persistence' THEN '[,;|\n\r\t]' ELSE '[,;|\n\r\t]| or | and ' END)
      AND (task <> 'lm' OR regexp_matches(entity, '^[A-Za-z0-9][A-Za-z0-9.:\-\[\]]*$')))), false) AS ok FROM items),
checked AS (
  SELECT p.unit_id, p.attempt_id, p.task, p.n_lines, coalesce(p.items IS NOT NULL AND len(p.items) <= 32
      AND (p.task <> 'classification' OR len(p.items) = 1) AND coalesce(i.all_ok, true), false) AS schema_valid,
    len(p.items) AS n, coalesce(i.high, 0) AS high
  FROM parsed p LEFT JOIN (SELECT unit_id, attempt_id, bool_and(ok) AS all_ok, count(*) FILTER (verdict = 'HIGH_SUSPICIOUS') AS high
    FROM item_ok GROUP BY ALL) i USING (unit_id, attempt_id)),
findings AS (SELECT i.* FROM item_ok i JOIN checked c USING (unit_id, attempt_id) WHERE c.schema_valid)
"""


_SEPARATORS = "CASE task WHEN 'persistence' THEN '[,;|\\n\\r\\t]' ELSE '[,;|\\n\\r\\t]| or | and ' END"


def _message(key: str, *values: str) -> str:
    """An error text whose open places are SQL values."""
    parts = PAYLOAD_ERRORS[key].split("{}")
    return " || ".join([quote(parts[0]), *[x for v, p in zip(values, parts[1:]) for x in (v, quote(p))]])


# The first error of a payload, in the order in which the rules are read.
ERRORS = rf"""
item_errors AS (
  SELECT unit_id, attempt_id, idx, CASE WHEN json_type(item) <> 'OBJECT' THEN {_message('object')}
    WHEN NOT list_has_all(keys, {_by_task(REQUIRED_KEYS)}) THEN {_message('keys_missing')} WHEN NOT list_has_all({_by_task(_ALL_KEYS)}, keys) THEN {_message('keys_unknown')}
    WHEN verdict IS NULL OR verdict NOT IN ({', '.join(quote(v) for v in VERDICTS)}) THEN {_message('verdict')}
    WHEN refs_type <> 'ARRAY' THEN {_message('lines_list')} WHEN len(refs) = 0 AND task <> 'classification' THEN {_message('no_lines')}
    WHEN len(refs) > 32 THEN {_message('many_lines', "'32'")}
    WHEN len(list_filter(refs, lambda x: json_type(x) NOT IN ('UBIGINT', 'BIGINT'))) > 0 THEN {_message('line_integers')}
    WHEN len(list_filter(refs, lambda x: x::bigint NOT BETWEEN 1 AND n_lines)) > 0 THEN {_message('line_outside')}
    WHEN len(list_distinct(refs)) < len(refs) THEN {_message('line_twice')} WHEN pid_type NOT IN ('NULL', 'UBIGINT') THEN {_message('pid')}
    WHEN task = 'classification' THEN NULL WHEN ts_type <> 'VARCHAR' THEN {_message('string', "'timestamp'")} WHEN NOT ({_FORMAT}) THEN {_message('timestamp')}
    WHEN entity_type <> 'VARCHAR' THEN {_message('string', _FIELD)} WHEN entity = '' THEN {_message('entity_empty', _FIELD)}
    WHEN regexp_matches(entity, {_SEPARATORS}) THEN {_message('entity_many', _FIELD)}
    WHEN task = 'lm' AND NOT regexp_matches(entity, '^[A-Za-z0-9][A-Za-z0-9.:\-\[\]]*$') THEN {_message('host')} END AS error
  FROM items),
first_errors AS (
  SELECT p.unit_id, p.attempt_id, CASE WHEN payload = '' THEN {_message('empty')} WHEN NOT json_valid(payload) THEN {_message('json')}
    WHEN p.items IS NULL THEN {_message('top_level')} WHEN len(p.items) > 32 THEN {_message('many_findings', "'32'")}
    WHEN p.task = 'classification' AND len(p.items) <> 1 THEN {_message('one_verdict')} ELSE coalesce('finding ' || i.idx || ' ' || i.error, '') END AS first_error
  FROM parsed p LEFT JOIN (SELECT unit_id, attempt_id, min(idx) AS idx, arg_min(error, idx) AS error FROM item_errors WHERE error IS NOT NULL GROUP BY ALL) i
    USING (unit_id, attempt_id))
"""


def _entity(kind: str, value: str) -> str:
    return f"""CASE {kind} WHEN 'host' THEN rtrim(trim(lower(trim({value})), '[]'), '.')
      WHEN 'technique' THEN trim(regexp_replace(replace(lower({value}), '-', ' '), '\\s+', ' ', 'g'))
      ELSE CASE WHEN os = 'windows' THEN lower(regexp_replace(trim({value}), '\\\\{{2,}}', '\\\\', 'g')) ELSE regexp_replace(trim({value}), '\\\\{{2,}}', '\\\\', 'g') END END"""


_KIND = "CASE task WHEN 'lm' THEN 'host' WHEN 'persistence' THEN 'technique' ELSE 'path' END"

MATCHED = f"""
fnorm AS (
  SELECT *, {_entity('kind', 'entity')} AS ent_norm, CASE prec WHEN 'minute' THEN {minute('wall')} ELSE {second('wall')} END AS ts_norm
  FROM (SELECT f.unit_id, f.attempt_id, f.idx, f.task, f.verdict, f.entity, f.refs, u.rel_path, u.start_line, u.os, {_KIND.replace('task', 'f.task')} AS kind,
    {precision('u.dataset', 'u.task')} AS prec, {parse('trim(f.ts_text)')} AS wall FROM findings f JOIN units u USING (unit_id) WHERE f.task <> 'classification')),
grounded AS (
  SELECT DISTINCT f.unit_id, f.attempt_id, f.idx
  FROM (SELECT *, unnest(refs)::bigint AS ref FROM fnorm) f JOIN timed l ON l.rel_path = f.rel_path AND l.line_no = f.start_line + f.ref - 1
  WHERE f.ts_norm = CASE prec WHEN 'minute' THEN {minute('l.wall')} ELSE {second('l.wall')} END
    AND (kind = 'technique' OR contains(CASE WHEN kind = 'host' OR f.os = 'windows' THEN lower(replace(l.line, '\\\\', '\\')) ELSE replace(l.line, '\\\\', '\\') END, ent_norm))),
ut AS (
  SELECT u.unit_id, u.os, w.target_id, w.status, CASE w.status WHEN 'supported_positive' THEN '0' ELSE '1' END || w.target_id AS target_order, t.aliases, t.entity_kind AS kind
  FROM wt w JOIN units u USING (rel_path, window_index) JOIN tstatus t USING (target_id) WHERE u.task <> 'classification'),
unames AS (
  SELECT DISTINCT unit_id, target_id, status, target_order, stamp AS ts_norm, {_entity('kind', 'alias')} AS ent_norm
  FROM (SELECT * EXCLUDE (aliases), unnest(aliases) AS alias FROM ut) JOIN tstamps USING (target_id)),
fhits AS (
  SELECT unit_id, attempt_id, idx, coalesce(min(target_order) FILTER (status = 'supported_positive'), max(target_order) FILTER (status <> 'supported_positive')) AS hit
  FROM fnorm JOIN unames USING (unit_id, ts_norm, ent_norm) GROUP BY ALL),
outcome0 AS (
  SELECT f.unit_id, f.attempt_id, f.idx, f.verdict, substr(h.hit, 2) AS target_id,
    CASE WHEN f.verdict <> 'HIGH_SUSPICIOUS' THEN 'low_confidence' WHEN f.ts_norm IS NULL THEN 'fp' WHEN g.idx IS NULL THEN 'ungrounded'
      WHEN h.hit IS NULL THEN 'fp' WHEN h.hit LIKE '1%' THEN 'neutral' ELSE 'covers' END AS o
  FROM fnorm f LEFT JOIN grounded g USING (unit_id, attempt_id, idx) LEFT JOIN fhits h USING (unit_id, attempt_id, idx)),
outcomes AS (
  SELECT unit_id, attempt_id, idx AS finding_index, verdict, CASE WHEN o <> 'covers' THEN o
      WHEN row_number() OVER (PARTITION BY unit_id, attempt_id, target_id, o ORDER BY idx) = 1 THEN 'tp' ELSE 'redundant' END AS outcome,
    CASE WHEN o IN ('neutral', 'covers') THEN target_id END AS target_id FROM outcome0),
graded AS (
  SELECT *, CASE WHEN valid AND task <> 'classification' AND label = 'positive' THEN CASE WHEN n_targets = 0 THEN 0.0::double ELSE tp / n_targets / (1 + fp) END
      ELSE strict_success END AS dense_reward
  FROM (SELECT *, CASE WHEN NOT valid THEN 0.0::double WHEN CASE WHEN task = 'classification' THEN (high > 0) = (label = 'attack')
        WHEN label = 'positive' THEN tp = n_targets AND fp = 0 ELSE fp = 0 AND high = 0 END THEN 1.0::double ELSE 0.0::double END AS strict_success
    FROM (SELECT c.unit_id, c.attempt_id, c.task, u.label, u.split, u.scenario_key, u.representation, u.dataset, u.scenario, c.schema_valid AS valid, c.n, c.high,
        CASE WHEN c.schema_valid AND c.task <> 'classification' THEN coalesce(w.n_targets, 0) END AS n_targets,
        CASE WHEN c.schema_valid AND c.task <> 'classification' THEN coalesce(o.tp, 0) END AS tp,
        CASE WHEN c.schema_valid AND c.task <> 'classification' THEN coalesce(o.fp, 0) END AS fp
      FROM checked c JOIN units u USING (unit_id)
      LEFT JOIN (SELECT unit_id, count(*) AS n_targets FROM ut WHERE status = 'supported_positive' GROUP BY 1) w USING (unit_id)
      LEFT JOIN (SELECT unit_id, attempt_id, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome IN ('fp', 'ungrounded')) AS fp
        FROM outcomes GROUP BY ALL) o USING (unit_id, attempt_id))))
"""


def compat(name: str, levels: str) -> str:
    """Scenario counts with the given verdict levels."""
    return f"""
{name}_f AS (
  SELECT f.*, u.dataset, u.scenario, s.label, CASE coalesce({precision('u.dataset', 'u.task')}, 'second') WHEN 'minute' THEN {minute(parse('trim(f.ts_text)'))}
      ELSE {second(parse('trim(f.ts_text)'))} END AS ts_norm
  FROM findings f JOIN units u USING (unit_id) JOIN scen s ON s.dataset = u.dataset AND s.task = u.task AND s.scenario = u.scenario WHERE verdict IN ({levels})),
{name}_h AS (
  SELECT *, label = 'attack' AND EXISTS (SELECT 1 FROM truth t WHERE t.dataset = f.dataset AND t.task = f.task AND t.scenario = f.scenario AND t.g_ts = f.ts_norm
      AND CASE f.task WHEN 'lm' THEN t.g_entity = f.entity ELSE contains(lower(trim(f.entity)), lower(trim(t.g_entity))) END) AS hit
  FROM {name}_f f WHERE task <> 'classification' AND ts_norm IS NOT NULL),
{name} AS (
  SELECT c.dataset, c.task, c.scenario, c.attempt_id, s.label, c.chunks, s.log_lines,
    CASE WHEN c.task = 'classification' THEN CASE s.label WHEN 'attack' THEN (high_chunks > 0)::bigint ELSE 0 END
      WHEN s.label = 'attack' THEN CASE WHEN c.dataset = 'optc' AND c.task = 'lm' THEN found_hosts ELSE (tp_hits > 0)::bigint END ELSE 0 END AS tp,
    CASE WHEN c.task = 'classification' THEN CASE s.label WHEN 'attack' THEN 0 ELSE high_chunks END ELSE misses END AS fp,
    CASE WHEN c.task = 'classification' THEN CASE s.label WHEN 'attack' THEN 1 - (high_chunks > 0)::bigint ELSE 0 END
      WHEN s.label = 'attack' THEN CASE WHEN c.dataset = 'optc' AND c.task = 'lm' THEN n_hosts - met_hosts ELSE 1 - (tp_hits > 0)::bigint END ELSE 0 END AS fn,
    CASE WHEN c.task = 'classification' THEN CASE s.label WHEN 'attack' THEN 0 ELSE chunks - high_chunks END ELSE log_lines - misses END AS tn,
    CASE WHEN c.task = 'classification' THEN CASE s.label WHEN 'attack' THEN (high_chunks > 0)::bigint::double ELSE (chunks - high_chunks) / chunks END END AS accuracy
  FROM (
    SELECT c.*, coalesce(high_chunks, 0) AS high_chunks, coalesce(tp_hits, 0) AS tp_hits, coalesce(misses, 0) AS misses, coalesce(found_hosts, 0) AS found_hosts,
      coalesce(met_hosts, 0) AS met_hosts, coalesce(n_hosts, 0) AS n_hosts
    FROM (SELECT u.dataset, u.task, u.scenario, p.attempt_id, count(*) AS chunks FROM payloads p JOIN units u USING (unit_id) GROUP BY ALL) c
    LEFT JOIN (SELECT dataset, task, scenario, attempt_id, count(DISTINCT unit_id) AS high_chunks FROM {name}_f WHERE task = 'classification' GROUP BY ALL) USING (dataset, task, scenario, attempt_id)
    LEFT JOIN (SELECT dataset, task, scenario, attempt_id, count(*) FILTER (hit) AS tp_hits, count(*) FILTER (NOT hit) AS misses,
        count(DISTINCT entity) FILTER (hit) AS found_hosts,
        count(DISTINCT entity) FILTER (hit AND EXISTS (SELECT 1 FROM truth t WHERE t.dataset = h.dataset AND t.task = h.task AND t.scenario = h.scenario AND t.g_entity = h.entity)) AS met_hosts
      FROM {name}_h h GROUP BY ALL) USING (dataset, task, scenario, attempt_id)
    LEFT JOIN (SELECT dataset, task, scenario, count(DISTINCT g_entity) AS n_hosts FROM truth GROUP BY ALL) USING (dataset, task, scenario)) c
  JOIN scen s ON s.dataset = c.dataset AND s.task = c.task AND s.scenario = c.scenario)"""


COMPAT = """
scen AS (SELECT dataset, task, scenario, min(label) AS label, sum(lines)::bigint AS log_lines FROM log_files GROUP BY ALL),
truth AS (SELECT DISTINCT dataset, task, scenario, stamp AS g_ts, unnest(entities) AS g_entity FROM ann)
"""

__all__ = ["CHECKED", "COMPAT", "FINDING_FIELD", "MATCHED", "PAYLOADS", "compat"]
