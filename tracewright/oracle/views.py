"""The canonical views of ``plans.bindings`` in DuckDB SQL, as common table expressions.

Written against the tables, not against the operators: times are parsed with ``strptime``, windows
with ``row_number``, components with a recursive query.
"""

from __future__ import annotations

from ..functions.timestamps import FORMAT_PATTERNS
from ..lookups import PRECISION, TASKS, TECHNIQUE_INDICATORS

TASK_LIST = "[" + ",".join(f"'{t}'" for t in TASKS) + "]"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def classify(x: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({x}, {quote(p)}) THEN '{name}'" for name, p in FORMAT_PATTERNS.items())
    return f"CASE {cases} END"


def parse(x: str) -> str:
    return f"""CASE {classify(x)}
      WHEN 'epoch' THEN timezone('America/Chicago', to_timestamp(try_cast({x} AS double)))
      WHEN 'windows' THEN try_strptime({x}, '%m/%d/%Y %I:%M:%S %p')
      WHEN 'iso' THEN try_strptime({x}, '%Y-%m-%d %H:%M:%S')
      WHEN 'iso_minute' THEN try_strptime({x}, '%Y-%m-%d %H:%M')
      WHEN 'iso_offset' THEN try_cast(replace(regexp_replace({x}, '[+-]\\d{{2}}:\\d{{2}}$', ''), 'T', ' ') AS timestamp) END"""


def second(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def minute(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M')"


def uniform(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::bigint / 4503599627370496.0)"


def precision(dataset: str, task: str) -> str:
    cases = " ".join(f"WHEN {dataset} = '{d}' AND {task} = '{t}' THEN '{p}'" for (d, t), p in PRECISION.items())
    return f"CASE {cases} END"


def written(fmt: str) -> str:
    return f"""CASE {fmt} WHEN 'epoch' THEN (epoch_us(ts) // 1000000) || '.' || lpad((epoch_us(ts) // 1000 % 1000)::varchar, 3, '0')
      WHEN 'windows' THEN strftime(ts, '%-m/%-d/%Y %-I:%M:%S %p') WHEN 'iso' THEN {second('ts')}
      WHEN 'iso_minute' THEN {minute('ts')} ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.25-05:00' END"""


DOCS = f"""
doc_base AS (
  SELECT d.doc_id, d.text, d.lang, d.n_chars, l.quality, l.toxic,
    CASE WHEN lang = 'en' THEN 'optc' ELSE 'lab' END AS dataset, {TASK_LIST}[doc_id % 4 + 1] AS task,
    CASE WHEN doc_id % 20 < 10 THEN 'edge' ELSE 'raw' END AS representation,
    CASE WHEN lang = 'en' THEN 'h' || lpad((doc_id % 20)::varchar, 3, '0') END AS host,
    CASE WHEN lang IN ('en', 'fr') THEN 'windows' ELSE 'linux' END AS os,
    CASE WHEN coalesce(quality, 0) = 1 AND coalesce(toxic, 1) = 0 THEN 'benign' ELSE 'attack' END AS label,
    TIMESTAMP '2024-01-01' + to_minutes(doc_id * 37 % 5256000) AS started
  FROM documents d LEFT JOIN labels l USING (doc_id)),
doc_files AS (
  SELECT *, scenario_of AS scenario, dataset || '/' || CASE WHEN host IS NULL THEN '' ELSE host || '_' END || scenario_of AS scenario_key
  FROM (SELECT doc_id AS ordinal, 'doc/' || doc_id AS rel_path, doc_id || '.log' AS filename, dataset, task, representation, host, os, label,
    CASE WHEN label = 'benign' THEN 'benign-scenario' WHEN task = 'classification' THEN 'attack-' || os || '-' ||
      CASE lang WHEN 'fr' THEN 'lm' WHEN 'de' THEN 'persistence' ELSE 'exfiltration' END || 'scenario'
      ELSE task || '-scenario' END || (doc_id // 8) AS scenario_of,
    started, started + to_seconds(n_chars) AS ended, {second('started')} AS window_start,
    {second('started + to_seconds(n_chars)')} AS window_end, sha256(text) AS sha256, strlen(text) AS bytes, text, toxic, quality,
    CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END AS lines
    FROM doc_base)),
doc_ann AS (
  SELECT dataset, task, CASE WHEN quality = 0 THEN 'lost-' || scenario ELSE scenario END AS scenario,
    unnest([started + INTERVAL 10 MINUTE, date_trunc('minute', ended - INTERVAL 5 SECOND)]) AS t,
    unnest([{second('started + INTERVAL 10 MINUTE')}, {minute('ended - INTERVAL 5 SECOND')}]) AS stamp
  FROM doc_files WHERE toxic = 1)
"""

EDGES = """
e_key AS (
  SELECT least(hub, rel_path) a, greatest(hub, rel_path) b, 'same_scenario_key' AS rule, 'strong' AS strength, scenario_key AS evidence
  FROM (SELECT *, first_value(rel_path) OVER (PARTITION BY scenario_key ORDER BY ordinal) AS hub FROM doc_files) WHERE hub <> rel_path),
e_same AS (
  SELECT least(hub, rel_path) a, greatest(hub, rel_path) b, 'identical_content' AS rule, 'strong' AS strength, substr(sha256, 1, 16) AS evidence
  FROM (SELECT *, first_value(rel_path) OVER (PARTITION BY sha256 ORDER BY ordinal) AS hub FROM doc_files) WHERE hub <> rel_path),
e_overlap AS (
  SELECT least(x.rel_path, y.rel_path) a, greatest(x.rel_path, y.rel_path) b, 'window_overlap_same_host' AS rule, 'strong' AS strength,
    x.window_start || '..' || x.window_end || ' overlaps ' || y.window_start || '..' || y.window_end AS evidence
  FROM doc_files x JOIN doc_files y ON x.dataset = y.dataset AND x.os = y.os AND x.host IS NOT DISTINCT FROM y.host
    AND x.ordinal < y.ordinal AND x.scenario_key <> y.scenario_key AND x.started <= y.ended AND y.started <= x.ended),
e_view AS (
  SELECT least(v.rel_path, f.rel_path) a, greatest(v.rel_path, f.rel_path) b, 'classification_view_name' AS rule, 'strong' AS strength,
    v.scenario || ' -> ' || f.scenario_key AS evidence
  FROM doc_files v JOIN doc_files f ON f.scenario_key = v.dataset || '/' ||
    regexp_replace(v.scenario, '^.*attack-(?:linux|windows)-([a-z]+)scenario(\\d+)$', '\\1-scenario\\2')
  WHERE v.task = 'classification' AND regexp_matches(v.scenario, 'attack-(?:linux|windows)-([a-z]+)scenario(\\d+)$') AND v.rel_path <> f.rel_path),
homes AS (SELECT dataset, task, scenario, arg_min(os, ordinal) AS os, arg_min(struct_pack(h := host), ordinal).h AS host FROM doc_files GROUP BY ALL),
ann_hits AS (
  SELECT n.dataset, n.task, n.scenario, f.rel_path AS file, f.filename, min(n.stamp) AS stamp, bool_or(h.os IS NULL) AS homeless
  FROM doc_ann n LEFT JOIN homes h USING (dataset, task, scenario)
  JOIN doc_files f ON f.dataset = n.dataset AND f.scenario <> n.scenario AND n.t BETWEEN f.started AND f.ended
    AND (h.os IS NULL OR (h.os = f.os AND h.host IS NOT DISTINCT FROM f.host))
  GROUP BY ALL),
e_ann AS (
  SELECT least(f.rel_path, x.file) a, greatest(f.rel_path, x.file) b, 'annotation_time_inside_window' AS rule, 'strong' AS strength,
    min(x.dataset || '/' || x.scenario || ' ts ' || stamp || ' inside ' || x.filename) AS evidence
  FROM ann_hits x JOIN doc_files f USING (dataset, task, scenario) WHERE NOT homeless AND f.rel_path <> x.file GROUP BY ALL
  UNION ALL
  SELECT file, 'annotation:' || dataset || '/' || scenario, 'annotation_without_file_inside_window', 'note', min(stamp || ' inside ' || filename)
  FROM ann_hits WHERE homeless GROUP BY ALL),
l_overlap AS (
  SELECT least(p.rel_path, f.rel_path) a, greatest(p.rel_path, f.rel_path) b, 'window_overlap_same_host' AS rule, 'strong' AS strength,
    p.window_start || '..' || p.window_end || ' overlaps ' || f.window_start || '..' || f.window_end AS evidence
  FROM (SELECT *, max((ended, rel_path)) OVER (PARTITION BY dataset, os, host ORDER BY started, rel_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
    FROM doc_files) f JOIN doc_files p ON p.rel_path = f.reach[2] WHERE f.reach[1] >= f.started),
firsts AS (SELECT scenario_key, arg_min(rel_path, ordinal) AS rel_path FROM doc_files GROUP BY 1),
l_view AS (
  SELECT e.* FROM e_view e JOIN firsts f ON f.scenario_key = split_part(e.evidence, ' -> ', 2) AND f.rel_path IN (e.a, e.b)),
home_first AS (SELECT dataset, task, scenario, arg_min(rel_path, ordinal) AS hub FROM doc_files GROUP BY ALL),
ann_links AS (
  SELECT x.*, hub AS other FROM ann_hits x JOIN home_first USING (dataset, task, scenario)
  UNION ALL
  SELECT x.*, f.rel_path FROM (SELECT * FROM ann_hits QUALIFY row_number() OVER (PARTITION BY dataset, task, scenario ORDER BY file) = 1) x
  JOIN home_first h USING (dataset, task, scenario) JOIN doc_files f USING (dataset, task, scenario) WHERE f.rel_path <> h.hub),
l_ann AS (
  SELECT least(other, file) a, greatest(other, file) b, 'annotation_time_inside_window' AS rule, 'strong' AS strength,
    dataset || '/' || scenario || ' ts ' || stamp || ' inside ' || filename AS evidence FROM ann_links WHERE other <> file
  UNION ALL
  SELECT * FROM e_ann WHERE strength = 'note'),
day_files AS (
  SELECT *, substr(window_start, 1, 10) AS day, first_value(rel_path) OVER (PARTITION BY substr(window_start, 1, 10), host ORDER BY ordinal) AS hub,
    first_value(rel_path) OVER (PARTITION BY substr(window_start, 1, 10) ORDER BY ordinal) AS top,
    first_value(scenario_key) OVER (PARTITION BY substr(window_start, 1, 10), host ORDER BY ordinal) AS hub_key,
    first_value(scenario_key) OVER (PARTITION BY substr(window_start, 1, 10) ORDER BY ordinal) AS top_key
  FROM doc_files WHERE dataset = 'optc' AND label = 'attack'),
e_day AS (
  SELECT least(hub, rel_path) a, greatest(hub, rel_path) b, 'optc_same_host_same_day' AS rule, 'strong' AS strength, host || ' ' || day AS evidence
  FROM day_files WHERE rel_path <> hub AND scenario_key <> hub_key
  UNION ALL
  SELECT least(top, rel_path), greatest(top, rel_path), 'optc_same_campaign_day', 'weak', day
  FROM day_files WHERE rel_path = hub AND rel_path <> top AND scenario_key <> top_key),
all_edges AS (
  SELECT a, b, rule, strength, min(evidence) AS evidence FROM (
    SELECT * FROM e_key UNION ALL SELECT * FROM e_same UNION ALL SELECT * FROM e_overlap UNION ALL SELECT * FROM e_view
    UNION ALL SELECT * FROM e_ann UNION ALL SELECT * FROM e_day) GROUP BY a, b, rule, strength),
linear_edges AS (
  SELECT a, b, rule, strength, min(evidence) AS evidence FROM (
    SELECT * FROM e_key UNION ALL SELECT * FROM e_same UNION ALL SELECT * FROM l_overlap UNION ALL SELECT * FROM l_view
    UNION ALL SELECT * FROM l_ann UNION ALL SELECT * FROM e_day) GROUP BY a, b, rule, strength)
"""


def components(strengths: str) -> str:
    return f"""
both_ways AS (SELECT a, b FROM all_edges WHERE strength IN ({strengths}) UNION SELECT b, a FROM all_edges WHERE strength IN ({strengths})),
reach(node, root) AS (SELECT rel_path, rel_path FROM doc_files UNION SELECT w.b, r.root FROM reach r JOIN both_ways w ON w.a = r.node),
roots AS (SELECT node AS rel_path, min(root) AS root FROM reach WHERE node LIKE 'doc/%' GROUP BY node),
mapping AS (SELECT rel_path, 'g:' || min(scenario_key) OVER (PARTITION BY root) AS group_id FROM roots JOIN doc_files USING (rel_path)),
grp AS (
  SELECT group_id, arg_min(dataset, ordinal) AS dataset, CASE WHEN min(label) <> max(label) THEN 'mixed' ELSE min(label) END AS label,
    list_sort(list_distinct(list(os))) AS os, list_sort(list_distinct(list(task))) AS tasks,
    list_sort(list_distinct(list(representation))) AS representations, count(*) AS n_files
  FROM doc_files JOIN mapping USING (rel_path) GROUP BY group_id)"""


def splits(ladder, seed: int, n_candidates: int, min_dev: int = 2, min_train: int = 2) -> str:
    rungs = ", ".join(f"({i}, {a!r}::double, {b!r}::double, {c!r}::double)" for i, (a, b, c) in enumerate(ladder))
    draw = lambda k: uniform(str(seed), "rung", "candidate", "stratum", str(k))
    lottery = lambda u, w: (
        f"CASE WHEN {u} * ({w[0]} + {w[1]} + {w[2]}) < {w[0]} THEN 0 WHEN {u} * ({w[0]} + {w[1]} + {w[2]}) < {w[0]} + {w[1]} THEN 1 ELSE 2 END"
    )
    rest = [f"(CASE WHEN one = {j} THEN 0.0::double ELSE w{j} END)" for j in range(3)]
    task_set = ", ".join(f"'{t}'" for t in TASKS)
    return f"""
strata AS (
  SELECT dataset, label, tasks, os, count(*) AS n,
    concat_ws('|', dataset, label, array_to_string(tasks, ','), array_to_string(os, ',')) AS stratum FROM grp GROUP BY dataset, label, tasks, os),
rungs(rung, f0, f1, f2) AS (VALUES {rungs}),
c0 AS (
  SELECT *, floor(f0 * n) AS b0, floor(f1 * n) AS b1, floor(f2 * n) AS b2, f0 * n - floor(f0 * n) AS w0, f1 * n - floor(f1 * n) AS w1,
    f2 * n - floor(f2 * n) AS w2 FROM strata, rungs, (SELECT unnest(range({n_candidates})) AS candidate)),
c1 AS (SELECT *, n - b0 - b1 - b2 AS lft, CASE WHEN n - b0 - b1 - b2 >= 1 THEN {lottery(draw(1), ['w0', 'w1', 'w2'])} END AS one FROM c0),
c2 AS (SELECT *, CASE WHEN lft >= 2 THEN {lottery(draw(2), rest)} END AS two FROM c1),
cand AS (
  SELECT *, {', '.join(f"(b{j} + CASE WHEN one = {j} THEN 1 ELSE 0 END + CASE WHEN two = {j} THEN 1 ELSE 0 END)::bigint AS k{j}" for j in range(3))} FROM c2),
cand_cells AS (
  SELECT rung, candidate, f0, f1, f2, 'dataset' AS margin, dataset AS cell, k0, k1, k2 FROM cand
  UNION ALL SELECT rung, candidate, f0, f1, f2, 'task_label', unnest(tasks) || '/' || CASE WHEN label = 'attack' THEN 'attack' ELSE 'benign' END, k0, k1, k2 FROM cand
  UNION ALL SELECT rung, candidate, f0, f1, f2, 'os', unnest(os), k0, k1, k2 FROM cand),
cand_sums AS (
  SELECT rung, candidate, f0, f1, f2, margin, cell, sum(k0) AS k0, sum(k1) AS k1, sum(k2) AS k2 FROM cand_cells GROUP BY ALL),
scored AS (
  SELECT rung, candidate,
    round(sum(pow(k0 / (k0 + k1 + k2) - f0, 2) + pow(k1 / (k0 + k1 + k2) - f1, 2) + pow(k2 / (k0 + k1 + k2) - f2, 2)), 9) AS score,
    {3 * len(TASKS)} - count(*) FILTER (margin = 'task_label' AND split_part(cell, '/', 1) IN ({task_set}) AND k1 >= {min_dev})
      - count(*) FILTER (margin = 'task_label' AND split_part(cell, '/', 1) IN ({task_set}) AND split_part(cell, '/', 2) = 'attack' AND k0 >= {min_train}) AS n_violations
  FROM cand_sums GROUP BY rung, candidate),
attempts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rung ORDER BY n_violations > 0, n_violations, score, candidate) AS place FROM scored) WHERE place = 1),
chosen AS (
  SELECT * FROM attempts ORDER BY n_violations > 0, CASE WHEN n_violations > 0 THEN -rung ELSE rung END LIMIT 1),
dealt AS (
  SELECT g.group_id, CASE WHEN place <= k0 THEN 'train' WHEN place <= k0 + k1 THEN 'dev' ELSE 'test' END AS split
  FROM (SELECT g.*, c.k0, c.k1, row_number() OVER (PARTITION BY g.dataset, g.label, g.tasks, g.os
          ORDER BY {uniform(str(seed), 'c.rung', 'c.candidate', 'g.group_id')}, g.group_id) AS place
        FROM grp g JOIN cand c ON g.dataset = c.dataset AND g.label = c.label AND g.tasks = c.tasks AND g.os = c.os
        JOIN chosen h ON h.rung = c.rung AND h.candidate = c.candidate) g),
margins AS (
  SELECT margin, cell, split, count(*) AS n_groups FROM (
    SELECT split, 'all' AS margin, 'all' AS cell FROM grp JOIN dealt USING (group_id)
    UNION ALL SELECT split, 'dataset', dataset FROM grp JOIN dealt USING (group_id)
    UNION ALL SELECT split, 'task_label', unnest(tasks) || '/' || CASE WHEN label = 'attack' THEN 'attack' ELSE 'benign' END FROM grp JOIN dealt USING (group_id)
    UNION ALL SELECT split, 'os', unnest(os) FROM grp JOIN dealt USING (group_id)) GROUP BY ALL)"""


def windows_of(files: str, edge: int, raw: int, name: str) -> str:
    size = f"CASE representation WHEN 'edge' THEN {edge} ELSE {raw} END"
    return f"""
{name}0 AS (
  SELECT *, {size} AS size, CASE WHEN task = 'classification' THEN 1 ELSE (lines + {size} - 1) // ({size}) END AS n_windows FROM {files}),
{name} AS (
  SELECT *, substr(sha256('v1|' || sha256 || '|' || task || '|' || representation || '|' || start_line || '-' || end_line), 1, 16) AS unit_id,
    end_line - start_line + 1 AS n_lines
  FROM (SELECT *, CASE WHEN task = 'classification' THEN 1 ELSE window_index * size + 1 END AS start_line,
          CASE WHEN task = 'classification' THEN lines ELSE least((window_index + 1) * size, lines) END AS end_line
        FROM (SELECT *, unnest(range(n_windows)) AS window_index FROM {name}0)))"""


def indicator(technique: str, line: str) -> str:
    cases = " ".join(
        f"WHEN {quote(name)} THEN regexp_matches({line}, {quote('(?i)' + '|'.join(f'(?:{p})' for p in patterns))})"
        for name, patterns in TECHNIQUE_INDICATORS.items()
    )
    return f"CASE {technique} {cases} ELSE false END"


RAW_TIME = (
    "nullif(CASE WHEN representation = 'raw' THEN regexp_extract(line, 'msg=audit\\((\\d+\\.\\d+):\\d+\\)', 1) "
    "ELSE regexp_extract(line, '^\\((.*?)\\)', 1) END, '')"
)

LOGS = f"""
log_files0 AS (
  SELECT user_id AS u, count(*) AS lines, 'user/' || user_id AS rel_path, CASE WHEN user_id % 2 = 0 THEN 'lab' ELSE 'optc' END AS dataset,
    {TASK_LIST}[(user_id // 2) % 4 + 1] AS task, CASE WHEN (user_id // 8) % 2 = 1 THEN 'raw' ELSE 'edge' END AS representation,
    CASE WHEN (user_id // 8) % 2 = 1 THEN 'epoch' ELSE ['windows', 'iso', 'iso_minute', 'iso_offset'][(user_id // 16) % 4 + 1] END AS fmt,
    CASE WHEN (user_id // 16) % 5 = 0 THEN 'benign' ELSE 'attack' END AS label,
    CASE WHEN user_id % 2 = 1 THEN 'h' || lpad(((user_id // 16) % 1000)::varchar, 3, '0') END AS host, sha256('user/' || user_id) AS sha256
  FROM events GROUP BY user_id),
log_files AS (
  SELECT *, dataset || '/' || CASE WHEN host IS NULL THEN '' ELSE host || '_' END || scenario AS scenario_key
  FROM (SELECT *, CASE WHEN dataset = 'optc' OR fmt = 'windows' THEN 'windows' ELSE 'linux' END AS os,
    CASE WHEN label = 'benign' THEN 'benign' ELSE task END || '-scenario' || (u // 16) AS scenario FROM log_files0)),
log_events AS (
  SELECT e.event_id, e.event_type, regexp_extract(e.props, '([0-9]+)', 1)::int AS k, f.*, {written('fmt')} AS time_text,
    row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id + CASE WHEN e.event_id % 7 = 0 THEN 400 ELSE 0 END, e.event_id) AS line_no,
    CASE e.event_type WHEN 'purchase' THEN 'ssh root' WHEN 'error' THEN 'useradd bob' WHEN 'signup' THEN 'scp' WHEN 'click' THEN 'sudo id' ELSE 'cat notes' END AS command,
    CASE WHEN regexp_extract(e.props, '([0-9]+)', 1)::int % 10 = 2 THEN '224.0.0.5'
      ELSE '10.' || (u % 256) || '.' || (regexp_extract(e.props, '([0-9]+)', 1)::int % 8) || '.7' END AS host_name,
    'C:\\data\\u' || u || '\\f' || regexp_extract(e.props, '([0-9]+)', 1)::int || '.txt' AS path_name
  FROM events e JOIN log_files f ON f.u = e.user_id),
log_lines AS (
  SELECT *, CASE WHEN event_type = 'view' AND k < 5 THEN '' WHEN k = 5 THEN CASE representation WHEN 'raw' THEN 'msg=audit(123.4:1) ' ELSE '(2024-13-01 00:00:00) ' END
      WHEN representation = 'raw' THEN 'type=SYSCALL msg=audit(' || time_text || ':' || event_id || ') ' ELSE '(' || time_text || ') ' END
    || '[' || event_id || '] --> ' || command || ' --> addr=' || host_name || ' path=' || replace(path_name, '\\', '\\\\') AS line FROM log_events),
timed AS (
  SELECT *, {classify('raw_time')} AS ts_format, {parse('raw_time')} AS wall FROM (SELECT *, {RAW_TIME} AS raw_time FROM log_lines))
"""

EVIDENCE = f"""
ann0 AS (
  SELECT event_id, dataset, task, CASE WHEN k % 10 = 3 THEN 'lost-scenario' ELSE scenario END AS scenario,
    date_trunc('second', {parse('time_text')}) + CASE WHEN k % 10 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS t,
    CASE WHEN k % 10 = 1 THEN ['no value'] WHEN task = 'lm' THEN [host_name, 'host' || u || '.example'] WHEN task = 'exfiltration' THEN [path_name]
      WHEN k % 10 = 4 THEN ['Account Creation'] WHEN k % 10 = 5 THEN ['Create Account', 'Valid Accounts'] ELSE ['Create Account'] END AS entities
  FROM log_events WHERE label = 'attack' AND ((task = 'lm' AND event_type = 'purchase') OR (task = 'persistence' AND event_type = 'error')
    OR (task = 'exfiltration' AND event_type = 'signup'))),
ann AS (
  SELECT *, CASE WHEN dataset = 'lab' AND task <> 'lm' THEN {minute('t')} ELSE {second('t')} END AS stamp,
    row_number() OVER (PARTITION BY dataset, task, scenario ORDER BY event_id) - 1 AS record_index FROM ann0),
ann_units AS (
  SELECT dataset, task, scenario, record_index, stamp, 'host:' || entities[1] AS ukey, 0 AS pos, [entities[1]] AS names FROM ann WHERE dataset = 'optc' AND task = 'lm'
  UNION ALL SELECT dataset, task, scenario, record_index, stamp, lpad(record_index::varchar, 12, '0') || '#' || i, i, [entities[i + 1]]
    FROM (SELECT *, unnest(range(len(entities))) AS i FROM ann WHERE task = 'persistence')
  UNION ALL SELECT dataset, task, scenario, record_index, stamp, lpad(record_index::varchar, 12, '0') || '#0', 0, entities
    FROM ann WHERE NOT (dataset = 'optc' AND task = 'lm') AND task <> 'persistence'),
tg AS (
  SELECT *, dataset || ':' || task || ':' || scenario || ':' || (row_number() OVER (PARTITION BY dataset, task, scenario ORDER BY record_index, pos, ukey) - 1) AS target_id,
    list_filter(list_transform(names, lambda a: trim(a)), lambda a: a <> '' AND lower(a) <> 'no value') AS aliases,
    CASE task WHEN 'lm' THEN 'host' WHEN 'persistence' THEN 'technique' ELSE 'path' END AS entity_kind, {precision('dataset', 'task')} AS precision
  FROM (SELECT dataset, task, scenario, ukey, min(record_index) AS record_index, min(pos) AS pos, min(names) AS names, count(*) AS merged_records
        FROM ann_units GROUP BY ALL)),
tstamps AS (SELECT DISTINCT target_id, stamp FROM ann_units JOIN tg USING (dataset, task, scenario, ukey)),
evidence AS (
  SELECT DISTINCT target_id, l.rel_path, l.line_no
  FROM (SELECT target_id, dataset, task, scenario, precision, entity_kind, stamp, unnest(aliases) AS alias FROM tg JOIN tstamps USING (target_id)) p
  JOIN timed l ON l.dataset = p.dataset AND l.task = p.task AND l.scenario = p.scenario
    AND p.stamp = CASE p.precision WHEN 'minute' THEN {minute('l.wall')} ELSE {second('l.wall')} END
  WHERE CASE entity_kind WHEN 'technique' THEN {indicator('alias', 'line')}
    ELSE contains(replace(lower(line), '\\\\', '\\'), lower(alias)) END),
tstatus AS (
  SELECT t.*, coalesce(p.scenario_key, t.dataset || '/' || t.scenario) AS scenario_key, coalesce(n, 0) AS n_evidence,
    CASE WHEN entity_kind = 'technique' AND len(aliases) > 0 AND aliases[1] NOT IN ('Create Account', 'Valid Accounts') THEN 'ambiguous'
      WHEN len(aliases) = 0 THEN 'ambiguous' WHEN entity_kind = 'host' AND aliases[1] LIKE '224.%' THEN 'ambiguous'
      WHEN p.scenario_key IS NULL THEN 'unsupported' WHEN n > 0 THEN 'supported_positive' ELSE 'unsupported' END AS status,
    CASE WHEN entity_kind = 'technique' AND len(aliases) > 0 AND aliases[1] NOT IN ('Create Account', 'Valid Accounts')
        THEN 'technique ''' || aliases[1] || ''' not in canonical list'
      WHEN len(aliases) = 0 THEN 'annotation has no concrete entity (placeholder ''no value'')'
      WHEN entity_kind = 'host' AND aliases[1] LIKE '224.%' THEN 'multicast destination annotated as lateral-movement host'
      WHEN p.scenario_key IS NULL THEN 'no scenario file for this annotation in data/input'
      WHEN n > 0 THEN 'entity and timestamp found in log records' ELSE 'no record matches annotated time and entity' END AS reason
  FROM tg t LEFT JOIN (SELECT dataset, task, scenario, arg_min(scenario_key, u) AS scenario_key FROM log_files GROUP BY ALL) p USING (dataset, task, scenario)
  LEFT JOIN (SELECT target_id, count(*) AS n FROM evidence GROUP BY 1) c USING (target_id))
"""

UNITS = windows_of("log_files", 20, 30, "log_windows") + """,
evidence_status AS (SELECT e.*, s.status FROM evidence e JOIN tstatus s USING (target_id)),
wt AS (
  SELECT rel_path, (line_no - 1) // (CASE representation WHEN 'edge' THEN 20 ELSE 30 END) AS window_index, target_id, status,
    count(*) AS n_evidence, min(line_no) AS first_line
  FROM evidence_status JOIN (SELECT rel_path, representation FROM log_files WHERE task <> 'classification') f USING (rel_path) GROUP BY ALL),
units AS (
  SELECT * EXCLUDE (label), label AS file_label, 'g:' || scenario_key AS group_id,
    CASE WHEN u // 16 % 10 < 5 THEN 'train' WHEN u // 16 % 10 < 6 THEN 'dev' ELSE 'test' END AS split,
    CASE WHEN task = 'classification' THEN label WHEN label = 'benign' THEN 'benign' WHEN n_supported > 0 THEN 'positive'
      WHEN n_ambiguous > 0 THEN 'quarantined' ELSE 'negative_attack_file' END AS label
  FROM (SELECT w.*, coalesce(n_supported, 0) AS n_supported, coalesce(n_ambiguous, 0) AS n_ambiguous FROM log_windows w
    LEFT JOIN (SELECT rel_path, window_index, count(*) FILTER (status = 'supported_positive') AS n_supported,
      count(*) FILTER (status <> 'supported_positive') AS n_ambiguous FROM wt GROUP BY ALL) USING (rel_path, window_index)))
"""
