"""Validation, matching and scoring on a scenario of one night: a ledger is read, packed and sent away."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright.operators import compat as C
from tracewright.operators import matching as M
from tracewright.operators import validation as V

HI, MID, LO = "HIGH_SUSPICIOUS", "MEDIUM_SUSPICIOUS", "LOW_SUSPICIOUS"
N_LINES = 8

# --- validation ------------------------------------------------------------------------------------------------------

WHOLE = {  # a sound item of each task
    "lm": {"verdict": HI, "timestamp": "2023-03-05 05:00:01", "external_host": "nas-7.example", "source_lines": [8, 2]},
    "persistence": {"verdict": LO, "timestamp": "3/5/2023 4:17:20 AM", "technique": "Browser or Editor Extensions", "source_lines": [4]},
    "exfiltration": {"verdict": MID, "timestamp": "1678011425.25", "file_path": "D:\\out\\ledger.zip", "source_lines": [7]},
    "classification": {"verdict": HI, "source_lines": []},
}
TOO_LONG = "e" * 2001
REFUSED = {  # field of an item -> bad values -> how the first error begins
    "verdict": ([None, 3, "SUSPICIOUS", "High_Suspicious", ""], "verdict"),
    "pid": (["12", -5, 2.5, False, []], "pid"),
    "method": ([7, ["scp"], {}], "method must be"),
    "evidence_against": ([TOO_LONG], "evidence_against exceeds"),
    "timestamp": (["", "at dawn", "2023-3-5", "5 March 2023"], "timestamp is not"),
    "external_host": (["nas-7.example, nas-8.example", "nas-7 or nas-8"], "external_host must name"),
    "colour": (["red", None], "finding has unknown"),
}
BAD_LINES = [
    ("4", "must be a list"), (None, "must be a list"), ({}, "must be a list"), ([], "must reference"), ([N_LINES + 1], "outside"), ([0, 1], "outside"), ([-2], "outside"),
    ([5, 6, 5], "contains dup"), ([1.5], "entries"), ([False], "entries"), ([[3]], "entries"), (["3"], "entries"), ([1] * 40, "exceeds"),
]
TEXTS = [  # task, text, how the first error begins (None: sound)
    ("lm", "[]", None), ("persistence", " [ ] ", None), ("lm", "", "output is empty"), ("lm", None, "output missing"), ("lm", "ledger", "invalid JSON"),
    ("lm", '{"findings": []}', "top-level"), ("lm", "null", "top-level"), ("lm", "[] []", "invalid JSON"), ("lm", "[],", "invalid JSON"), ("lm", "[-Infinity]", "invalid JSON"),
    ("lm", '[{"pid":1,"verdict":"x","pid":1}]', "invalid JSON"), ("lm", '["text"]', "finding 0 finding is not an object"), ("lm", "[null]", "finding 0 finding is not an object"),
    ("lm", "[" + " " * (1 << 18) + "]", "output exceeds"), ("classification", "[]", "classification requires"),
]


def payload_cases():
    """(task, payload, error) of every case above."""
    for task, item in WHOLE.items():
        yield task, json.dumps([item]), None
        yield task, json.dumps([dict(sorted(item.items()))]), None
        for field in item:
            if field != "verdict" or task != "classification":
                yield task, json.dumps([{k: v for k, v in item.items() if k != field}]), "finding 0 finding misses"
    item = WHOLE["lm"]
    yield "lm", json.dumps([item] * 32), None
    yield "lm", json.dumps([item] * 33), "more than 32"
    yield "classification", json.dumps([WHOLE["classification"]] * 2), "classification requires"
    yield "lm", json.dumps([{**item, "pid": None, "username": None, "method": TOO_LONG[:-1]}, {**item, "pid": 0}]), None
    for field, (values, error) in REFUSED.items():
        for value in values:
            yield "lm", json.dumps([item, item, {**item, field: value}]), f"finding 2 {error}"
    for value, error in BAD_LINES:
        yield "lm", json.dumps([{**item, "source_lines": value}]), f"finding 0 source|{error}"
    for kind, value, error in [("timestamp", 1678011425.25, "must be"), ("external_host", "\t", "is empty"), ("external_host", None, "must be a string"), ("external_host", "_nas", "must be a single")]:
        yield "lm", json.dumps([{**item, kind: value}]), f"finding 0 {kind} {error}"
    yield "persistence", json.dumps([{**WHOLE["persistence"], "technique": "Browser; Editor"}]), "finding 0 technique must name"
    yield from TEXTS


def test_first_errors(spark):
    cases = list(payload_cases())
    df = spark.createDataFrame([(f"{i:03}", 0, t, N_LINES, p) for i, (t, p, _) in enumerate(cases)], "unit_id string, attempt_id int, task string, n_lines long, payload string")
    checked = V.validate_payloads(df)
    for r in checked.collect():
        task, payload, error = cases[int(r.unit_id)]
        start, _, part = (error or "").partition("|")
        sound = r.first_error is None if error is None else (r.first_error or "").startswith(start) and part in r.first_error
        assert sound and r.schema_valid == (error is None), (task, payload and payload[:90], error, r.first_error)
    items = [r for r in V.explode_findings(checked).collect() if r.unit_id == "000"]
    assert [(r.verdict, r.timestamp, r.entity, r.source_lines) for r in items] == [(HI, "2023-03-05 05:00:01", "nas-7.example", [8, 2])]


def test_invalid_utf8(spark):
    df = spark.createDataFrame([("u", 0, "lm", N_LINES)], "unit_id string, attempt_id int, task string, n_lines long")
    assert V.validate_payloads(df.withColumn("payload", F.expr("cast(x'5B22C3225D' as string)"))).first().first_error == "output is not UTF-8"


# --- matching --------------------------------------------------------------------------------------------------------

LEDGER = [
    r"(3/5/2023 4:16:58 AM) open C:\vault\ledger.db", r"(3/5/2023 4:17:20 AM) read C:\\vault\\ledger.db", r"(3/5/2023 4:17:41 AM) write D:\out\LEDGER.zip",
    "(3/5/2023 4:19:00 AM) idle", r"(3/5/2023 4:31:05 AM) read C:\vault\keys.txt", "noise without a time", r"(3/5/2023 4:31:59 AM) send D:\out\ledger.zip",
    r"(3/5/2023 4:32:00 AM) close C:\vault\ledger.db",
]
READ, PACKED, KEYS = r"C:\vault\ledger.db", r"D:\out\ledger.zip", r"C:\vault\keys.txt"
TARGETS = [  # id, status, stamps to the minute, aliases
    ("read", "supported_positive", ["2023-03-05 04:16", "2023-03-05 04:17"], [r"C:\Vault\Ledger.DB"]),
    ("sent", "supported_positive", ["2023-03-05 04:31"], [PACKED, KEYS]),
    ("shut", "ambiguous", ["2023-03-05 04:32"], [READ]),
]
at = lambda minute, path, lines, verdict=HI: (verdict, f"2023-03-05 04:{minute}", path, lines)
READ_IT, SENT_IT = at(17, READ, [2]), (HI, "3/5/2023 4:31:10 AM", r"d:\OUT\ledger.zip", [7])
NIGHT = {  # case: label, os, findings, outcomes, strict and dense score; an attack has two supported targets
    "both targets, other case and time format": ("positive", "windows", [READ_IT, SENT_IT], ["tp", "tp"], 1.0, 1.0),
    "one of two": ("positive", "windows", [READ_IT], ["tp"], 0.0, 0.5),
    "two times of one target": ("positive", "windows", [at(16, READ, [1]), READ_IT], ["tp", "redundant"], 0.0, 0.5),
    "the other alias": ("positive", "windows", [at(31, KEYS, [5]), READ_IT], ["tp", "tp"], 1.0, 1.0),
    "a line of another minute": ("positive", "windows", [at(17, READ, [8]), SENT_IT], ["ungrounded", "tp"], 0.0, 0.25),
    "a line without a time": ("positive", "windows", [at(17, READ, [6])], ["ungrounded"], 0.0, 0.0),
    "a line with another path": ("positive", "windows", [at(17, READ, [3])], ["ungrounded"], 0.0, 0.0),
    "one line of three is enough": ("positive", "windows", [at(17, READ, [4, 6, 2]), SENT_IT], ["tp", "tp"], 1.0, 1.0),
    "shown, but no target": ("positive", "windows", [READ_IT, at(17, PACKED, [3]), SENT_IT], ["tp", "fp", "tp"], 0.0, 0.5),
    "ambiguous between two": ("positive", "windows", [READ_IT, at(32, READ, [8]), SENT_IT], ["tp", "neutral", "tp"], 1.0, 1.0),
    "low and medium": ("positive", "windows", [at(17, READ, [2], MID), at(31, KEYS, [5], LO)], ["low_confidence"] * 2, 0.0, 0.0),
    "silent attack": ("positive", "windows", [], [], 0.0, 0.0),
    "silent night": ("benign", "windows", [], [], 1.0, 1.0),
    "medium at night": ("benign", "windows", [at(31, KEYS, [5], MID)], ["low_confidence"], 1.0, 1.0),
    "alarm at night": ("benign", "windows", [at(31, KEYS, [5])], ["fp"], 0.0, 0.0),
    "case counts on linux": ("positive", "linux", [at(31, KEYS, [5]), at(17, READ.lower(), [2])], ["tp", "ungrounded"], 0.0, 0.25),
}
UNITS = "unit_id string, rel_path string, start_line long, representation string, task string, dataset string, os string, label string, n_lines long"
TRUTH = "unit_id string, target_id string, target_order string, status string, stamp string, aliases array<string>"


def graded(spark, units, payloads, targets, log):
    u, t = spark.createDataFrame(units, UNITS), spark.createDataFrame(targets, TRUTH)
    lines = spark.createDataFrame([(r[1], i, line) for r in units for i, line in enumerate(log, 1)], "rel_path string, line_no long, line string")
    p = spark.createDataFrame(payloads, "unit_id string, attempt_id int, task string, n_lines long, payload string")
    outcomes = {}
    for r in M.assign_findings(V.explode_findings(V.validate_payloads(p)), u, t, lines).orderBy("finding_index").collect():
        outcomes.setdefault(r.unit_id, []).append(r.outcome)
    return outcomes, {r.unit_id: (r.strict_success, r.dense_reward) for r in M.grade(p, u, t, lines).collect()}


def test_matching_and_rewards(zoned):
    units, payloads, targets = [], [], []
    for name, (label, os, findings, *_) in NIGHT.items():
        units.append((name, f"night/{name}", 1, "edge", "exfiltration", "lab", os, label, len(LEDGER)))
        items = [{"verdict": v, "timestamp": t, "file_path": e, "source_lines": s} for v, t, e, s in findings]
        payloads.append((name, 0, "exfiltration", len(LEDGER), json.dumps(items)))
        if label == "positive":
            targets += [(name, i, f"{k}{i}", status, stamp, aliases) for k, (i, status, stamps, aliases) in enumerate(TARGETS) for stamp in stamps]
    outcomes, scores = graded(zoned, units, payloads, targets, LEDGER)
    for name, (*_, expected, strict, dense) in NIGHT.items():
        assert outcomes.get(name, []) == expected and scores[name] == (strict, dense), name


@pytest.mark.parametrize("named,outcome", [("Nas-7.EXAMPLE", "tp"), ("nas-7.example.", "tp"), ("10.4.4.4", "ungrounded"), ("nas-7.exam", "fp")])
def test_host_aliases_in_any_case(spark, named, outcome):
    """The alias ``NAS-7.Example.`` is the host of the line whatever its case and final dot; an alias that the line lacks is not shown."""
    log = ["(2023-03-05 04:59:59) login", "(2023-03-05 05:00:01) ssh to nas-7.Example port 22"]
    unit = ("u", "ssh", 1, "edge", "lm", "lab", "linux", "positive", 2)
    payload = json.dumps([{"verdict": HI, "timestamp": "2023-03-05 05:00:01", "external_host": named, "source_lines": [2]}])
    target = ("u", "t", "0t", "supported_positive", "2023-03-05 05:00:01", ["NAS-7.Example.", "10.4.4.4"])
    assert graded(spark, [unit], [("u", 0, "lm", 2, payload)], [target], log)[0] == {"u": [outcome]}


# --- compatibility scores --------------------------------------------------------------------------------------------

SCOPE = "dataset string, task string, scenario string"


def compat(spark, scenario, annotations, chunks, more_defensive=False):
    """scenario: (dataset, task, name, label, lines, precision); chunks: id -> findings or None."""
    sc = spark.createDataFrame([scenario], f"{SCOPE}, label string, log_lines long, precision string")
    key = scenario[:3]
    truth = C.truth_pairs(spark.createDataFrame([(*key, t, e) for t, e in annotations], f"{SCOPE}, timestamps array<string>, entities array<string>"))
    ch = spark.createDataFrame([(*key, 0, c) for c in chunks], f"{SCOPE}, attempt_id int, chunk_id string")
    rows = [(*key, 0, c, i, v, t, e) for c, fs in chunks.items() for i, (v, t, e) in enumerate(fs or [])]
    f = spark.createDataFrame(rows, f"{SCOPE}, attempt_id int, chunk_id string, finding_index int, verdict string, timestamp string, entity string")
    return C.compat_counts(sc, ch, f, truth, more_defensive)


def test_hosts_count_once_on_optc(spark):
    """Four annotations of three hosts; two are found, one of them twice, and one finding is of no annotated host."""
    day = lambda k: f"2023-03-05 06:00:{k:02}"
    truth = [([day(1)], ["10.1.0.1"]), ([day(2)], ["10.1.0.1"]), ([day(3)], ["10.1.0.2"]), ([day(4)], ["10.1.0.3"])]
    found = [(HI, day(1), "10.1.0.1"), (HI, day(2), "10.1.0.1"), (HI, day(4), "10.1.0.3"), (HI, day(3), "10.9.9.9")]
    r = compat(spark, ("optc", "lm", "night-1", "attack", 40, "second"), truth, {"c0": found[:1], "c1": found[1:]}).first()
    assert (r.tp, r.fn, r.fp, r.tn, r.chunks) == (2, 1, 1, 39, 2)


def test_names_inside_longer_names(spark):
    scope = ("lab", "persistence", "night-2", "attack", 55, "minute")
    truth = [(["2023-03-05 03:00", "2023-03-05 03:30", "2023-03-05 04:17"], ["Scheduled Task/Job"])]
    hit = (HI, "3/5/2023 4:17:50 AM", "T1053: SCHEDULED TASK/JOB by cron")
    r = compat(spark, scope, truth, {"a": [hit], "b": [], "c": None}).first()
    assert (r.tp, r.fn, r.fp, r.chunks) == (1, 0, 0, 3)
    other = compat(spark, scope, truth, {"a": [(HI, "3/5/2023 4:18:00 AM", "Scheduled Task/Job")]}).first()
    assert (other.tp, other.fn, other.fp) == (0, 1, 1)
    unsure = {"a": [(MID, *hit[1:])]}
    assert [compat(spark, scope, truth, unsure, d).first().tp for d in (False, True)] == [0, 1]


def test_benign_files_and_rates(spark):
    false = [(HI, "2023-03-05 01:00:00", "10.1.1.1"), (HI, "2023-03-05 02:00:00", "10.1.1.2")]
    r = compat(spark, ("lab", "lm", "benign-night", "benign", 77, "second"), [], {"a": false, "b": None}).first()
    assert (r.fp, r.tn, r.tp, r.fn) == (2, 75, 0, 0)
    one = lambda name, label: compat(spark, ("lab", "classification", name, label, 9, "second"), [], {"file": [(HI, None, None)]})
    calm, raided = one("calm", "benign"), one("raided", "attack")
    assert (calm.first().accuracy, raided.first().accuracy) == (0.0, 1.0)
    rates = C.compat_rates(calm.unionByName(raided)).first()
    assert (rates.tpr, rates.fpr) == (1.0, 1.0) and C.compat_rates(calm).first().tpr is None


def test_tuples_and_comparison(spark):
    chunk = "named_struct('timestamp', {}, 'entity', {}, 'verdict', {})"
    body = f"map('c0', map('r1', array({chunk.format(repr('t'), repr('e'), repr('high_suspicious'))}, {chunk.format(repr(''), repr(''), repr('low'))})), 'c1', map('r1', array()))"
    df = spark.sql(f"select 'lab' dataset, 'lm' task, 's' scenario, {body} chunks")
    rows = C.tuples_to_findings(df).collect()
    assert [(r.chunk_id, r.attempt_id, r.verdict, r.timestamp, r.entity) for r in rows] == [("c0", "r1", HI, "t", "e")]
    a = spark.createDataFrame([(1, 2), (2, None), (3, 1)], "k int, tp int")
    b = spark.createDataFrame([(1, 2), (2, None), (4, 1)], "k int, tp int")
    compared = C.compare_scores(a, b, ["k"], ["tp"])
    assert {r.k: r.match for r in compared.collect()} == {1: True, 2: True, 3: False, 4: False}
    assert tuple(C.mismatch_totals(compared).first()) == (4, 2)
