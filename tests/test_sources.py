import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracewright.operators import inventory as I
from tracewright.operators import screening as SC
from tracewright.sources import annotations as A
from tracewright.sources import logs as L
from tracewright.sources import logtree as LT
from tracewright.sources import manifests as MF
from tracewright.sources import trials as TR

EDGE = "edge_2024-11-27T14-04-to-2024-11-27T14-10_lm-scenario2.log"
RAW = "raw_2019-09-23T13-23-21-to-2019-09-23T13-23-41_h201_benign-scenario1.log"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs") / "in put"
    texts = {
        f"lab/task_lm/edge/{EDGE}": "(1/13/2025 2:02:03 AM) a\r\n(1/13/2025 1:00:00 AM) b\n\nno time\n(1/13/2025 3:00:00 AM) \u2028 end",
        f"optc/task_lm/raw/{RAW}": "".join(f"msg=audit({1569245000 + i}.5:{i}): x\n" for i in range(5000)),
        f"lab/task_exfiltration/edge/{EDGE}": "",
    }
    for rel, text in texts.items():
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_bytes(text.encode())
    return str(root), texts


def test_scan(spark, tree):
    root, texts = tree
    listing = spark.createDataFrame([(k,) for k in texts], "rel_path string")
    found = {r.rel_path: r for r in L.scan_files(spark, root, listing).collect()}
    assert {k: (r.sha256, r.bytes) for k, r in found.items()} == {k: (hashlib.sha256(t.encode()).hexdigest(), len(t.encode())) for k, t in texts.items()}
    assert (found[f"optc/task_lm/raw/{RAW}"].dataset, found[f"optc/task_lm/raw/{RAW}"].task) == ("optc", "lm")
    assert L.artifact_hashes(spark, root).count() == 2


def test_lines_of_split_files(spark, tree):
    root, texts = tree
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # several blocks per file
    try:
        got = {}
        for r in L.scan_lines(spark, root).collect():
            got.setdefault(r.rel_path, {})[r.line_no] = r.line
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for rel, text in texts.items():
        lines = text.split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        assert got.get(rel, {}) == {i + 1: line for i, line in enumerate(lines)}


def test_file_records(spark, tree):
    root, texts = tree
    listing = spark.createDataFrame([(k,) for k in texts], "rel_path string")
    rows = {r.rel_path: r for r in I.file_records(L.scan_files(spark, root, listing), L.scan_lines(spark, root)).collect()}
    edge = rows[f"lab/task_lm/edge/{EDGE}"]
    assert (edge.lines, edge.parse_failures, edge.nonmonotonic, edge.ts_formats, edge.os, edge.label) == (5, 2, 1, ["windows"], "windows", "attack")
    assert (edge.window_start, edge.scenario_key, edge.host) == ("2024-11-27 14:04:00", "lab/lm-scenario2", None)
    raw = rows[f"optc/task_lm/raw/{RAW}"]
    assert (raw.lines, raw.parse_failures, raw.scenario_key, raw.label, raw.os) == (5000, 0, "optc/h201_benign-scenario1", "benign", "windows")
    empty = rows[f"lab/task_exfiltration/edge/{EDGE}"]
    assert (empty.lines, empty.ts_formats, empty.first_time, empty.os) == (0, [], None, "linux")


def test_text_lines(spark):
    df = spark.createDataFrame([("a", "x\n\ny\n"), ("b", ""), ("c", "\n"), ("d", "z")], "k string, text string")
    got = sorted((r.k, r.line_no, r.line) for r in L.split_text_lines(df, "k").collect())
    assert got == [("a", 1, "x"), ("a", 2, ""), ("a", 3, "y"), ("c", 1, ""), ("d", 1, "z")]


def test_annotations(spark, tmp_path):
    for dataset, task, rows in [
        ("lab", "lm", [{"lm-scenario1": [{"timestamp": ["2024-01-01 00:00:01"], "external host": ["h1", "h2"], "username": ["a\\\\b"], "note": ["n"]}, {"timestamp": ["t"], "external host": ["h3"]}]}, {"lm-scenario2": []}]),
        ("optc", "exfiltration", [{"exfiltration-scenario1": [{"timestamp": ["2024-01-01 00:00"], "exfiltrated data": ["C:\\\\x"]}]}]),
    ]:
        path = tmp_path / dataset / f"groundtruth-{task}.jsonl"
        path.parent.mkdir(exist_ok=True)
        path.write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    rows = {(r.dataset, r.task, r.scenario, r.record_index): r for r in A.read_annotations(spark, str(tmp_path)).collect()}
    assert set(rows) == {("lab", "lm", "lm-scenario1", 0), ("lab", "lm", "lm-scenario1", 1), ("optc", "exfiltration", "exfiltration-scenario1", 0)}
    first = rows[("lab", "lm", "lm-scenario1", 0)]
    assert (first.timestamps, first.entities, set(first.extra)) == (["2024-01-01 00:00:01"], ["h1", "h2"], {"username", "note"})
    assert rows[("optc", "exfiltration", "exfiltration-scenario1", 0)].entities == ["C:\\x"]
    assert A.annotation_hashes(spark, str(tmp_path)).count() == 2


def test_manifests(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", "r", "strong", "e")], MF.EDGE_SCHEMA)
    MF.write_manifest(edges, str(tmp_path / "edges"), "strength")
    back = MF.read_manifest(spark, str(tmp_path / "edges"), MF.EDGE_SCHEMA)
    assert back.first().evidence == "e" and back.first().strength == "strong"
    (tmp_path / "one.jsonl").write_text('{"a":"x","b":"y"}\n\n{"a":"z"}\n')
    assert MF.read_manifest(spark, str(tmp_path / "one.jsonl"), MF.EDGE_SCHEMA).count() == 2
    files = spark.range(50).selectExpr("'train' split", "'g' group_id", "concat('f', id) rel_path", "'s' sha256", "'lm' task", "'edge' representation", "id lines", "if(id = 0, null, concat('h', id % 3)) host", "'k' scenario_key")
    groups = spark.sql("select 'g' group_id, 'lab' dataset, 'mixed' label, array('linux') os, array('lm') tasks")
    parts = MF.nested_split_manifest(files, groups, part_files=10).collect()
    assert {(p.dataset, p.label, tuple(p.os), tuple(p.tasks), tuple(p.scenario_keys)) for p in parts} == {("lab", "mixed", ("linux",), ("lm",), ("k",))}
    assert {h for p in parts for h in p.hosts} == {"h0", "h1", "h2"}
    assert sum(len(p.files) for p in parts) == 50 and all(p.n_parts == 5 for p in parts) and max(len(p.files) for p in parts) < 30
    MF.write_draws(spark.range(3), spark.range(1), str(tmp_path / "draws"))
    assert spark.read.parquet(str(tmp_path / "draws" / "draws")).count() == 3
    cells = MF.json_cells(spark.sql("select array(1, 2) a, named_struct('x', 1) s, 'k' k")).first()
    assert (cells.a, cells.s, cells.k) == ("[1,2]", '{"x":1}', "k")


def test_folder_named_like_the_root(spark, tmp_path):
    path = tmp_path / "data" / "logs" / "optc" / "task_lm" / "logs" / "edge_a.log"
    path.parent.mkdir(parents=True)
    path.write_text("x\ny\n")
    rel = "optc/task_lm/logs/edge_a.log"
    assert [(r.rel_path, r.dataset, r.task) for r in L.scan_files(spark, str(tmp_path / "data" / "logs")).collect()] == [(rel, "optc", "lm")]
    assert {r.rel_path for r in L.scan_lines(spark, str(tmp_path / "data" / "logs") + "/").collect()} == {rel}


def test_trials(spark, tmp_path):
    def put(trial, rel, value):
        path = tmp_path / trial / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(value if isinstance(value, str) else json.dumps(value))

    put("t1", "result.json", {"trial_name": "T1", "id": "1", "task_name": "pool/u1", "agent_setup": {"started_at": "x"}, "agent_result": {"n_input_tokens": 5, "rollout_details": [{"x": 1}], "metadata": {"n_episodes": 2, "all_messages": []}}})
    put("t1", "verifier/reward.json", {"reward": 1.0})
    put("t1", "verifier/diagnostics.json", {"schema_valid": True, "tp": 2, "n_targets": 2})
    put("t1", "artifacts/app/findings.json", "[]")
    put("t2", "result.json", {"exception_info": {"exception_type": "AgentTimeoutError"}})
    put("t3", "result.json", {"exception_info": {"exception_type": "Other"}})
    put("t4", "result.json", {})
    for trial, body in (("t5", "{}"), ("t6", "{broken")):
        put(trial, "result.json", {"exception_info": {}})
        put(trial, "verifier/reward.json", body)
    rows = {r.trial_name: r for r in TR.read_trials(spark, str(tmp_path), "dev", "base", 0.5).collect()}
    assert (rows["T1"].split, rows["T1"].policy, rows["T1"].sampler_probability) == ("dev", "base", 0.5)
    assert rows["T1"].timing.agent_setup.toPython() == {"started_at": "x"} and rows["T1"].timing.verifier is None
    assert {k: r.termination for k, r in rows.items()} == {"T1": "graded", "t2": "policy_timeout", "t3": "infrastructure_error", "t4": "unknown", "t5": "unknown", "t6": "unknown"}
    assert (rows["T1"].reward.reward, rows["T1"].diagnostics.tp, rows["T1"].output.bytes, rows["T1"].gaps) == (1.0, 2, 2, [])
    assert rows["T1"].output.sha256 == hashlib.sha256(b"[]").hexdigest() and len(rows["t4"].gaps) == 2 and rows["t4"].output is None


def test_evaluations(spark, tmp_path):
    body = {"D": 0.5, "false_alert_rate": 0.1, "validity": 1.0, "per_task": {"lm": {"ordinary_recall": 0.4}, "x": {"ordinary_recall": None}, "y": {"ordinary_recall": 0.8}}}
    (tmp_path / "a-dev-step0010.json").write_text(json.dumps(body, indent=1))
    (tmp_path / "b-dev-step0000.json").write_text(json.dumps({**body, "per_task": {}}))
    (tmp_path / "a-train-step0010.json").write_text(json.dumps(body))
    rows = {(r.arm, r.step): r.positive_recall for r in TR.read_evaluations(spark, str(tmp_path)).collect()}
    assert rows == {("a", 10): pytest.approx(0.6), ("b", 0): None}


def test_screening(spark):
    pool = spark.createDataFrame([("a", "Reads the syslog"), ("b", "A CTF about Malware"), ("c", "sort a file")], "item_id string, text string")
    rows = {r.item_id: r for r in SC.keyword_screen(pool).collect()}
    assert {k: r.screen for k, r in rows.items()} == {"a": "review", "b": "exclude", "c": "candidate"}
    assert rows["b"].exclude_terms == sorted([r"\bmalware\b", r"\bctf\b"])
    paths = spark.createDataFrame([("a/x/environment/data/f1",), ("zz/environment/data/f",), ("a/readme",)], "path string")
    assert [tuple(r) for r in SC.data_assets(pool, paths).collect()] == [("a", "x/environment/data/f1")]
    a = spark.createDataFrame([("u", "1"), ("v", "2")], "unit_id string, sha256 string")
    assert [r.unit_id for r in SC.changed_slices(a.filter("unit_id = 'u'"), a).collect()] == ["v"]
    assert L.expected_artifacts(paths.withColumnRenamed("path", "rel_path"), spark.createDataFrame([("a/readme", "h")], "rel_path string, sha256 string")).filter("sha256 is null").count() == 2


def test_line_counts_are_infrastructure(spark):
    from tracewright.operators.validation import line_count_errors

    units = spark.createDataFrame([("u", 3), ("v", 2)], "unit_id string, n_lines long")
    slices = spark.createDataFrame([("u", 3), ("v", 1)], "unit_id string, n_found long")
    assert [(r.unit_id, r.n_found) for r in line_count_errors(slices, units).select("unit_id", F.col("n_found")).collect()] == [("v", 1)]


def tree_digest(data, block):
    parts = [hashlib.sha256(data[i : i + block]).hexdigest() for i in range(0, max(len(data), 1), block)]
    return parts[0] if len(parts) == 1 else hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.mark.parametrize("block", [997, 20_000, 1 << 20])
def test_one_read(spark, tree, block):
    root, texts = tree
    files, lines = LT.scan_tree(spark, root, blockBytes=block, taskBytes=8 * block)
    found = {r.rel_path: r for r in files.collect()}
    assert set(found) == set(texts)  # the empty file too, without a listing
    got = {}
    for r in lines.collect():
        assert r.line_bytes == len(r.line.encode())
        got.setdefault(r.rel_path, {})[r.line_no] = r.line
    for rel, text in texts.items():
        data, want = text.encode(), text.split("\n")
        want = want[:-1] if want[-1] == "" else want
        assert (found[rel].bytes, found[rel].lines, found[rel].sha256) == (len(data), len(want), tree_digest(data, block))
        assert got.get(rel, {}) == {i + 1: line for i, line in enumerate(want)}
    assert (found[f"optc/task_lm/raw/{RAW}"].dataset, found[f"optc/task_lm/raw/{RAW}"].task, found[f"optc/task_lm/raw/{RAW}"].filename) == ("optc", "lm", RAW)


def test_one_read_gives_file_records(spark, tree):
    root, _ = tree
    files, lines = LT.scan_tree(spark, root)
    listing = spark.createDataFrame([(k,) for k in tree[1]], "rel_path string")
    key = lambda r: r["rel_path"]
    one = sorted((r.asDict() for r in I.file_records(files.drop("lines"), lines).collect()), key=key)
    two = sorted((r.asDict() for r in I.file_records(L.scan_files(spark, root, listing), L.scan_lines(spark, root)).collect()), key=key)
    assert one == two


def test_lines_on_block_borders(spark, tmp_path):
    place = tmp_path / "d" / "task_t" / "edge"
    place.mkdir(parents=True)
    for i, data in enumerate([b"abc\ndef\n", b"abcd\nef", b"\n\n\n\n", b"abcdefghijklmnop", b"abc\n\nx\xff\xc3\n", b"\nabcdefghij\n"]):
        (place / f"{i}.log").write_bytes(data)
        for block in (1, 2, 4, 5):
            _, lines = LT.scan_tree(spark, str(tmp_path), blockBytes=block, maxLineBytes=12)
            got = [(r.line, r.line_bytes) for r in lines.filter(f"rel_path like '%/{i}.log'").orderBy("line_no").collect()]
            want = data.split(b"\n")[:-1] if data.endswith(b"\n") else data.split(b"\n")
            assert got == [(None if len(w) > 12 else w.decode("utf-8", "replace"), len(w)) for w in want]


def test_file_of_three_gigabytes(spark, tmp_path):
    place = tmp_path / "lab" / "task_lm" / "raw" / "big.log"
    place.parent.mkdir(parents=True)
    with place.open("wb") as out:  # sparse: two lines, a hole of 3 GiB, two lines
        out.write(b"first\nsecond\n")
        out.seek(3 << 30)
        out.write(b"\nlast but one\nlast")
    files, lines = LT.scan_tree(spark, str(tmp_path))
    record = files.collect()[0]
    assert (record.bytes, record.lines) == ((3 << 30) + 18, 5) and len(record.sha256) == 64
    got = [(r.line_no, r.line, r.line_bytes) for r in lines.orderBy("line_no").collect()]
    assert got == [(1, "first", 5), (2, "second", 6), (3, None, (3 << 30) - 13), (4, "last but one", 12), (5, "last", 4)]


def test_written_tree(spark, tmp_path):
    rows = [("a/task_b/c/1.log", "x\ny"), ("a/task_b/c/2.log", None), ("z/task_b/c/1.log", "é\n")]
    LT.write_tree(spark.createDataFrame(rows, "rel_path string, text string"), str(tmp_path / "t"))
    files, lines = LT.scan_tree(spark, str(tmp_path / "t"))
    assert sorted((r.rel_path, r.bytes, r.lines) for r in files.collect()) == [("a/task_b/c/1.log", 3, 2), ("a/task_b/c/2.log", 0, 0), ("z/task_b/c/1.log", 3, 1)]
    assert sorted((r.rel_path[0], r.line_no, r.line) for r in lines.collect()) == [("a", 1, "x"), ("a", 2, "y"), ("z", 1, "é")]
