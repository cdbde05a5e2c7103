"""What several steps read is worked out once."""

import itertools
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from tracewright.operators import compat as C
from tracewright.operators import evidence as E
from tracewright.operators import neardup as ND
from tracewright.plans import bindings as B


def counted(spark, df):
    """``df``, and the number of its rows that have been worked out so far."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), seen


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_run_sets_are_worked_out_once(spark):
    rows = [("a", [5, -1, 3, 9, 7]), ("b", [3, 9, 7, -1, 5]), ("c", [-1, 3, 5, 9, 8, 7]), ("d", []), ("e", [40])]
    sets, seen = counted(spark, spark.createDataFrame(rows, "sha256 string, runs array<bigint>"))
    members, pairs = ND.similar_contents(sets)
    assert {r.sha256: r.content for r in members.collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}
    assert [(r.a, r.b, r.n_shared, r.n_all) for r in pairs.collect()] == [("a", "c", 5, 6)]
    assert seen.value == len(rows)


def test_events_are_read_for_their_numbers_only(spark, tmp_path):
    """The attributes of a log follow from its user, so no third scan, count and join of the events brings them."""
    rows = [(i, f"2024-01-02 03:04:{i:02}", u, "error", '{"k": 3}') for i, u in enumerate([1, 1, 2, None, 1, 2, 40], 1)]
    table = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, props string")
    table.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    events, files = B.log_events(spark, str(tmp_path)), B.log_files(spark, str(tmp_path))
    shared = [c for c in files.columns if c != "lines"]
    assert sorted((r.event_id, r.u, r.line_no) for r in events.collect()) == [(1, 1, 1), (2, 1, 2), (3, 2, 1), (5, 1, 3), (6, 2, 2), (7, 40, 1)]
    assert events.select(shared).exceptAll(events.select("u").join(files, "u").select(shared)).count() == 0
    assert plan(events).count("Relation") == 2


def test_targets_are_numbered_once(spark):
    rows = [("lab", "lm", "q", i, [f"2024-01-01 00:0{i}:00"], [f"h{i}"]) for i in range(3)]
    annotations = spark.createDataFrame(rows, "dataset string, task string, scenario string, record_index long, timestamps array<string>, entities array<string>")
    targets, stamps = E.build_targets(annotations)
    assert "Window" not in plan(targets) and "Window" not in plan(stamps)
    assert sorted((r.target_id, r.stamp_norm) for r in stamps.collect()) == [(f"lab:lm:q:{i}", f"2024-01-01 00:0{i}:00") for i in range(3)]


def test_two_scorers_share_the_findings(spark):
    """Strict and defensive counts from one reading of the findings are those of two readings."""
    scope = "dataset string, task string, scenario string"
    key, whole = ("lab", "lm", "s"), ("lab", "classification", "w")
    scenarios = spark.createDataFrame([(*key, "attack", 50, "second"), (*whole, "attack", 9, "second")], f"{scope}, label string, log_lines long, precision string")
    truth = spark.createDataFrame([(*key, f"2024-01-01 00:00:0{i}", f"h{i}") for i in range(3)], f"{scope}, g_ts string, g_entity string")
    chunks = spark.createDataFrame([(*k, 0, c) for k in (key, whole) for c in ("c1", "c2")], f"{scope}, attempt_id int, chunk_id string")
    said = [("HIGH", 0, "h0"), ("MEDIUM", 1, "h1"), ("LOW", 2, "h2"), ("MEDIUM", 2, "h9"), ("HIGH", 1, "h9")]
    rows = [(*key, 0, "c1", i, f"{v}_SUSPICIOUS", f"2024-01-01 00:00:0{t}", e) for i, (v, t, e) in enumerate(said)]
    rows += [(*key, 0, "c2", 0, "HIGH_SUSPICIOUS", "no time", "h0"), (*whole, 0, "c1", 0, "MEDIUM_SUSPICIOUS", None, None)]
    found = spark.createDataFrame(rows, f"{scope}, attempt_id int, chunk_id string, finding_index int, verdict string, timestamp string, entity string")
    findings, seen = counted(spark, found)
    scored = C.scored_findings(scenarios, findings, truth, more_defensive=True)
    for more, want in ((False, {"lm": (1, 1, 0), "classification": (0, 0, 1)}), (True, {"lm": (1, 2, 0), "classification": (1, 0, 0)})):
        counts = {r.task: (r.tp, r.fp, r.fn) for r in C.compat_counts(scenarios, chunks, findings, truth, more, scored).collect()}
        alone = {r.task: (r.tp, r.fp, r.fn) for r in C.compat_counts(scenarios, chunks, found, truth, more).collect()}
        assert counts == alone == want, (more, counts, alone)
    assert seen.value == len(rows)


def exchanged(spark, df):
    """Rows of ``df``, and the mean bytes of a row in each exchange and table of its run."""
    rows = df.collect()
    plan, seen, left = df._jdf.queryExecution().executedPlan(), [], []
    left.append(plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan)
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind.endswith("QueryStageExec"):
            left.append(node.plan())
        if kind == "ShuffleExchangeExec":
            bytes_, n = (node.metrics().apply(m).value() for m in ("shuffleBytesWritten", "shuffleRecordsWritten"))
            seen.append((bytes_, n, node.child().output().mkString(" ")))
        left += [node.children().apply(i) for i in range(node.children().size())]
    return rows, seen


def test_sets_are_sent_to_chunks_not_to_pairs(spark):
    """A group of similar contents has many more pairs than contents; their sets are exchanged about as often as the contents are many."""
    n, base = 120, [f"w{i}" for i in range(400)]
    texts = [" ".join([f"only{i}", *base[:200], f"mid{i}", *base[200:]]) for i in range(n)]
    files = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "rel_path string, text string").withColumn("sha256", F.sha2("text", 256))
    files = files.repartition(3).localCheckpoint()
    common = ND.common_runs(files, share=2.0)
    pairs = ND.similar_contents(
        ND.run_sets(files, common=common, copies=True), again=lambda wanted: ND.run_sets(files, common=common, only=wanted)
    )[1]
    rows, seen = exchanged(spark, pairs)
    assert len(rows) == n * (n - 1) // 2 and {(r.n_shared, r.n_all) for r in rows} == {(392, 404)}
    sets = [s for s in seen if "runs#" in s[2]]
    assert len(sets) == 1 and sets[0][1] == n + len(rows)  # each set once, and a row of two numbers per pair
    assert sets[0][0] < 2 * n * 398 * 8 < len(rows) * 398 * 8 / 25


def test_chunks_of_contents(spark, monkeypatch):
    """Pairs whose contents lie in several chunks, and contents larger than a chunk, are counted as they are in one."""
    rows = [(f"s{i:02}", [*range(40), 100 + i, *([200 + i] if i % 3 else [])]) for i in range(24)]
    sets = spark.createDataFrame(rows, "sha256 string, runs array<bigint>").repartition(4)
    held = {s: set(v) for s, v in rows}
    want = {(a, b): (len(held[a] & held[b]), len(held[a] | held[b])) for a in held for b in held if a < b}
    for contents, runs in ((512, 1 << 18), (5, 1 << 18), (512, 90), (512, 10)):
        monkeypatch.setattr(ND, "CHUNK_CONTENTS", contents)
        monkeypatch.setattr(ND, "CHUNK_RUNS", runs)
        members, pairs = ND.similar_contents(sets)
        got = [((r.a, r.b), (r.n_shared, r.n_all)) for r in pairs.collect()]
        assert len(got) == len(want) and dict(got) == want, (contents, runs)


def test_boilerplate_counts_contents_not_copies(spark):
    """A run of thirty copies of one content and of nine others is in ten contents, one of as many copies and of eight others in nine."""
    texts = ["a b c d e copy"] * 30 + [f"a b c d e x{i}" for i in range(9)] + [f"p q r s t y{i}" for i in range(8)] + ["p q r s t"] * 30 + [None, "", "a b"]
    files = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("sha256", F.sha2("text", 256)).repartition(4)
    run = lambda *w: F.xxhash64(F.array(*[F.lit(x) for x in w]))
    want = spark.range(1).select(run(*"abcde")).first()[0]
    common = ND.common_runs(files)
    assert [r.run for r in common.collect()] == [want]
    got = {r.sha256: r.runs for r in ND.run_sets(files).collect()}
    assert len(got) == 22 and all(want not in v for v in got.values())
    twice = [(r.sha256, sorted(r.runs)) for r in ND.run_sets(files, common=common, copies=True).collect()]
    assert len(twice) == len(texts) and all(sorted(got[s]) == v for s, v in twice)
    only = files.filter("text = 'a b'").select("sha256")
    assert [r.sha256 for r in ND.run_sets(files, common=common, only=only).collect()] == [only.first()[0]]


def test_codes_of_runs(monkeypatch):
    """Pieces are those of the split, whatever stands between them and wherever the bytes are parted; equal runs have equal codes only."""
    rng = random.Random(3)
    parts = ["a", "bb", "é", "漢字", " ", "x\u0085y", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b\f"]
    texts = ["", " ", "\n", "a\n", "\na", "one", None] + ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(300)]
    blank = "[ \t\n\x0b\f\r]+"
    for unit, k, size in itertools.product(("word", "line"), (1, 3), (1, 40, 1 << 18)):
        monkeypatch.setattr(ND, "BYTES_AT_ONCE", size)
        cut = lambda t: [] if not re.sub(blank, "", t or "") else t.split("\n") if unit == "line" else [w for w in re.split(blank, t) if w]
        want = [(r, i, tuple(p[i : i + k])) for r, t in enumerate(texts) for p in [cut(t)] for i in range(max(1, len(p) - k + 1) if p else 0)]
        found = [x for part in ND._coded(pa.array(["skipped", *texts])[1:], k, unit) for x in zip(*(c.tolist() for c in part), strict=True)]
        assert [x[:2] for x in found] == [x[:2] for x in want], (unit, k, size)
        codes = {(c, w) for (_, _, c), (_, _, w) in zip(found, want, strict=True)}
        assert len(codes) == len({c for c, _ in codes}) == len({w for _, w in codes})
