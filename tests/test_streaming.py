import random
import time

import pytest

from tracewright.operators.selection import early_stop
from tracewright.streaming.early_stop import early_stop_alerts
from tracewright.streaming.log_stream import hit_counts, indicator_hits
from tracewright.streaming.sinks import drain
from tracewright.streaming.spend import breach_events, cap_breaches, running_spend

EVALS = "arm string, step int, D double, false_alert_rate double, validity double, positive_recall double"


def run(spark, df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def write(spark, rows, schema, path, parts=1):
    spark.createDataFrame(rows, schema).coalesce(parts).write.mode("append").parquet(str(path))


def test_early_stop_with_late_steps(spark, tmp_path):
    rows = [("a", i, d, 0.1, 0.9, 0.0) for i, d in enumerate([0.5, 0.6, 0.6, 0.605, 0.6, 0.6, 0.9])] + [("b", i, 0.1 * i, 0.1, 0.9, 0.0) for i in range(6)] + [("no base", i, 0.1, 0.1, 0.9, 0.0) for i in range(1, 7)]
    late = [rows[2], *rows[7:9]]
    early = [r for r in rows if r not in late]
    write(spark, early, EVALS, tmp_path / "in")
    write(spark, late, EVALS, tmp_path / "in")
    stream = spark.readStream.schema(EVALS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.arm: r.stop_step for r in drain(early_stop_alerts(stream), "update", latest_by="arm").collect()}
    batch = {r.arm: r.stop_step for r in early_stop(spark.createDataFrame(rows, EVALS)).collect()}
    assert batch["a"] == 5 and batch["b"] is None
    assert got.get("a") == 5 and set(got) == {"a"}


def test_spend(spark, tmp_path):
    usage = [("pilot", f"2024-01-01 0{h}:00:00", h, 3600.0 * 5, 20.0) for h in range(5)] + [("other", "2024-01-01 00:00:00", 9, 3600.0 * 100, 20.0)]
    schema = "phase string, ts string, event_id int, seconds double, rate_per_hour double"
    df = spark.createDataFrame(usage, schema).selectExpr("phase", "cast(ts as timestamp_ntz) ts", "event_id", "seconds", "rate_per_hour")
    got = [(r.phase, r.event_id, r.usd, r.cap) for r in sorted(cap_breaches(df).collect())]
    assert got == [("other", 9, 2000.0, 1500.0), ("pilot", 2, 300.0, 250.0), ("total", 9, 2100.0, 1500.0)]
    df.write.parquet(str(tmp_path / "u"))
    rows = run(spark, running_spend(spark.readStream.schema(df.schema).parquet(str(tmp_path / "u"))), "spend", "complete")
    assert {r.phase: (r.usd, r.over) for r in rows} == {"pilot": (500.0, True), "other": (2000.0, True), "total": (2500.0, True)}


def test_early_stop_judges_for_good(spark, tmp_path):
    """Steps before the base, many batches, a step beyond the lateness, and a state without judged steps."""
    d = [0.3, 0.31, 0.4, 0.5, 0.505, 0.5, 0.6, 0.6, 0.6, 0.61, 0.6, 0.6, 0.6, 0.6, 0.6, 0.6]
    rows = [("a", i - 3, x, 0.1, 0.9, 0.0) for i, x in enumerate(d)] + [("b", i, 0.1 + i / 10, 0.1, 0.9, 0.0) for i in range(9)]
    base = str(tmp_path / "run")
    order = [5, 0, 2, 1, 4, 3, 6, 8, 7, 10, 9, 11, 13, 12, 14, 15]
    a = [rows[i] for i in order]
    for i in range(0, 16, 3):
        write(spark, a[i : i + 3] + rows[16 + i // 2 : 16 + i // 2 + 1], EVALS, tmp_path / "in")
        stream = spark.readStream.schema(EVALS).parquet(str(tmp_path / "in"))
        out = drain(early_stop_alerts(stream, lateness=3), "update", base=base, latest_by="arm").collect()
    batch = {r.arm: (r.stop_step, r.n_evaluations) for r in early_stop(spark.createDataFrame(rows, EVALS)).collect()}
    assert [(r.arm, r.stop_step, r.n_evaluations, r.n_too_late) for r in out] == [("a", *batch["a"], 0)]
    state = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{base}/state")
    assert {(r.key.arm, r.user_map_key.step) for r in state.collect()} == {("a", 10), ("a", 11), ("a", 12), ("b", 6), ("b", 7)}  # judged steps are gone
    write(spark, [("a", 1, 9.9, 0.1, 0.9, 0.0)], EVALS, tmp_path / "in")
    late = drain(early_stop_alerts(spark.readStream.schema(EVALS).parquet(str(tmp_path / "in")), lateness=3), "update", base=base, latest_by="arm").collect()
    assert [(r.stop_step, r.n_evaluations, r.n_too_late) for r in late] == [(batch["a"][0], 17, 1)]


def test_early_stop_forgets_idle_arms(spark, tmp_path):
    write(spark, [("a", i, 0.5, 0.1, 0.9, 0.0) for i in range(3)], EVALS, tmp_path / "in")
    alerts = early_stop_alerts(spark.readStream.schema(EVALS).parquet(str(tmp_path / "in")), expiry_ms=4_000)
    query = alerts.writeStream.format("memory").queryName("forgetful").outputMode("update").start()
    try:
        for _ in range(60):
            time.sleep(1)
            if any(p["numInputRows"] for p in query.recentProgress) and time.sleep(6) is None:
                break
        write(spark, [("a", i, 0.5, 0.1, 0.9, 0.0) for i in range(3, 6)], EVALS, tmp_path / "in")
        for _ in range(30):
            time.sleep(1)
            if sum(p["numInputRows"] > 0 for p in query.recentProgress) > 1:
                break
    finally:
        query.stop()
    assert spark.table("forgetful").count() == 0  # with the first three steps remembered, step 4 would be the stop


def test_breach_events(spark, tmp_path):
    """Usage in mixed order over several runs: each cap falls once, at the usage that the batch form finds."""
    rng = random.Random(6)
    rows = [(rng.choice("abc"), f"2024-01-0{1 + k // 60} {k // 60 % 24:02}:{k % 60:02}:00", k, rng.uniform(0, 90)) for k in range(300)]
    schema = "phase string, ts string, event_id long, seconds double"
    caps, base = {"a": 20.0, "b": 1e9, "c": 15.0}, str(tmp_path / "run")
    usage = lambda df: df.selectExpr("phase", "cast(ts as timestamp_ntz) ts", "event_id", "seconds", "20.0D as rate_per_hour")
    want = {(r.phase, r.event_id, round(r.usd, 9)) for r in cap_breaches(usage(spark.createDataFrame(rows, schema)), caps, 40.0).collect()}
    assert {w[0] for w in want} == {"a", "c", "total"}
    sizes = []
    for part in range(5):
        some = rows[part * 60 : part * 60 + 60]
        rng.shuffle(some)
        write(spark, some[:30], schema, tmp_path / "in")
        write(spark, some[30:], schema, tmp_path / "in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = drain(breach_events(usage(stream), caps, 40.0, "3 hours"), "append", base=base).collect()
        sizes.append(len(out))
    assert {(r.phase, r.event_id, round(r.usd, 9)) for r in out} == want and len(out) == 3
    assert sizes == sorted(sizes) and sizes[0] < 3  # events came in more than one run


@pytest.fixture
def lines(spark, tmp_path):
    rows = [("f", "edge", f"(2024-01-01 0{h}:00:00) {text}") for h, text in [(0, "crontab -e"), (0, "useradd bob; crontab -l"), (3, "ls"), (5, "sudo id")]] + [("f", "edge", "sudo without time")]
    write(spark, rows, "rel_path string, representation string, line string", tmp_path / "l")
    return spark.readStream.schema("rel_path string, representation string, line string").parquet(str(tmp_path / "l"))


def test_log_stream(spark, lines):
    hits = run(spark, indicator_hits(lines), "hits", "append")
    assert sorted(r.technique for r in hits) == ["Create Account", "Scheduled Task/Job", "Scheduled Task/Job", "Valid Accounts", "Valid Accounts"]


def test_windowed_hits(spark, lines):
    counts = drain(hit_counts(indicator_hits(lines)), "append").collect()
    assert {(str(r.window_start)[11:16], r.technique): r.n_hits for r in counts} == {  # the window of 05:00 is still open
        ("00:00", "Scheduled Task/Job"): 2, ("00:00", "Create Account"): 1,
    }


def test_no_batch_gives_an_empty_table(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema("rel_path string, representation string, line string").parquet(str(tmp_path / "none"))
    assert drain(hit_counts(indicator_hits(stream)), "append").count() == 0
