"""What reaches the driver, and what one task holds."""

import random
from collections import Counter
from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tracewright.operators import components as G
from tracewright.operators import matching as M
from tracewright.operators import sampling as SA
from tracewright.plans import catalog
from tracewright.session import LLM_CONF, RUNTIME_CONF, configure, cut_lineage
from tracewright.streaming.spend import Breach


def joined(spark, n):
    side = lambda: cut_lineage(spark.range(n).select("id", F.md5(F.col("id").cast("string")).alias("text")))
    return side().join(side().withColumnRenamed("text", "other"), "id")._jdf.queryExecution().executedPlan().toString()


def test_only_small_tables_pass_through_the_driver(spark):
    """Some megabytes a side are shuffled: a plan with a score of such joins would hold all of them in the driver at once."""
    assert "BroadcastHashJoin" in joined(spark, 1_000)
    assert "BroadcastHashJoin" not in joined(spark, 100_000)


def test_operators_on_texts_keep_their_threshold(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    try:
        for name, want in (("inventory_summary", RUNTIME_CONF), ("op5_rendezvous_sharding", LLM_CONF)):
            entry_module.queries()[name](spark, "/root/testdata/sf0.001")
            assert spark.conf.get(key) == want[key]
    finally:
        configure(spark)


def test_larger_tables_make_more_tasks_not_larger_ones(spark):
    """Shuffled rows are read some megabytes at a time, however few cores there are."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "200")
    try:
        rows = lambda n: spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
        few, many = (rows(n).repartition("id").rdd.getNumPartitions() for n in (10_000, 1_000_000))
        assert few <= spark.sparkContext.defaultParallelism + 1 < many - 1, (few, many)
    finally:
        spark.conf.set(key, before)


def written(monkeypatch, module):
    """Optimized plans of the tables that ``module`` writes from now on."""
    plans = []

    def write(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut_lineage(df)

    monkeypatch.setattr(module, "cut_lineage", write)
    return plans


def test_a_round_of_components_makes_three_joins(spark, monkeypatch):
    """Each join shuffles both sides, and a shuffle is a job and a thread of the driver."""
    plans = written(monkeypatch, G)
    nodes = spark.createDataFrame([(x,) for x in "abcdefghxyz"], "node string")
    edges = spark.createDataFrame([tuple(p) for p in ("hg", "gf", "fe", "ed", "dc", "cb", "yx", "zz", "zq")], "a string, b string")
    got = {r.node: r.component for r in G.connected_components(nodes, edges).collect()}
    assert got == {"a": "a", "x": "x", "y": "x", "z": "z"} | dict.fromkeys("bcdefgh", "b")
    rounds = [p for p in plans if " AS old" in p or "old#" in p]
    assert len(rounds) > 1 and all(p.count("Join ") == 3 for p in rounds), rounds[0]


def test_closed_levels_of_draws_need_no_numbers(spark, monkeypatch):
    """The branches are counted from the cells; groups are numbered once, for the draws."""
    plans = written(monkeypatch, SA)
    rows = [(f"u{i}", "lm", ("positive", "benign")[i % 2], f"g{i % 5}", "edge") for i in range(40)]
    units = spark.createDataFrame(rows, "unit_id string, task string, label string, group_id string, representation string")
    drawn = SA.draw_units(units, 50, 3)
    assert len(plans) == 3 and "Join" not in plans[-1]
    assert drawn.count() == 50 and {r.kind for r in drawn.collect()} == {"positive", "benign"}


def test_findings_are_normalised_once(spark, monkeypatch):
    written_plans = written(monkeypatch, M)
    units = spark.createDataFrame(
        [("u", "user/1", 1, "edge", "lm", "lab", "linux")],
        "unit_id string, rel_path string, start_line long, representation string, task string, dataset string, os string",
    )
    findings = spark.createDataFrame(
        [("u", 0, 0, "lm", "2024-01-01 00:00:00", "h1", "HIGH_SUSPICIOUS", [1])],
        "unit_id string, attempt_id int, finding_index int, task string, timestamp string, entity string, verdict string, source_lines array<int>",
    )
    targets = spark.createDataFrame(
        [("u", "t", 0, "supported_positive", "2024-01-01 00:00:00", ["h1"])],
        "unit_id string, target_id string, target_order int, status string, stamp string, aliases array<string>",
    )
    lines = spark.createDataFrame([("user/1", 1, "(2024-01-01 00:00:00) ssh h1")], "rel_path string, line_no long, line string")
    out = M.assign_findings(findings, units, targets, lines)
    assert len(written_plans) == 1
    assert [(r.outcome, r.target_id) for r in out.collect()] == [("tp", "t")]


def test_groups_are_worked_out_once_for_the_invariants(spark, monkeypatch, tmp_path):
    docs = [(i, f"line {i % 9}\nend", "en" if i % 2 else "fr", "s", 10) for i in range(24)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(24)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    plans = written(monkeypatch, catalog)
    out = catalog.split_invariants(spark, str(tmp_path))
    assert sum("collect_set(task" in p for p in plans) == 1
    assert [r.n_conflicts for r in out.collect()] == [0]


class Kept:
    """Keyed state in a dictionary; every call of it is counted, as each is a round trip between Python and Spark."""

    def __init__(self, calls):
        self.calls, self.rows, self.value = calls, {}, None

    def __getattribute__(self, name):
        if name not in ("calls", "rows", "value"):
            self.calls[name] += 1
        return object.__getattribute__(self, name)

    exists = lambda self: self.value is not None
    get = lambda self: self.value
    containsKey = lambda self, k: tuple(k) in self.rows
    getValue = lambda self, k: self.rows[tuple(k)]
    removeKey = lambda self, k: self.rows.pop(tuple(k))
    clear = lambda self: self.rows.clear()

    def update(self, value):
        self.value = value

    def keys(self):
        return iter(list(self.rows))

    def updateValue(self, k, v):
        self.rows[tuple(k)] = v


def test_state_is_not_asked_for_each_row():
    """Usage in mixed order, with two rows of one moment: booked in order, by far fewer calls of the state than there are rows."""
    rng, calls, timers = random.Random(3), Counter(), []
    handle = SimpleNamespace(getValueState=lambda *_: Kept(calls), getMapState=lambda *_: Kept(calls), registerTimer=timers.append)
    usage = [(k * 7_000_000, k, rng.uniform(0, 1)) for k in range(10_000)]
    usage += [(usage[7][0], 7, 0.5), (usage[9][0], 3, 0.25)]
    spent, at = 0.0, {}
    for us, event_id, usd in usage:
        at[us, event_id] = at.get((us, event_id), 0.0) + usd
    for place in sorted(at):
        spent += at[place]
        if spent >= 3_000.0:
            break
    rng.shuffle(usage)
    judge, out = Breach(), []
    judge.init(handle)
    for part in range(4):
        rows = [Row(us=us, event_id=e, usd=usd, cap=3_000.0) for us, e, usd in usage[part::4]]
        out += judge.handleInputRows(("a",), iter(rows), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0))
    waited = SimpleNamespace(getCurrentWatermarkInMs=lambda: 30_000_000)
    out += judge.handleExpiredTimer(("a",), waited, None)
    assert not out and timers[-1] == 30_002_000_000 // 1000 + 1  # the usage that follows 30,000 s
    waited.getCurrentWatermarkInMs = lambda: 70_000_000
    out += judge.handleExpiredTimer(("a",), waited, None)
    assert [(r.event_id, r.usd) for r in out] == [(place[1], spent)]
    assert sum(calls.values()) < len(usage) / 10
