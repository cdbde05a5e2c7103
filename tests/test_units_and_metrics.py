import hashlib
import math
import random
from collections import Counter, defaultdict
from statistics import mean

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.operators import metrics as MT
from tracewright.operators import neardup as ND
from tracewright.operators import sampling as SA
from tracewright.operators import selection as SE
from tracewright.operators import splits as SP
from tracewright.operators import uncertainty as U
from tracewright.operators import windows as W

FILES = "rel_path string, sha256 string, task string, representation string, label string, lines long"


def test_window_borders_labels_and_slices(spark):
    sizes = {"edge": 4, "raw": 6}
    files = [("a", "sa", "lm", "edge", "attack", 4), ("b", "sb", "lm", "edge", "attack", 5), ("c", "sc", "lm", "raw", "benign", 13), ("d", "sd", "classification", "edge", "attack", 9), ("e", "se", "lm", "edge", "attack", 0)]
    df = spark.createDataFrame(files, FILES)
    windows = W.tumbling_windows(df, "v1", sizes)
    got = sorted((r.rel_path, r.window_index, r.start_line, r.end_line, r.n_lines) for r in windows.collect())
    assert got == [("a", 0, 1, 4, 4), ("b", 0, 1, 4, 4), ("b", 1, 5, 5, 1), ("c", 0, 1, 6, 6), ("c", 1, 7, 12, 6), ("c", 2, 13, 13, 1), ("d", 0, 1, 9, 9)]
    evidence = spark.createDataFrame(
        [("a", 4, "t0", "ambiguous"), ("b", 4, "t1", "supported_positive"), ("b", 4, "t2", "ambiguous"), ("b", 5, "t2", "ambiguous"), ("c", 7, "t3", "supported_positive")],
        "rel_path string, line_no long, target_id string, status string",
    )
    units = W.label_windows(windows, W.window_targets(evidence, df, sizes))
    labels = {(r.rel_path, r.window_index): r.label for r in units.collect()}
    assert labels == {("a", 0): "quarantined", ("b", 0): "positive", ("b", 1): "quarantined", ("c", 0): "benign", ("c", 1): "benign", ("c", 2): "benign", ("d", 0): "attack"}
    lines = spark.createDataFrame([(f[0], i, f"{f[0]}{i}") for f in files for i in range(1, f[5] + 1)], "rel_path string, line_no long, line string")
    slices = {(r.rel_path, r.window_index): r.slice for r in W.window_slices(lines, df, sizes).collect()}
    assert slices[("b", 1)] == "b5\n" and slices[("c", 1)] == "".join(f"c{i}\n" for i in range(7, 13)) and len(slices) == 6
    shifted = W.shifted_windows(units, evidence, df, "v1", shifts=(-2, 2)).collect()
    assert sorted((r.start_line, r.end_line, r.label, r.weight) for r in shifted) == [(1, 2, "negative_attack_file", 0.5), (3, 5, "positive", 0.5)]


def test_template_text(spark):
    units = spark.createDataFrame([("u", "lm", "edge", "lab", "linux", 7)], "unit_id string, task string, representation string, dataset string, os string, n_lines long")
    templates = spark.createDataFrame([("lm", "edge", "lab", "linux", "{task} on {os}: {n_lines} lines")], "task string, representation string, dataset string, os string, template string")
    assert W.render_text(units, templates).first().text == "lm on linux: 7 lines"


def test_templates_take_any_name(spark):
    schema = "unit_id string, task string, representation string, dataset string, os string, n_lines long, note string, tags array<string>"
    units = spark.createDataFrame([("u", "lm", "edge", "lab", "linux", 7, "{task} $1 \\ x", []), ("v", "classification", "raw", "optc", None, None, None, None), ("w", "persistence", "raw", "lab", "linux", 1, "n", [])], schema)
    rows = [("lm", None, None, None, "{note}|{n_lines}{n_lines}|{twice}|{tags}|{ task}|{"), ("lm", None, "lab", None, "{note}|{twice}{nope}{nope}|{entity_field}|{{os}}"), ("classification", None, None, None, "{os}{n_lines}[{entity_field}] {required_fields}"), (None, None, None, "windows", "never")]
    templates = spark.createDataFrame(rows, "task string, representation string, dataset string, os string, template string")
    got = {r.unit_id: (r.text, r.unknown_names) for r in W.render_text(units, templates, twice=F.col("n_lines") * 2).collect()}
    assert got == {"u": ("{task} $1 \\ x|14{nope}{nope}|external_host|{linux}", ["nope"]), "v": ("[] verdict, source_lines", [])}
    parsed = W.parse_templates(templates).orderBy("template").first()
    assert "".join(a + ("{" + b + "}" if b else "") for a, b in zip(parsed.literals, [*parsed.names, None])) == parsed.template


def group_rows(n, seed):
    rng = random.Random(seed)
    tasks = [["lm"], ["lm", "persistence"], ["classification", "exfiltration", "lm", "persistence"], ["exfiltration"]]
    return [(f"g{i:04d}", rng.choice(["lab", "optc"]), rng.choice(["attack", "benign", "mixed"]), rng.choice(tasks), rng.choice([["linux"], ["windows"], ["linux", "windows"]])) for i in range(n)]


def test_allocation_deals_every_group_by_quota(spark):
    rows = group_rows(400, 5)
    groups = spark.createDataFrame(rows, "group_id string, dataset string, label string, tasks array<string>, os array<string>")
    ladder = [(0.5, 0.1, 0.4), (0.5, 0.2, 0.3)]
    assignment, chosen, attempts = SP.allocate(groups, ladder, seed=9, n_candidates=60)
    split = {r.group_id: r.split for r in assignment.collect()}
    assert set(split) == {r[0] for r in rows}
    strata = defaultdict(list)
    for r in rows:
        strata[(r[1], r[2], tuple(r[3]), tuple(r[4]))].append(split[r[0]])
    best = chosen.first()
    for members in strata.values():
        counts = Counter(members)
        for name, f in zip(SP.SPLITS, ladder[best.rung]):
            assert math.floor(f * len(members)) <= counts[name] <= math.floor(f * len(members)) + 1
    # the score of the chosen candidate, worked out from the assignment
    cells = defaultdict(Counter)
    for g, dataset, label, tasks, os in rows:
        for cell in [("d", dataset)] + [("o", o) for o in os] + [("t", t, "attack" if label == "attack" else "benign") for t in tasks]:
            cells[cell][split[g]] += 1
    score = sum((c[s] / sum(c.values()) - f) ** 2 for c in cells.values() for s, f in zip(SP.SPLITS, ladder[best.rung]))
    assert best.score == pytest.approx(score, abs=1e-8)
    log = {r.rung: r for r in attempts.collect()}
    assert set(log) == {0, 1} and log[best.rung].candidate == best.candidate
    missing = [r for r in SP.constraint_violations(groups, assignment, 2, 2).collect()]
    assert len(missing) == best.n_violations


def unit_rows_fixture(seed=1, n=400):
    rng = random.Random(seed)
    tasks = ["lm", "persistence", "exfiltration"]
    rows = []
    for i in range(n):
        label = rng.choice(["positive", "negative_attack_file", "benign", "quarantined"])
        rows.append((f"u{i:04d}", rng.choice(tasks), label, f"g{rng.randrange(30)}", rng.choice(["edge", "raw"])))
    rows += [(f"c{i}", "classification", rng.choice(["attack", "benign"]), f"g{rng.randrange(9)}", "edge") for i in range(60)]
    return rows


UNITS = "unit_id string, task string, label string, group_id string, representation string"


def test_unit_probabilities_and_draws(spark):
    rows = unit_rows_fixture()
    units = spark.createDataFrame(rows, UNITS)
    probs = {r.unit_id: r.probability for r in SA.unit_probabilities(units).collect()}
    assert sum(probs.values()) == pytest.approx(1.0)
    # every level shares the mass of the one above equally
    known = [(r[1], r[2] in ("positive", "attack"), "" if r[2] in ("positive", "attack") else r[2], r[3], r[4], r[0]) for r in rows if r[2] != "quarantined"]
    assert set(probs) == {k[-1] for k in known}
    for depth in range(1, 7):
        mass = defaultdict(float)
        for k in known:
            mass[k[:depth]] += probs[k[-1]]
        siblings = defaultdict(list)
        for k, v in mass.items():
            siblings[k[:-1]].append(v)
        assert all(max(v) == pytest.approx(min(v)) for v in siblings.values())
    expected = probs
    n = 4000
    draws = SA.draw_units(units, n, seed=3)
    got = draws.collect()
    assert sorted(r.draw_index for r in got) == list(range(n))
    assert all(r.probability == pytest.approx(expected[r.unit_id]) for r in got)
    assert all(0.22 < c / n < 0.28 for c in Counter(r.task for r in got).values())
    assert all(0.10 < c / n < 0.15 for c in Counter((r.task, r.cls) for r in got).values())
    assert sum(r.frequency for r in SA.exposure_by_task(draws).collect()) == pytest.approx(1.0)
    drawn = {r.group_id for r in got}
    never = {r.group_id for r in SA.groups_never_drawn(draws, units).collect()}
    assert never == {r[3] for r in rows if r[2] != "quarantined"} - drawn
    slices = units.select("unit_id", F.lit("text").alias("slice"))
    assert SA.materialise_draws(draws, slices, n).filter("draw_index = 7").first().name.startswith("0007_")


def test_missing_strata(spark):
    units = spark.createDataFrame([("a", "lm", "positive", "g", "edge"), ("b", "lm", "quarantined", "g", "edge")], UNITS)
    got = {(r.task, r.cls) for r in SA.missing_strata(units).collect()}
    assert ("lm", "positive") not in got and ("lm", "negative") in got and len(got) == 7


def test_hierarchical_mean_and_dev_score(spark):
    rng = random.Random(4)
    rows = []
    for i in range(500):
        task = rng.choice(["lm", "persistence", "exfiltration", "classification"])
        valid = rng.random() < 0.8
        rows.append((
            f"u{i % 90}{task}", task, f"g{(i % 90) % 11}", "edge" if i % 2 else "raw", i % 90 < 45, rng.choice([0.0, 1.0]), float(valid and rng.random() < 0.5), valid,
            valid and rng.random() < 0.4, rng.random() if valid and rng.random() < 0.7 else None,
        ))
    df = spark.createDataFrame(rows, "unit_id string, task string, grp string, rep string, positive boolean, reward double, strict double, valid boolean, alert boolean, recall double")
    df = df.withColumn("fp_free_recall", F.col("recall"))

    def group_mean(pairs):
        frame = pd.DataFrame([(r[2], r[3], r[0], v) for r, v in pairs], columns=["grp", "rep", "unit", "v"]).dropna()
        for keys in (["grp", "rep", "unit"], ["grp", "rep"], ["grp"]):
            frame = frame.groupby(keys, as_index=False)["v"].mean()
        return frame["v"].mean()

    score = {r.task: r for r in MT.dev_score(df).collect()}
    for task in ("lm", "classification"):
        here = [r for r in rows if r[1] == task]
        pos, neg = [r for r in here if r[4]], [r for r in here if not r[4]]
        strict = task == "classification"
        assert score[task].P == pytest.approx(group_mean([(r, r[6] if strict else r[9]) for r in pos]))
        assert score[task].N == pytest.approx(group_mean([(r, r[6] if strict else float(r[7] and not r[8])) for r in neg]))
        assert score[task].false_alert_rate == pytest.approx(group_mean([(r, float(r[8])) for r in neg]))
        assert score[task].validity == pytest.approx(mean(float(r[7]) for r in here))
    assert score["*"].false_alert_rate == pytest.approx(group_mean([(r, float(r[8])) for r in rows if not r[4]]))
    d = MT.overall_d(MT.dev_score(df)).first()
    assert d.D == pytest.approx(mean((score[t].P + score[t].N) / 2 for t in score if t != "*")) and d.available_tasks == 4
    assert MT.overall_d(MT.dev_score(df.filter("task <> 'lm'"))).first().D is None


def evaluate(spark, rows):
    return spark.createDataFrame(rows, "arm string, step int, D double, false_alert_rate double, validity double, positive_recall double")


def test_selection_and_early_stop(spark):
    def arm(name, ds, **bad):
        return [(name, 10 * i, d, bad.get(f"f{i}", 0.1), bad.get(f"v{i}", 0.9), 0.1 + 0.1 * i) for i, d in enumerate(ds)]

    rows = (
        arm("rises", [0.5, 0.6, 0.7, 0.7, None]) + arm("flat", [0.5, 0.505, 0.505, 0.509, 0.509]) + arm("barred", [0.5, 0.9, 0.8], f1=0.13, v2=0.88)
        + arm("creeps", [0.5, 0.505, 0.509, 0.511, 0.512, 0.513, 0.514]) + arm("first_out", [None, 0.5, 0.4, 0.4, 0.4])
    )
    picked = {r.arm: r for r in SE.select_step(evaluate(spark, rows)).collect()}
    assert (picked["rises"].selected_step, picked["rises"].selected_D, picked["rises"].manipulation_check_passed) == (20, 0.7, True)
    assert picked["flat"].selected_step == 30 and not picked["flat"].manipulation_check_passed
    assert (picked["barred"].selected_step, picked["barred"].base_D) == (0, 0.5)
    stops = {r.arm: r.stop_step for r in SE.early_stop(evaluate(spark, rows)).collect()}
    assert stops == {"rises": None, "flat": 40, "barred": None, "creeps": None, "first_out": None}
    reasons = {r.step: r.reasons for r in SE.eligible_steps(evaluate(spark, rows)).filter("arm = 'barred'").collect()}
    assert reasons == {0: [], 10: ["false-alert rate above base"], 20: ["validity below base"]}


def test_uncertainty(spark):
    groups = spark.createDataFrame([(f"g{i}", 0.2, 0.2 + 0.01 * (i % 5)) for i in range(40)] + [("x", None, 0.3)], "grp string, value_a double, value_b double")
    r = U.paired_bootstrap(groups, n_draws=400, seed=1).first()
    assert r.low < r.observed < r.high and r.n_missing == 0 and r.n_draws == 400 and r.n_groups == 41
    lonely = U.paired_bootstrap(spark.createDataFrame([("g", 1.0, 2.0)], "grp string, value_a double, value_b double"), n_draws=1000).first()
    assert 0.3 < lonely.missing_share < 0.43 and lonely.low == lonely.high == 1.0
    weights = spark.range(20000).select(U.poisson_weight(U.uniform(F.col("id"))).alias("w"))
    assert weights.agg(F.avg("w")).first()[0] == pytest.approx(1.0, abs=0.03) and weights.agg(F.var_pop("w")).first()[0] == pytest.approx(1.0, abs=0.05)
    tries = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 0.0), ("b", 0.0)], "unit_id string, strict double")
    assert {r.unit_id: (r.pass_at_1, r.pass_at_k) for r in U.pass_at_k(tries).collect()} == {"a": (0.5, 1), "b": (0.0, 0)}


def test_near_duplicates_and_families(spark):
    base = [f"line {i}" for i in range(8)]
    texts = {
        "a": base, "b": base[:6] + ["x", "y"], "c": ["z"] + base[2:], "copy": base, "far": [f"other {i}" for i in range(8)], "short": ["line 1", "line 2"],
        "short copy": ["line 1", "line 2"], "one": ["a single line"], **{f"many{i}": [f"head {i}", "m1", "m2", "m3", f"tail {i}"] for i in range(50)},
    }
    df = spark.createDataFrame([(k, "\n".join(v)) for k, v in texts.items()], "rel_path string, text string").withColumn("sha256", F.sha2("text", 256))
    names = {r.sha256: r.rel_path for r in df.filter("rel_path not in ('copy', 'short copy')").collect()}
    runs = lambda v: {tuple(v[i:i + 3]) for i in range(max(1, len(v) - 2))}
    links = ND.near_duplicate_links(df).collect()
    assert all(r.a < r.b and 0 < r.n_shared <= len(runs(texts[names[r.a]]) & runs(texts[names[r.b]])) for r in links)
    assert len([r for r in links if names[r.a].startswith("many")]) == 49  # a star, not all pairs
    family = {r.rel_path: r.family for r in ND.families(df).collect()}
    groups = defaultdict(set)
    for name, f in family.items():
        groups[f].add(name)
    assert sorted(map(len, groups.values())) == [1, 1, 2, 4, 50] and {"a", "b", "c", "copy"} in groups.values() and {"short", "short copy"} in groups.values()
    listed = ND.line_shingles(df.filter("rel_path like 'many%'")).groupBy("shingle").count().filter("count > 1")
    assert len({r.family for r in ND.families(df, boilerplate=listed).filter("rel_path like 'many%'").collect()}) == 50


@pytest.mark.parametrize("unit,k", [("word", 5), ("line", 3)])
def test_similar_contents(spark, unit, k):
    """All pairs of 0.8 and more are found, copies are one content, and a run that all files hold links none."""
    rng = random.Random(k)
    end = "\n" if unit == "line" else " "
    common = [f"common {i}" for i in range(9)]
    texts = []
    for g in range(30):
        base = [f"log {g} {rng.randrange(9)}" for _ in range(60)]
        for c in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(60)] = f"changed {rng.randrange(10**9)}"
            texts.append(end.join(common + copy))
    texts += [end.join(common), "", " \n ", "one", "one", "a b"] + [end.join(common + [f"only {i}"] * 4) for i in range(5)] + texts[:4]
    rows = [(f"f{i}", hashlib.sha256(t.encode()).hexdigest(), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "rel_path string, sha256 string, text string").repartition(6)

    pieces = lambda t: t.split("\n") if unit == "line" else t.split()
    runs = {s: {tuple(pieces(t)[i : i + k]) for i in range(max(1, len(pieces(t)) - k + 1))} if t.strip() else set() for _, s, t in rows}
    held = Counter(r for v in runs.values() for r in v)
    runs = {s: {r for r in v if held[r] < 10 or held[r] <= 0.05 * len(runs)} for s, v in runs.items()}
    content = {}
    for s in sorted(runs):
        content.setdefault(frozenset(runs[s]) or s, s)
    names = sorted(c for v, c in content.items() if isinstance(v, frozenset))
    want = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            shared, every = len(runs[a] & runs[b]), len(runs[a] | runs[b])
            if shared >= 0.8 * every:
                want[a, b] = (shared, every)
    members, pairs = ND.similar_contents(ND.run_sets(df, k, unit))
    assert {r.sha256: r.content for r in members.collect()} == {s: content[frozenset(v) or s] for s, v in runs.items()}
    found = [((r.a, r.b), (r.n_shared, r.n_all)) for r in pairs.collect()]
    assert len(found) == len(dict(found)) and set(found) <= set(want.items())
    assert len(want) > 30 and len(found) >= 0.99 * len(want)
    family = {r.rel_path: r.family for r in ND.similar_families(df, k=k, unit=unit).collect()}
    assert len(family) == len(rows)
    groups = {g: {family[f"f{g * 6 + c}"] for c in range(6)} for g in range(30)}
    assert all(not groups[g] & groups[h] for g in groups for h in groups if g < h)  # what all files share links none


def test_similar_contents_of_nothing(spark):
    none = spark.createDataFrame([], "rel_path string, sha256 string, text string")
    assert ND.similar_families(none).count() == 0 and ND.similar_contents(ND.run_sets(none))[1].count() == 0


def test_grouped_bootstrap(spark):
    """The same draws in numpy, one group at a time; null groups and values; an arm that some draws leave without a group."""
    rng = random.Random(9)
    rows = [(f"g{i}", rng.random() if rng.random() < 0.9 else None, rng.random() if i < 3 else None) for i in range(40)] + [(None, 0.5, None)]
    df = spark.createDataFrame(rows, "grp string, value_a double, value_b double").repartition(5)
    draws = U.draw_keys(700, 4)
    diffs, missing = [], 0
    for b in range(700):
        sums = {"a": [0.0, 0.0], "b": [0.0, 0.0]}
        for g, a, v in rows:
            key = int(hashlib.md5(f"4|{g}".encode() if g else b"4").hexdigest()[:8], 16) >> 1
            x = (key ^ int(draws[b])) * U.SPREAD[0]
            x = ((((x >> 31) ^ (x & 0x7FFFFFFF)) * U.SPREAD[1]) >> 31) & 0xFFFFFF
            w = sum(x >= step for step in U.WEIGHT_STEPS)
            for arm, value in (("a", a), ("b", v)):
                if value is not None:
                    sums[arm][0] += w * value
                    sums[arm][1] += w
        if sums["a"][1] and sums["b"][1]:
            diffs.append(sums["b"][0] / sums["b"][1] - sums["a"][0] / sums["a"][1])
        else:
            missing += 1
    r = U.grouped_bootstrap(df, 700, seed=4).first()
    low, high = pd.Series(diffs).quantile([0.025, 0.975])
    assert (r.n_missing, r.n_draws, r.n_groups) == (missing, 700, 41) and missing > 10
    assert math.isclose(r.low, low, rel_tol=1e-9) and math.isclose(r.high, high, rel_tol=1e-9)
    weights = U.poisson_weights(U.draw_keys(300, 1), U.draw_keys(300, 2))
    assert abs(weights.mean() - 1) < 0.02 and abs(weights.var() - 1) < 0.03
    assert U.grouped_bootstrap(df.limit(0), 20).first().n_missing == 20
