import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewright.operators import components as G
from tracewright.operators import edges as ED
from tracewright.operators import evidence as E
from tracewright.operators import inventory as I
from tracewright.operators import scale

SCHEMA = (
    "ordinal long, rel_path string, filename string, dataset string, task string, representation string, host string, os string, label string, "
    "scenario string, scenario_key string, window_start string, window_end string, sha256 string, lines long"
)


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a in parent and b in parent:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {n: find(n) for n in nodes}


def files_fixture(spark, n=120, seed=3):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        dataset = rng.choice(["lab", "optc"])
        host = None if dataset == "lab" else rng.choice(["h001", "h002", "h003"])
        task = rng.choice(["lm", "classification", "exfiltration"])
        k = rng.randrange(40)
        scenario = f"attack-linux-lmscenario{k}" if task == "classification" else f"{task}-scenario{k}"
        s = start + timedelta(minutes=rng.randrange(20_000))
        e = s + timedelta(minutes=rng.choice([1, 5, 30, 3000]))
        key = f"{dataset}/" + "_".join(x for x in (host, scenario) if x)
        rows.append((
            i, f"f{i:03d}", f"{i}.log", dataset, task, "edge", host, rng.choice(["linux", "windows"]), rng.choice(["attack", "benign"]), scenario, key,
            str(s), str(e), f"sha{rng.randrange(100)}", 10,
        ))
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("bucket", [600, 86_400])
def test_overlap_pairs_and_links(zoned, bucket):
    rows, files = files_fixture(zoned)
    expected = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            if (a[3], a[7], a[6]) == (b[3], b[7], b[6]) and a[10] != b[10] and a[11] <= b[12] and b[11] <= a[12]:
                expected.add((a[1], b[1]))
    pairs = ED.overlap_edges(files, bucket_seconds=bucket).collect()
    assert len(pairs) == len(expected) and {(p.a, p.b) for p in pairs} == expected
    links = [(r.a, r.b) for r in ED.overlap_links(files, bucket_seconds=bucket).collect()]
    assert len(links) < len(rows)
    nodes = [r[1] for r in rows]
    same_key = [(a[1], b[1]) for a in rows for b in rows if a[10] == b[10]]
    assert union_find(nodes, links + same_key) == union_find(nodes, list(expected) + same_key)


def test_star_edges(spark):
    rows, files = files_fixture(spark)
    edges = ED.same_key_edges(files).collect()
    assert len(edges) == len(rows) - len({r[10] for r in rows})
    first = {}
    for r in rows:
        first.setdefault(r[13], r[1])
    got = {(e.a, e.b) for e in ED.identical_content_edges(files).collect()}
    assert got == {(first[r[13]], r[1]) for r in rows if first[r[13]] != r[1]}


def test_campaign_links_have_the_components_of_all_pairs(spark):
    rows, files = files_fixture(spark)
    attack = [r for r in rows if r[3] == "optc" and r[8] == "attack"]
    nodes = [r[1] for r in rows]
    same_key = [(a[1], b[1]) for a in rows for b in rows if a[10] == b[10]]
    for strengths in (["strong"], ["strong", "weak"]):
        pairs = [
            (a[1], b[1]) for a in attack for b in attack
            if a[11][:10] == b[11][:10] and a[10] != b[10] and (a[6] == b[6] or "weak" in strengths)
        ]
        links = [(e.a, e.b) for e in ED.campaign_day_links(files).filter(F.col("strength").isin(strengths)).collect()]
        assert union_find(nodes, links + same_key) == union_find(nodes, pairs + same_key)


def test_annotation_edges(spark):
    rows, files = files_fixture(spark)
    anns = [(r[3], r[4], r[9], [r[11], r[12][:16]]) for r in rows[::4]] + [("lab", "lm", "nowhere", [rows[0][11]])]
    annotations = spark.createDataFrame(anns, "dataset string, task string, scenario string, timestamps array<string>")
    strong, notes = set(), set()
    for d, t, s, stamps in anns:
        home = [r for r in rows if (r[3], r[4], r[9]) == (d, t, s)]
        for ts in stamps:
            full = ts if len(ts) == 19 else ts + ":00"
            for r in rows:
                if r[3] != d or r[9] == s or (home and (r[7], r[6]) != (home[0][7], home[0][6])) or not r[11] <= full <= r[12]:
                    continue
                for h in home:
                    if h[1] != r[1]:
                        strong.add(tuple(sorted((h[1], r[1]))))
                if not home:
                    notes.add((r[1], f"annotation:{d}/{s}"))
    got = ED.distinct_edges(ED.annotation_time_edges(files, annotations)).collect()
    assert {(e.a, e.b) for e in got if e.strength == "strong"} == strong
    assert {(e.a, e.b) for e in got if e.strength == "note"} == notes and notes


def test_linear_edges_have_the_components_of_all_edges(spark):
    rows, files = files_fixture(spark)
    anns = [(r[3], r[4], r[9], [r[11], r[12][:16]]) for r in rows[::3]]
    annotations = spark.createDataFrame(anns, "dataset string, task string, scenario string, timestamps array<string>")
    roots, sizes = [], []
    for linear in (False, True):
        edges = [(e.a, e.b) for e in ED.build_edges(files, annotations, linear).filter("strength = 'strong'").collect()]
        roots.append(union_find([r[1] for r in rows], edges))
        sizes.append(len(edges))
    assert roots[0] == roots[1] and sizes[0] > sizes[1]


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    n = 300
    nodes = [f"n{i:04d}" for i in range(n)]
    rng = random.Random(7)
    if shape == "path":
        order = rng.sample(nodes, n)
        edges = list(zip(order, order[1:]))
    elif shape == "star":
        edges = [(nodes[150], x) for x in nodes[: n - 20]]
    else:
        edges = [tuple(rng.sample(nodes, 2)) for _ in range(160)]
    edges += [("n0001", "unknown"), ("unknown", "n0299"), ("n0005", "n0005")]
    got = G.connected_components(spark.createDataFrame([(x,) for x in nodes], "node string"), spark.createDataFrame(edges, "a string, b string"))
    assert {r.node: r.component for r in got.collect()} == union_find(nodes, edges)


def test_groups(spark):
    rows, files = files_fixture(spark)
    edges = ED.build_edges(files, spark.createDataFrame([], "dataset string, task string, scenario string, timestamps array<string>"), linear=True)
    mapping = G.group_files(files, edges)
    got = {r.rel_path: r.group_id for r in mapping.collect()}
    roots = union_find([r[1] for r in rows], [(e.a, e.b) for e in edges.filter("strength = 'strong'").collect()])
    names = {}
    for r in rows:
        names[roots[r[1]]] = min(names.get(roots[r[1]], "~"), "g:" + r[10])
    assert got == {r[1]: names[roots[r[1]]] for r in rows}
    table = {r.group_id: r for r in G.group_table(files, mapping).collect()}
    assert sum(r.n_files for r in table.values()) == len(rows)
    members = G.group_members(files, mapping)
    assert members.filter("kind = 'file'").count() == len(rows)


def test_profile_of_a_file_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(I, "row_chunk", lambda c: scale.row_chunk(c, 3))
    rng = random.Random(1)
    rows, expected = [], {}
    for f in ("a", "b", "c"):
        prev, bad, fail, seen = None, 0, 0, []
        for i in range(1, 40):
            t = None if rng.random() < 0.3 or f == "c" else datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(50))
            rows.append((f, "edge", i, f"({t}) x" if t else "no time"))
            if t is None:
                fail += 1
                continue
            bad += prev is not None and t < prev
            prev = t
            seen.append(t)
        expected[f] = (39, ["iso"] if seen else [], seen[0] if seen else None, seen[-1] if seen else None, fail, bad)
    lines = spark.createDataFrame(rows, "rel_path string, representation string, line_no long, line string")
    got = {r.rel_path: tuple(r)[1:] for r in I.time_profile(I.timed_lines(lines)).collect()}
    assert got == expected


def test_chunked_row_number(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), i) for i in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k string, pos long")
    got = scale.chunked_row_number(df, ["k"], ["pos"], scale.row_chunk(F.col("pos"), 64), "rn").collect()
    for k in "abc":
        ordered = sorted(p for key, p in rows if key == k)
        assert {r.pos: r.rn for r in got if r.k == k} == {p: i + 1 for i, p in enumerate(ordered)}


def test_dyadic_cover_is_exact_and_small(spark):
    rng = random.Random(12)
    spans = [(0, 0), (5, 4), (-7, 9), (-8, -1), (3, 3), (0, 2**38)] + [tuple(sorted((rng.randint(-500, 500), rng.randint(-500, 500)))) for _ in range(200)]
    spans += [(1_700_000_001, 1_700_000_001 + 10 * 365 * 86_400)]
    df = spark.createDataFrame(spans, "s long, e long").select("s", "e", scale.dyadic_cover(F.col("s"), F.col("e")).alias("c"))
    for r in df.collect():
        blocks = sorted((b.block << b.level, (b.block + 1) << b.level) for b in r.c)
        assert len(blocks) <= 64
        if r.s > r.e:
            assert not blocks
            continue
        assert blocks[0][0] == r.s and blocks[-1][1] == r.e + 1
        assert all(x[1] == y[0] for x, y in zip(blocks, blocks[1:]))  # next to one another, without overlap


@pytest.mark.parametrize("unit", [1, 60])
def test_points_in_intervals(spark, unit):
    rng = random.Random(unit)
    points = [(i, rng.choice(["a", "b", None]), rng.randint(-900, 900)) for i in range(150)] + [(900, "a", None)]
    spans = [(i, rng.choice(["a", "b", None]), s, s + rng.choice([0, 1, 7, 300, 2000, -3])) for i in range(80) for s in [rng.randint(-900, 900)]]
    got = scale.in_interval(
        spark.createDataFrame(points, "p long, k string, t long"), spark.createDataFrame(spans, "i long, k string, s long, e long"), "t", "s", "e", ["k"], unit
    ).collect()
    assert sorted((r.p, r.i) for r in got) == sorted((p, i) for p, k, t in points for i, m, s, e in spans if t is not None and k == m and s <= t <= e)


def test_target_details(spark):
    """Merged hosts keep the union of user names; other targets keep all keys of their record; values come once."""
    rows = [
        ("optc", "lm", "s", 0, ["t1", "t2"], ["h1", "h9"], {"username": ["b", "a"], "method": ["ssh"]}),
        ("optc", "lm", "s", 1, ["t2"], ["h1"], {"username": ["c", None, "a"]}), ("optc", "lm", "s", 2, ["t3"], ["h2"], None),
        ("lab", "persistence", "p", 0, ["t4"], ["Create Account", "Valid Accounts"], {"method": ["x", "x"], "note": []}),
        ("lab", "lm", "q", 0, ["2024-01-01 00:00", "2024-01-01 00:00:00"], ["h3"], {"username": ["u"], "note": ["n"]}),
    ]
    schema = "dataset string, task string, scenario string, record_index long, timestamps array<string>, entities array<string>, extra map<string, array<string>>"
    annotations = spark.createDataFrame(rows, schema)
    details = E.target_details(annotations)
    got = {}
    for r in details.collect():
        got.setdefault(r.target_id, []).append((r.key, r.value))
    assert {k: sorted(v) for k, v in got.items()} == {
        "optc:lm:s:0": [("timestamps", "t1"), ("timestamps", "t2"), ("usernames", "a"), ("usernames", "b"), ("usernames", "c")],
        "optc:lm:s:1": [("timestamps", "t3")],
        "lab:persistence:p:0": [("method", "x"), ("timestamps", "t4")], "lab:persistence:p:1": [("method", "x"), ("timestamps", "t4")],
        "lab:lm:q:0": [("note", "n"), ("timestamps", "2024-01-01 00:00"), ("timestamps", "2024-01-01 00:00:00"), ("username", "u")],
    }
    records = {r.target_id: (r.timestamps, r.extra) for r in E.target_records(E.build_targets(annotations)[0], details).collect()}
    assert records["optc:lm:s:0"] == (["t1", "t2"], {"usernames": ["a", "b", "c"]}) and records["optc:lm:s:1"] == (["t3"], {})
    assert records["lab:lm:q:0"][1] == {"note": ["n"], "username": ["u"]}
    assert E.target_details(annotations.limit(0)).count() == 0
