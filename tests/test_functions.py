import ipaddress

import pytest
from pyspark.sql import functions as F

from tracewright.functions import names as N
from tracewright.functions import normalize as E
from tracewright.functions import timestamps as T
from tracewright.operators.screening import matched_terms

TIMES = {
    "1749133180.689": ("epoch", "2025-06-05 09:19:40"),
    "1730615400": ("epoch", "2024-11-03 01:30:00"),
    "1731744780.5": ("epoch", "2024-11-16 02:13:00"),
    "1/13/2025 2:02:03 AM": ("windows", "2025-01-13 02:02:03"),
    "1/13/2025 12:02:03 AM": ("windows", "2025-01-13 00:02:03"),
    "1/13/2025 12:22:36 PM": ("windows", "2025-01-13 12:22:36"),
    "11/3/2025 11:59:59 PM": ("windows", "2025-11-03 23:59:59"),
    "3/9/2025 2:30:00 AM": ("windows", "2025-03-09 02:30:00"),
    "13/9/2025 2:30:00 AM": ("windows", None),
    "1/9/2025 13:30:00 PM": ("windows", None),
    "1/9/2025 0:30:00 AM": ("windows", None),
    "2019-09-23 13:23:21": ("iso", "2019-09-23 13:23:21"),
    "2025-03-09 02:30:00": ("iso", "2025-03-09 02:30:00"),
    "2024-13-01 00:00:00": ("iso", None),
    " 2024-11-16 02:13\t": ("iso_minute", "2024-11-16 02:13:00"),
    "2019-09-17T11:23:48.01-04:00": ("iso_offset", "2019-09-17 11:23:48"),
    "2019-09-17T11:23:48+05:30": ("iso_offset", "2019-09-17 11:23:48"),
    "2019-09-17T11:23:48": (None, None),
    "12345678": (None, None),
    "yesterday": (None, None),
    "": (None, None),
}


def test_times_do_not_depend_on_the_session_zone(zoned):
    df = zoned.createDataFrame([(k,) for k in TIMES], "raw string")
    rows = df.select("raw", T.classify_format(F.col("raw")).alias("f"), T.norm_timestamp(F.col("raw"), F.lit("second")).alias("s"))
    assert {r.raw: (r.f, r.s) for r in rows.collect()} == TIMES


def test_extract_raw_time(spark):
    cases = [
        ("(2024-01-01 00:00:00) [a] (x)", "edge", "2024-01-01 00:00:00"), ("x (2024) y", "edge", None), ("() x", "edge", None),
        ("type=X msg=audit(1749133180.689:12): y", "raw", "1749133180.689"), ("msg=audit(17491:12)", "raw", None),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "line string, rep string")
    got = [r[0] for r in df.select(T.extract_raw_time(F.col("line"), F.col("rep"))).collect()]
    assert got == [c[2] for c in cases]


def test_annotation_time_and_precision(spark):
    df = spark.createDataFrame([("2024-11-16 02:13",), ("2024-11-16 02:13:07",), ("no",)], "raw string")
    rows = df.select(
        T.to_precision(T.parse_annotation_time(F.col("raw")), F.lit("second")), T.annotation_precision(F.col("raw"))
    ).collect()
    assert [tuple(r) for r in rows] == [("2024-11-16 02:13:00", "minute"), ("2024-11-16 02:13:07", "second"), (None, None)]


def test_file_names(spark):
    rows = [
        ("edge_2024-11-27T14-04-to-2024-11-27T14-10_lm-scenario2.log",),
        ("raw_2019-09-23T13-23-21-to-2019-09-23T13-23-41_h201_lm-scenario1.log",), ("bad.log",),
    ]
    df = spark.createDataFrame(rows, "name string").withColumn("n", N.parse_file_name(F.col("name"), strict=False))
    got = [
        None if r.n is None else (r.n.representation, r.s, r.e, r.n.host, r.n.scenario)
        for r in df.select("n", N.file_name_time(F.col("n.start_token")).alias("s"), N.file_name_time(F.col("n.end_token")).alias("e")).collect()
    ]
    assert got == [
        ("edge", "2024-11-27 14:04:00", "2024-11-27 14:10:00", None, "lm-scenario2"),
        ("raw", "2019-09-23 13:23:21", "2019-09-23 13:23:41", "h201", "lm-scenario1"), None,
    ]
    with pytest.raises(Exception, match="unrecognised file name"):
        df.select(N.parse_file_name(F.col("name"))).collect()


def test_keys(spark):
    df = spark.createDataFrame([("optc", "h1", "lm-scenario1"), ("lab", None, "attack-linux-lmscenario12")], "d string, h string, s string")
    rows = df.select(N.scenario_key(F.col("d"), F.col("h"), F.col("s")), N.viewed_scenario_key(F.col("d"), F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [("optc/h1_lm-scenario1", None), ("lab/attack-linux-lmscenario12", "lab/lm-scenario12")]


def test_normalisation(spark):
    df = spark.createDataFrame([("  [Fe80::1]. ", "Create-Account \t x", "' C:\\\\\\A\\b'")], "h string, t string, p string")
    row = df.select(
        E.norm_host(F.col("h")), E.norm_technique(F.col("t")), E.norm_path(F.col("p"), F.lit(True)), E.norm_path(F.col("p"), F.lit(False)),
        E.unescape(F.lit("a\\\\b")),
    ).first()
    assert tuple(row) == ("fe80::1]", "create account x", " c:\\a\\b", " C:\\A\\b", "a\\b")


def test_suspicious_hosts(spark):
    hosts = [
        "224.0.0.5", "239.255.255.250", "223.1.1.1", "240.0.0.1", "169.254.1.2", "10.0.0.255", "224.0.0.255", "10.0.255.1", "ff02::fb", "FF02::1",
        "ff::1", "fe80::1", "febf::1", "fec0::1", "2001:db8::1", "example.com", "300.1.1.255", "fe80", "ffffff",
    ]

    def expected(alias):
        try:
            ip = ipaddress.ip_address(alias)
        except ValueError:
            return None
        if ip.is_multicast:
            return "multicast"
        if ip.is_link_local:
            return "link-local"
        return "broadcast" if ip.version == 4 and alias.endswith(".255") else None

    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = {r[0]: r[1] and r[1].split()[0] for r in df.select("h", E.suspicious_host(F.col("h"))).collect()}
    assert got == {h: expected(h) for h in hosts}


def test_path_pattern_allows_one_to_four_backslashes(spark):
    lines = ["open c:\\tmp\\A.txt", "open C:\\\\tmp\\\\a.txt", "C:\\\\\\\\tmp\\a.TXT", "C:\\\\\\\\\\tmp\\a.txt", "C:/tmp/a.txt", "C:\\tmp\\aXtxt"]
    df = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("alias", F.lit("C:\\tmp\\a.txt"))
    got = [r[0] for r in df.select(F.rlike(F.col("line"), E.path_pattern(F.col("alias")))).collect()]
    assert got == [True, True, True, False, False, False]


def test_alias_choice(spark):
    df = spark.createDataFrame(
        [("host", ["a.example", "10.0.0.1"], "to 10.0.0.1"), ("host", ["a", "b"], "zzz"), ("technique", ["T", "zz"], "zz"), ("path", ["C:\\\\x"], "c:\\x")],
        "kind string, aliases array<string>, line string",
    )
    got = [r[0] for r in df.select(E.alias_on_line(F.col("kind"), F.col("aliases"), F.col("line"))).collect()]
    assert got == ["10.0.0.1", "a", "T", "C:\\\\x"]


def test_clean_aliases(spark):
    df = spark.createDataFrame([([" a ", "", "No Value", "b\n"],)], "x array<string>")
    assert df.select(E.clean_aliases(F.col("x"))).first()[0] == ["a", "b"]


def test_screening_equals_the_single_patterns(spark):
    from tracewright.lookups import EXCLUDE_TERMS, FORBIDDEN_PATTERNS, REVIEW_TERMS

    patterns = [*EXCLUDE_TERMS, *REVIEW_TERMS, *FORBIDDEN_PATTERNS, r"id\s+number", r"\d*x", r"[ab]*c\.+", "a|b"]
    texts = ["the id  number", "idnumber", "12x", "x", "abc..", "c", "brute force", "nmap scan", "flag of a ctf", "plain words", ""]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    single = F.array_sort(F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(p)) for p in patterns])))
    rows = df.select("text", matched_terms(F.col("text"), patterns).alias("a"), single.alias("b")).collect()
    assert all(r.a == (None if r.text is None else r.b) for r in rows)
    assert r"id\s+number" in rows[0].a and r"id\s+number" not in rows[1].a
