"""Columns read from file names and derived keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the file name layout.
FILE_NAME = (
    r"^(edge|raw)_(\d{4}-\d{2}-\d{2}T\d{2}-\d{2}(?:-\d{2})?)-to-"
    r"(\d{4}-\d{2}-\d{2}T\d{2}-\d{2}(?:-\d{2})?)_(?:(h\d{3})_)?([A-Za-z0-9-]+)\.log$"
)
# Fixed value: the layout of a classification scenario that views another scenario.
VIEW_NAME = r"attack-(?:linux|windows)-([a-z]+)scenario(\d+)$"


def parse_file_name(name: Column, strict: bool = True) -> Column:
    """Struct of the name parts. A name that does not fit raises, or is null with ``strict=False``."""
    part = lambda i: F.regexp_extract(name, FILE_NAME, i)
    parts = F.struct(
        part(1).alias("representation"),
        part(2).alias("start_token"),
        part(3).alias("end_token"),
        F.nullif(part(4), F.lit("")).alias("host"),
        part(5).alias("scenario"),
    )
    fits = F.when(name.rlike(FILE_NAME), parts)
    if not strict:
        return fits
    return fits.otherwise(F.raise_error(F.concat(F.lit("unrecognised file name: "), name)))


def file_name_time(token: Column) -> Column:
    """``2024-11-27T14-04[-05]`` to ``2024-11-27 14:04:05`` (seconds default to zero)."""
    clock = F.regexp_replace(F.substring_index(token, "T", -1), "-", ":")
    clock = F.when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock)
    return F.concat_ws(" ", F.substring_index(token, "T", 1), clock)


def scenario_key(dataset: Column, host: Column, scenario: Column) -> Column:
    """``dataset/[host_]scenario``."""
    return F.concat(dataset, F.lit("/"), F.concat_ws("_", F.nullif(host, F.lit("")), scenario))


def scenario_label(scenario: Column) -> Column:
    return F.when(scenario.contains("benign"), "benign").otherwise("attack")


def operating_system(dataset: Column, ts_formats: Column) -> Column:
    windows = (dataset == "optc") | F.coalesce(F.array_contains(ts_formats, "windows"), F.lit(False))
    return F.when(windows, "windows").otherwise("linux")


def viewed_scenario_key(dataset: Column, scenario: Column) -> Column:
    """Key of the scenario that a classification view is named after, null when there is none."""
    return F.when(
        scenario.rlike(VIEW_NAME),
        F.concat(
            dataset, F.lit("/"), F.regexp_extract(scenario, VIEW_NAME, 1),
            F.lit("-scenario"), F.regexp_extract(scenario, VIEW_NAME, 2),
        ),
    )


def unit_id(schema_version: str, sha256: Column, task: Column, representation: Column,
            start: Column, end: Column) -> Column:
    """Opaque id: 16 hex digits of the hash of content, task, view and line range."""
    span = F.concat_ws("-", start.cast("string"), end.cast("string"))
    return F.substring(F.sha2(F.concat_ws("|", F.lit(schema_version), sha256, task, representation, span), 256), 1, 16)


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
