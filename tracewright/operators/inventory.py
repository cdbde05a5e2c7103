"""File profiles and corpus summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import timestamps as T
from ..lookups import WINDOW_LINES
from .scale import compute_once, row_chunk


def timed_lines(lines: DataFrame) -> DataFrame:
    """Add ``raw_time``, ``ts_format`` (null when unparseable) and ``ts`` to numbered lines.

    ``lines``: rel_path, representation, line_no, line.
    """
    rows = compute_once(lines, "raw_time", T.extract_raw_time(F.col("line"), F.col("representation")))
    rows = compute_once(rows, "ts", T.parse_record_time(F.col("raw_time")))
    return rows.withColumn("ts_format", F.when(F.col("ts").isNotNull(), T.classify_format(F.col("raw_time"))))


def time_profile(timed: DataFrame) -> DataFrame:
    """Per file: lines, formats, first and last time in file order, failures, order violations.

    Two levels, so that a file with a third of all lines is still spread over many tasks: chunks of
    consecutive lines are profiled first (the ``lag`` window is per chunk), then the few chunk rows
    of a file are combined; a violation across a chunk border compares the first time of a chunk
    with the last time before it.
    """
    chunk = ["rel_path", "_chunk"]
    in_file = Window.partitionBy(*chunk).orderBy("line_no")
    # last() with nulls ignored is the previous parseable record
    rows = timed.select("rel_path", "line_no", "ts", "ts_format", row_chunk(F.col("line_no")).alias("_chunk"))
    rows = rows.withColumn(
        "_prev", F.last("ts", ignorenulls=True).over(in_file.rowsBetween(Window.unboundedPreceding, -1))
    )
    parsed_no = F.when(F.col("ts").isNotNull(), F.col("line_no"))
    chunks = rows.groupBy(*chunk).agg(
        F.count(F.lit(1)).alias("_lines"),
        F.collect_set("ts_format").alias("_formats"),
        F.min_by("ts", parsed_no).alias("_first"),
        F.max_by("ts", parsed_no).alias("_last"),
        F.count_if(F.col("ts").isNull()).alias("_failures"),
        F.count_if(F.col("ts") < F.col("_prev")).alias("_inside"),
    )
    before = Window.partitionBy("rel_path").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_carry", F.last("_last", ignorenulls=True).over(before))
    has_time = F.when(F.col("_first").isNotNull(), F.col("_chunk"))
    return chunks.groupBy("rel_path").agg(
        F.sum("_lines").alias("lines"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_formats")))).alias("ts_formats"),
        F.min_by("_first", has_time).alias("first_time"),
        F.max_by("_last", has_time).alias("last_time"),
        F.sum("_failures").alias("parse_failures"),
        (F.sum("_inside") + F.count_if(F.col("_first") < F.col("_carry"))).alias("nonmonotonic"),
    )


def file_records(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Full inventory record per scanned file.

    ``files``: rel_path, dataset, task, filename, sha256, bytes. ``lines``: rel_path, line_no, line.
    """
    named = files.withColumn("_n", N.parse_file_name(F.col("filename")))
    named = named.select(
        *files.columns, F.col("_n.representation").alias("representation"), F.col("_n.scenario").alias("scenario"),
        F.col("_n.host").alias("host"),
        N.file_name_time(F.col("_n.start_token")).alias("window_start"),
        N.file_name_time(F.col("_n.end_token")).alias("window_end"),
    )
    view = F.substring_index(F.substring_index(F.col("rel_path"), "/", -1), "_", 1)
    profile = time_profile(timed_lines(lines.withColumn("representation", view)))
    out = named.join(profile, "rel_path", "left")
    return out.select(
        *named.columns,
        N.scenario_key(F.col("dataset"), F.col("host"), F.col("scenario")).alias("scenario_key"),
        N.scenario_label(F.col("scenario")).alias("label"),
        N.operating_system(F.col("dataset"), F.col("ts_formats")).alias("os"),
        F.coalesce("lines", F.lit(0)).alias("lines"),
        F.coalesce("ts_formats", F.array().cast("array<string>")).alias("ts_formats"),
        "first_time", "last_time",
        F.coalesce("parse_failures", F.lit(0)).alias("parse_failures"),
        F.coalesce("nonmonotonic", F.lit(0)).alias("nonmonotonic"),
    )


def corpus_summary(files: DataFrame) -> DataFrame:
    """One row: files, distinct contents, groups of identical contents, scenario keys.

    Distinct counts are counts of grouped rows, so each runs as a partial and a final aggregate.
    """
    totals = files.agg(F.count(F.lit(1)).alias("files"))
    contents = files.groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("distinct_contents"), F.count_if(F.col("n") > 1).alias("byte_identical_groups")
    )
    keys = files.select("scenario_key").distinct().agg(F.count(F.lit(1)).alias("scenario_keys"))
    # three one-row tables
    return totals.join(contents, F.lit(True)).join(keys, F.lit(True))


def source_summary(files: DataFrame, window_lines: dict[str, int] = WINDOW_LINES) -> DataFrame:
    """Per data set and view: classification files, investigation files, nominal windows."""
    size = F.create_map(*[F.lit(x) for pair in window_lines.items() for x in pair])[F.col("representation")]
    investigation = F.col("task") != "classification"
    return files.groupBy("dataset", "representation").agg(
        F.count_if(~investigation).alias("classification_files"),
        F.count_if(investigation).alias("investigation_files"),
        F.sum(F.when(investigation, F.ceil(F.col("lines") / size)).otherwise(0)).cast("long").alias("nominal_chunks"),
    )


def duplicate_contents(files: DataFrame) -> DataFrame:
    """Contents held by more than one file."""
    return files.groupBy("sha256").agg(F.count(F.lit(1)).alias("n_files")).filter("n_files > 1")
