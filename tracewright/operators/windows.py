"""Line windows, their labels and slices."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..functions import names as N
from ..lookups import FINDING_FIELD, OPTIONAL_KEYS, QUARANTINE_REASON, REQUIRED_KEYS, WINDOW_LINES


def window_size(representation: Column, sizes: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[representation]


def window_index(line_no: Column, size: Column) -> Column:
    """Window of a line. Turns the range condition start <= line <= end into an equality."""
    return F.floor((line_no - 1) / size).cast("long")


def tumbling_windows(files: DataFrame, schema_version: str, sizes: dict[str, int] = WINDOW_LINES) -> DataFrame:
    """Units of consecutive lines; a classification file is one unit."""
    whole = F.col("task") == "classification"
    rows = files.withColumn("_size", window_size(F.col("representation"), sizes))
    n_windows = F.when(whole, 1).otherwise(F.ceil(F.col("lines") / F.col("_size"))).cast("long")
    rows = rows.withColumn("n_windows", n_windows).filter("n_windows > 0")
    rows = rows.withColumn("window_index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_windows") - 1)))
    start = F.when(whole, 1).otherwise(F.col("window_index") * F.col("_size") + 1).cast("long")
    end = F.when(whole, F.col("lines")).otherwise(
        F.least((F.col("window_index") + 1) * F.col("_size"), F.col("lines"))
    ).cast("long")
    rows = rows.withColumn("start_line", start).withColumn("end_line", end)
    rows = rows.withColumn("n_lines", F.col("end_line") - F.col("start_line") + 1)
    uid = N.unit_id(
        schema_version, F.col("sha256"), F.col("task"), F.col("representation"), F.col("start_line"), F.col("end_line")
    )
    return rows.withColumn("unit_id", uid).drop("_size")


def window_targets(evidence: DataFrame, files: DataFrame, sizes: dict[str, int] = WINDOW_LINES) -> DataFrame:
    """Distinct (rel_path, window_index, target_id, status) with evidence inside, and its line count.

    ``evidence``: rel_path, line_no, target_id, status. Long form: a window may serve many targets.
    """
    view = files.filter("task <> 'classification'").select("rel_path", "representation")
    rows = evidence.join(view, "rel_path")
    rows = rows.withColumn("window_index", window_index(F.col("line_no"), window_size(F.col("representation"), sizes)))
    return rows.groupBy("rel_path", "window_index", "target_id", "status").agg(
        F.count(F.lit(1)).alias("n_evidence"), F.min("line_no").alias("first_line")
    )


def label_windows(windows: DataFrame, targets_in_window: DataFrame) -> DataFrame:
    """Unit labels: benign, then positive, then quarantined, then negative_attack_file."""
    counts = targets_in_window.groupBy("rel_path", "window_index").agg(
        F.count_if(F.col("status") == "supported_positive").alias("n_supported"),
        F.count_if(F.col("status") != "supported_positive").alias("n_ambiguous"),
    )
    rows = windows.join(counts, ["rel_path", "window_index"], "left").fillna(0, ["n_supported", "n_ambiguous"])
    label = (
        F.when(F.col("task") == "classification", F.when(F.col("label") == "attack", "attack").otherwise("benign"))
        .when(F.col("label") == "benign", "benign")
        .when(F.col("n_supported") > 0, "positive")
        .when(F.col("n_ambiguous") > 0, "quarantined")
        .otherwise("negative_attack_file")
    )
    rows = rows.withColumn("_label", label).withColumnRenamed("label", "file_label").withColumnRenamed("_label", "label")
    reason = F.when(F.col("label") == "quarantined", QUARANTINE_REASON).otherwise("")
    return rows.withColumn("quarantine_reason", reason)


def window_slices(lines: DataFrame, files: DataFrame, sizes: dict[str, int] = WINDOW_LINES) -> DataFrame:
    """Text of every investigation window, each line newline-terminated: (rel_path, window_index, slice).

    A group holds at most one window of lines, however long the file is.
    """
    view = files.filter("task <> 'classification'").select("rel_path", "representation")
    rows = lines.select("rel_path", "line_no", "line").join(view, "rel_path")
    rows = rows.withColumn("window_index", window_index(F.col("line_no"), window_size(F.col("representation"), sizes)))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    text = F.array_join(F.transform(ordered, lambda x: F.concat(x["line"], F.lit("\n"))), "")
    return rows.groupBy("rel_path", "window_index").agg(text.alias("slice"))


def whole_slices(files: DataFrame) -> DataFrame:
    """Slices of classification units, which are whole files held as one text: the text, newline-terminated."""
    whole = F.when(F.endswith("text", F.lit("\n")), F.col("text")).otherwise(F.concat("text", F.lit("\n")))
    return files.filter("task = 'classification' and text <> ''").select("rel_path", F.lit(0).cast("long").alias("window_index"), whole.alias("slice"))


def text_slices(files: DataFrame, sizes: dict[str, int] = WINDOW_LINES) -> DataFrame:
    """``window_slices`` for files held as one text: cut inside the row, without an exchange."""
    rows = files.filter("task <> 'classification' and text <> ''").select(
        "rel_path", window_size(F.col("representation"), sizes).alias("_size"),
        F.split(F.regexp_replace("text", "\n\\z", ""), "\n").alias("_lines"),
    )
    last = F.floor((F.size("_lines") - 1) / F.col("_size")).cast("long")
    rows = rows.withColumn("window_index", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = (F.col("window_index") * F.col("_size") + 1).cast("int")
    part = F.slice("_lines", start, F.col("_size"))
    cut = rows.select("rel_path", "window_index", F.concat(F.array_join(part, "\n"), F.lit("\n")).alias("slice"))
    return cut.unionByName(whole_slices(files))


def shifted_windows(units: DataFrame, evidence: DataFrame, files: DataFrame, schema_version: str,
                    shifts: Sequence[int] = (-300, -200, -100, 100, 200, 300)) -> DataFrame:
    """Shifted copies of positive windows, clipped and deduplicated, with recomputed labels.

    A shifted window spans at most two line buckets of its own size, so support is found by an
    equi-join on the bucket. ``weight`` shares the probability of the parent among its children.
    """
    parents = units.filter("label = 'positive'").join(
        files.select("rel_path", F.col("lines").alias("_lines")), "rel_path"
    )
    moved = parents.withColumn("shift", F.explode(F.array(*[F.lit(s) for s in shifts])))
    moved = moved.select(
        "rel_path", "sha256", "task", "representation", "window_index", F.col("unit_id").alias("parent_id"),
        F.greatest(F.lit(1), F.col("start_line") + F.col("shift")).cast("long").alias("start_line"),
        F.least(F.col("_lines"), F.col("end_line") + F.col("shift")).cast("long").alias("end_line"),
        F.col("start_line").alias("_home"),
    ).filter("start_line <= end_line")
    moved = moved.groupBy("rel_path", "sha256", "task", "representation", "start_line", "end_line").agg(
        F.min(F.struct("window_index", "parent_id")).alias("_p")
    ).select("*", "_p.parent_id").drop("_p")
    width = 1000
    spans = moved.withColumn(
        "_bucket",
        F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width))),
    )
    support = evidence.select(
        "rel_path", "line_no", "target_id", "status", F.floor(F.col("line_no") / width).alias("_bucket")
    )
    inside = spans.join(support, ["rel_path", "_bucket"]).filter("line_no between start_line and end_line")
    found = inside.groupBy("rel_path", "start_line", "end_line").agg(
        F.bool_or(F.col("status") == "supported_positive").alias("_pos")
    )
    out = moved.join(found, ["rel_path", "start_line", "end_line"], "left")
    label = F.when(F.col("_pos"), "positive").when(~F.col("_pos"), "quarantined").otherwise("negative_attack_file")
    children = out.groupBy("parent_id").agg(F.count(F.lit(1)).alias("_n"))
    uid = N.unit_id(
        schema_version, F.col("sha256"), F.col("task"), F.col("representation"), F.col("start_line"), F.col("end_line")
    )
    return out.join(children, "parent_id").select(
        uid.alias("unit_id"), "parent_id", "rel_path", "task", "representation", "start_line", "end_line",
        label.alias("label"), (F.lit(1.0) / F.col("_n")).alias("weight"),
    )


def unit_summary(units: DataFrame) -> DataFrame:
    """Units and independent groups per (split, task, label)."""
    by_group = units.groupBy("split", "task", "label", "group_id").agg(F.count(F.lit(1)).alias("_n"))
    return by_group.groupBy("split", "task", "label").agg(
        F.sum("_n").alias("n_units"), F.count(F.lit(1)).alias("n_groups")
    )


def duplicate_units(units: DataFrame) -> DataFrame:
    """Unit ids that occur more than once."""
    return units.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_units")).filter("n_units > 1")


def guard_sealed(df: DataFrame, allow_test: bool = False) -> DataFrame:
    """Rows of the sealed split pass only on request."""
    return df if allow_test else df.filter("split <> 'test'")


# A mark of a template: a name in braces.
MARK = r"\{([A-Za-z_][A-Za-z0-9_]*)\}"


def parse_templates(templates: DataFrame) -> DataFrame:
    """Add ``literals`` and ``names``: the texts around the marks of each ``template``, and the names in the marks, in order."""
    names = F.regexp_extract_all("template", F.lit(MARK), F.lit(1))
    return templates.withColumn("names", names).withColumn("literals", F.split("template", MARK, -1))


def requested_fields(task: Column) -> dict[str, Column]:
    """What a task asks for, as texts: its required fields, its optional ones, and the field that names the entity."""
    named = lambda table: F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), task)
    listed = lambda table: named({k: ", ".join(v) for k, v in table.items()})
    return {"required_fields": listed(REQUIRED_KEYS), "optional_fields": listed(OPTIONAL_KEYS), "entity_field": named(FINDING_FIELD)}


def render_text(units: DataFrame, templates: DataFrame, **more: Column) -> DataFrame:
    """(unit_id, text, unknown_names): the template of each unit with its marks filled in.

    ``templates``: task, representation, dataset, os, template; a null key stands for any value, and of several templates the one
    with the most keys that are not null counts, then one chosen by hash. A mark may name any column of ``units``, a field of
    ``requested_fields``, or one of ``more``; null values are empty. A name that is none of these stays as it stands, and is listed.
    What a value holds is not filled in again. Templates are parsed once, before they meet the units.
    """
    keys = ["task", "representation", "dataset", "os"]
    values = {c: F.col(c).cast("string") for c in units.columns if not isinstance(units.schema[c].dataType, (ArrayType, MapType, StructType))}
    values |= requested_fields(F.col("task")) | more
    known = F.map_from_arrays(F.array(*[F.lit(n) for n in values]), F.array(*[F.coalesce(v.cast("string"), F.lit("")) for v in values.values()]))
    parsed = parse_templates(templates.select(*[F.col(k).alias(f"_{k}") for k in keys], "template"))
    fits = [F.col(f"_{k}").isNull() | (F.col(f"_{k}") == F.col(k)) for k in keys]
    met = units.select(*keys).distinct().join(parsed, reduce(Column.__and__, fits))  # closed enumerations meet templates written by hand
    n_keys = sum((F.col(f"_{k}").isNotNull().cast("int") for k in keys), F.lit(0))
    best = F.max_by(F.struct("literals", "names"), F.struct(n_keys.alias("n"), F.xxhash64("template").alias("h")))
    chosen = met.groupBy(*keys).agg(best.alias("_t")).select(*[F.col(k).alias(f"_{k}") for k in keys], "_t.*")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    rows = units.withColumn("_values", known).join(chosen, same)
    as_written = lambda name: F.concat(F.lit("{"), name, F.lit("}"))
    value = lambda name: F.when(name.isNull(), "").otherwise(F.coalesce(F.try_element_at("_values", name), as_written(name)))
    filled = F.zip_with("literals", "names", lambda text, name: F.concat(text, value(name)))
    unknown = F.array_distinct(F.array_except("names", F.map_keys("_values")))
    return rows.select("unit_id", F.array_join(filled, "").alias("text"), unknown.alias("unknown_names"))
