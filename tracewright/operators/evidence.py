"""Annotations to targets, and targets to their supporting log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as E
from ..functions import timestamps as T
from ..lookups import TARGET_REASONS, ENTITY_KIND, PERSISTENCE_TECHNIQUES, PRECISION, TECHNIQUE_INDICATORS
from ..session import cut_lineage
from .scale import chunked_row_number, row_chunk

SCOPE = ["dataset", "task", "scenario"]


def task_precision(dataset: Column, task: Column) -> Column:
    out = None
    for (d, t), precision in PRECISION.items():
        here = (dataset == d) & (task == t)
        out = F.when(here, precision) if out is None else out.when(here, precision)
    return out


def entity_kind(task: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in ENTITY_KIND.items() for x in pair])[task]


def indicator_match(technique: Column, line: Column) -> Column:
    """Does the line show the technique? Literal patterns, so each is compiled once per task."""
    out = F.lit(False)
    for name, patterns in TECHNIQUE_INDICATORS.items():
        joined = "(?i)" + "|".join(f"(?:{p})" for p in patterns)
        out = F.when(technique == name, line.rlike(joined)).otherwise(out)
    return out


def annotation_units(annotations: DataFrame) -> DataFrame:
    """One row per record and unit it belongs to; ``unit_key`` names the unit inside its scenario.

    Records of the merged kind (``optc`` lateral movement) share the unit of their first entity;
    persistence records give one unit per technique; other records are their own unit.
    """
    merged = (F.col("dataset") == "optc") & (F.col("task") == "lm")
    own = F.concat_ws("#", F.lpad(F.col("record_index").cast("string"), 12, "0"), F.lit("0"))
    one = lambda key, pos, names: F.struct(key.alias("unit_key"), pos.alias("pos"), names.alias("names"))
    per_technique = F.transform(
        "entities",
        lambda e, i: one(
            F.concat_ws("#", F.lpad(F.col("record_index").cast("string"), 12, "0"), i.cast("string")),
            i.cast("long"), F.array(e),
        ),
    )
    zero = F.lit(0).cast("long")
    units = (
        F.when(merged, F.array(one(F.concat(F.lit("host:"), F.get("entities", F.lit(0))), zero, F.slice("entities", 1, 1))))
        .when(F.col("task") == "persistence", per_technique)
        .otherwise(F.array(one(own, zero, F.col("entities"))))
    )
    extra = [c for c in ("extra",) if c in annotations.columns]
    return annotations.withColumn("_u", F.explode(units)).select(
        *SCOPE, "record_index", "timestamps", "_u.unit_key", "_u.pos", "_u.names", *extra
    )


def _numbered_targets(rows: DataFrame) -> DataFrame:
    """The targets of annotation units, numbered inside their scenario, with their ``unit_key``."""
    key = [*SCOPE, "unit_key"]
    targets = rows.groupBy(*key).agg(
        F.min("record_index").alias("record_index"), F.min("pos").alias("pos"), F.min("names").alias("names"),
        F.count(F.lit(1)).alias("merged_records"),
    )
    targets = chunked_row_number(
        targets, SCOPE, ["record_index", "pos", "unit_key"], row_chunk(F.col("record_index")), "_n"
    )
    number = (F.col("_n") - 1).cast("string")
    return targets.select(
        F.concat_ws(":", *SCOPE, number).alias("target_id"), *key,
        entity_kind(F.col("task")).alias("entity_kind"), E.clean_aliases(F.col("names")).alias("aliases"),
        task_precision(F.col("dataset"), F.col("task")).alias("precision"), "record_index", "merged_records",
    )


def build_targets(annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets and their stamps: (target_id, ..., aliases) and, in long form, (target_id, stamp).

    Stamps are exploded and deduplicated instead of collected: a merged host may have any number.
    """
    rows = annotation_units(annotations)
    key = [*SCOPE, "unit_key"]
    targets = cut_lineage(_numbered_targets(rows))  # numbered once, for both
    stamps = rows.select(*key, F.explode("timestamps").alias("stamp")).distinct()
    stamps = stamps.join(targets.select(*key, "target_id", "precision"), key)
    at = T.parse_annotation_time(F.col("stamp"))
    stamps = stamps.select(
        "target_id", *SCOPE, "precision", at.alias("stamp_at"), T.to_precision(at, F.col("precision")).alias("stamp_norm")
    )
    return targets.drop("unit_key"), stamps


def target_details(annotations: DataFrame) -> DataFrame:
    """(target_id, key, value), in long form: what the records of a target say besides its entity, each value once.

    ``annotations``: as for ``build_targets``, with ``extra`` (a map of lists). The key ``timestamps`` holds the times as they were
    written. Of a target that merges the records of a host only the user names are kept, as ``usernames``; any other target
    keeps all keys of its record. Null values are left out.
    """
    rows = annotation_units(annotations)
    key = [*SCOPE, "unit_key"]
    ids = _numbered_targets(rows).select(*key, "target_id")
    merged = (F.col("dataset") == "optc") & (F.col("task") == "lm")
    names = F.create_map(F.lit("usernames"), F.try_element_at("extra", F.lit("username")))
    kept = F.map_concat(F.create_map(F.lit("timestamps"), F.col("timestamps")), F.when(merged, names).otherwise(F.coalesce("extra", F.create_map().cast("map<string,array<string>>"))))
    values = rows.select(*key, F.explode(kept).alias("key", "_values")).select(*key, "key", F.explode("_values").alias("value"))
    return values.filter("value is not null").distinct().join(ids, key).select("target_id", "key", "value")


def target_records(targets: DataFrame, details: DataFrame) -> DataFrame:
    """Targets with ``timestamps`` (sorted, as written) and ``extra`` (a map of sorted lists), for the sink."""
    lists = details.groupBy("target_id", "key").agg(F.array_sort(F.collect_list("value")).alias("_values"))
    maps = lists.groupBy("target_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "_values"))).alias("_all"))
    none = F.create_map().cast("map<string,array<string>>")
    rows = targets.join(maps, "target_id", "left").withColumn("_all", F.coalesce("_all", none))
    stamps = F.coalesce(F.try_element_at("_all", F.lit("timestamps")), F.array().cast("array<string>"))
    return rows.withColumn("timestamps", stamps).withColumn("extra", F.map_filter("_all", lambda k, _: k != "timestamps")).drop("_all")


def evidence_lines(targets: DataFrame, stamps: DataFrame, lines: DataFrame) -> DataFrame:
    """Supporting lines: (target_id, rel_path, line_no).

    ``lines``: dataset, task, scenario, rel_path, line_no, line, ts. One pass over the lines for all
    targets. The time condition is part of the join key (a minute interval touches two whole minutes
    at most), so pattern tests run only on lines of the right scenario and time.
    """
    minute = F.col("precision") == "minute"
    keys = F.when(
        minute,
        F.array_distinct(F.array(
            T.to_precision(F.col("stamp_at"), F.lit("minute")),
            T.to_precision(F.col("stamp_at") + F.expr("interval 59 seconds"), F.lit("minute")),
        )),
    ).otherwise(F.array(T.to_precision(F.col("stamp_at"), F.lit("second"))))
    probes = stamps.select("target_id", *SCOPE, "precision", "stamp_at", F.explode(keys).alias("_at")).join(
        targets.select("target_id", "entity_kind", F.explode("aliases").alias("alias")), "target_id"
    )
    probes = probes.withColumn(
        "_pattern", F.when(F.col("entity_kind") == "path", E.path_pattern(F.col("alias")))
    )
    precision = task_precision(F.col("dataset"), F.col("task"))
    timed = lines.filter("ts is not null").withColumn("_at", T.to_precision(F.col("ts"), precision))
    in_time = ~minute | ((F.col("ts") >= F.col("stamp_at")) & (F.col("ts") < F.col("stamp_at") + F.expr("interval 1 minute")))
    shows = (
        F.when(F.col("entity_kind") == "host", F.contains(F.lower("line"), F.lower("alias")))
        .when(F.col("entity_kind") == "path", F.rlike(F.col("line"), F.col("_pattern")))
        .otherwise(indicator_match(F.col("alias"), F.col("line")))
    )
    hits = timed.join(probes, [*SCOPE, "_at"]).filter(in_time & shows)
    return hits.select("target_id", "rel_path", "line_no").distinct()


def target_status(targets: DataFrame, files: DataFrame, evidence: DataFrame) -> DataFrame:
    """Add status, reason, scenario_key and evidence count."""
    places = files.groupBy(*SCOPE).agg(F.min(F.struct("ordinal", "scenario_key")).alias("_f"))
    counts = evidence.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_evidence"))
    rows = targets.join(places, SCOPE, "left").join(counts, "target_id", "left")
    first = F.get("aliases", F.lit(0))
    rows = rows.withColumn("_why", F.when(F.col("entity_kind") == "host", E.suspicious_host(first)))
    supported = F.coalesce(F.col("n_evidence"), F.lit(0)) > 0
    unknown = (F.col("entity_kind") == "technique") & first.isNotNull() & ~first.isin(*PERSISTENCE_TECHNIQUES)
    named = TARGET_REASONS["unknown_technique"]
    cases = [
        (unknown, "ambiguous", F.concat(F.lit(named[0]), first, F.lit(named[1]))),
        (F.size("aliases") == 0, "ambiguous", F.lit(TARGET_REASONS["no_entity"])),
        (F.col("_why").isNotNull(), "ambiguous", F.col("_why")),
        (F.col("_f").isNull(), "unsupported", F.lit(TARGET_REASONS["no_file"])),
        (supported, "supported_positive", F.lit(TARGET_REASONS["found"])),
    ]
    status = reason = None
    for condition, value, why in cases:
        status = F.when(condition, value) if status is None else status.when(condition, value)
        reason = F.when(condition, why) if reason is None else reason.when(condition, why)
    return rows.withColumn("status", status.otherwise("unsupported")).withColumn(
        "reason", reason.otherwise(TARGET_REASONS["not_found"])
    ).withColumn(
        "scenario_key", F.coalesce("_f.scenario_key", F.concat_ws("/", "dataset", "scenario"))
    ).withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0))).drop("_f", "_why")


def unplaced_targets(targets: DataFrame, files: DataFrame) -> DataFrame:
    """Targets whose scenario key has no file."""
    return targets.join(files.select("scenario_key").distinct(), "scenario_key", "left_anti")


def quarantined_targets(targets: DataFrame) -> DataFrame:
    """Targets without support, with the reason: (target_id, status, reason, aliases)."""
    return targets.filter("status <> 'supported_positive'").select("target_id", "status", "reason", "aliases")


def target_summary(targets: DataFrame) -> DataFrame:
    """Targets by status, in all and per (dataset, task)."""
    return targets.rollup("status", "dataset", "task").agg(
        F.count(F.lit(1)).alias("n_targets"), F.grouping_id().alias("level")
    ).filter("level in (0, 3)").select("dataset", "task", "status", "n_targets")


def unit_targets(units: DataFrame, window_targets: DataFrame, targets: DataFrame, stamps: DataFrame) -> DataFrame:
    """Ground truth of each investigation unit, one row per target and stamp, with the target's aliases.

    ``target_order`` puts supported targets before ambiguous ones, each sorted by id.
    """
    spans = units.filter("task <> 'classification'").select("unit_id", "rel_path", "window_index")
    rows = window_targets.join(spans, ["rel_path", "window_index"]).join(targets.select("target_id", "aliases"), "target_id")
    stamped = stamps.select("target_id", F.col("stamp_norm").alias("stamp")).distinct()
    order = F.concat(F.when(F.col("status") == "supported_positive", "0").otherwise("1"), F.col("target_id"))
    return rows.join(stamped, "target_id").select(
        "unit_id", "target_id", order.alias("target_order"), "status", "stamp", "aliases"
    )
