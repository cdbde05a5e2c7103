"""Strict validation of submitted findings, row-local: no shuffle, no Python.

A payload is parsed once to VARIANT; the rules are higher-order functions over its items. They are
listed in the order in which they are checked, item by item, so the first entry of ``violations``
is the first error of a sequential check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timestamps import classify_format, ws_trim
from ..lookups import PAYLOAD_ERRORS as ERRORS
from ..lookups import (
    FINDING_FIELD, HIGH, MAX_FINDINGS, MAX_PAYLOAD_BYTES, MAX_SOURCE_LINES, MAX_STRING, OPTIONAL_KEYS, REQUIRED_KEYS,
    VERDICTS,
)
from .scale import compute_once

# Entity syntax.
HOST = r"^[A-Za-z0-9][A-Za-z0-9.:\-\[\]]*$"
SEPARATORS = r"[,;|\n\r\t]| or | and "
TECHNIQUE_SEPARATORS = r"[,;|\n\r\t]"


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value) == kind, F.lit(False))


def _text(value: Column) -> Column:
    return F.when(_is(value, "STRING"), F.try_variant_get(value, "$", "string"))


def _string_rules(value: Column, name: str, optional: bool) -> list[tuple[str, Column]]:
    wrong = ~_is(value, "STRING")
    if optional:
        wrong = wrong & value.isNotNull() & ~_is(value, "VOID")
    return [
        (ERRORS["string"].format(name), wrong),
        (ERRORS["long_string"].format(name, MAX_STRING), F.length(_text(value)) > MAX_STRING),
    ]


def _source_line_rules(value: Column, n_lines: Column, allow_empty: bool) -> list[tuple[str, Column]]:
    items = F.try_variant_get(value, "$", "array<variant>")
    whole = F.transform(items, lambda x: F.when(_is(x, "BIGINT"), F.try_variant_get(x, "$", "bigint")))
    rules = [(ERRORS["lines_list"], items.isNull())]
    if not allow_empty:
        rules.append((ERRORS["no_lines"], F.size(items) == 0))
    return rules + [
        (ERRORS["many_lines"].format(MAX_SOURCE_LINES), F.size(items) > MAX_SOURCE_LINES),
        (ERRORS["line_integers"], F.exists(whole, lambda x: x.isNull())),
        (ERRORS["line_outside"], F.exists(whole, lambda x: (x < 1) | (x > n_lines))),
        (ERRORS["line_twice"], F.size(F.array_distinct(whole)) < F.size(whole)),
    ]


def _item_rules(task: str, item: Column, n_lines: Column) -> list[tuple[str, Column]]:
    """(message, is violated) in checking order; ``item`` is a map, null when it is no object."""
    required, optional = REQUIRED_KEYS[task], OPTIONAL_KEYS[task]
    keys = F.map_keys(item)
    known = F.array(*[F.lit(k) for k in required + optional])
    rules = [
        (ERRORS["object"], item.isNull()),
        (ERRORS["keys_missing"], F.size(F.array_except(F.array(*[F.lit(k) for k in required]), keys)) > 0),
        (ERRORS["keys_unknown"], F.size(F.array_except(keys, known)) > 0),
        (ERRORS["verdict"], ~F.coalesce(_text(item["verdict"]).isin(*VERDICTS), F.lit(False))),
    ]
    rules += _source_line_rules(item["source_lines"], n_lines, task == "classification")
    for key in optional:
        if key == "pid":
            value = item["pid"]
            whole = _is(value, "BIGINT") & (F.try_variant_get(value, "$", "bigint") >= 0)
            rules.append((
                ERRORS["pid"],
                value.isNotNull() & ~_is(value, "VOID") & ~F.coalesce(whole, F.lit(False)),
            ))
        else:
            rules += _string_rules(item[key], key, optional=True)
    if task != "classification":
        field = FINDING_FIELD[task]
        entity = ws_trim(_text(item[field]))
        separators = TECHNIQUE_SEPARATORS if task == "persistence" else SEPARATORS
        rules += _string_rules(item["timestamp"], "timestamp", optional=False)
        rules.append((ERRORS["timestamp"], classify_format(_text(item["timestamp"])).isNull()))
        rules += _string_rules(item[field], field, optional=False)
        rules += [
            (ERRORS["entity_empty"].format(field), entity == ""),
            (ERRORS["entity_many"].format(field), entity.rlike(separators)),
        ]
        if task == "lm":
            rules.append((ERRORS["host"], ~entity.rlike(HOST)))
    return rules


def _by_task(build) -> Column:
    out = None
    for task in REQUIRED_KEYS:
        here = F.col("task") == task
        out = F.when(here, build(task)) if out is None else out.when(here, build(task))
    return out


def _messages(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(violated, message) for message, violated in rules]))


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """Add ``items`` (array of maps) when the payload is strictly one JSON array; null otherwise.

    The payload is parsed inside a two-element array, so text after the value cannot pass.
    """
    sized = F.octet_length("payload").between(1, MAX_PAYLOAD_BYTES) & F.is_valid_utf8("payload")
    wrapped = F.when(sized, F.try_parse_json(F.concat(F.lit("["), F.col("payload"), F.lit(',"__END__"]'))))
    rows = compute_once(payloads, "_v", wrapped)
    outer = F.try_variant_get("_v", "$", "array<variant>")
    alone = (F.size(outer) == 2) & (F.try_variant_get(F.get(outer, F.lit(1)), "$", "string") == "__END__")
    rows = compute_once(rows, "_json", F.when(F.coalesce(alone, F.lit(False)), F.get(outer, F.lit(0))))
    items = F.try_variant_get("_json", "$", "array<variant>")
    as_map = F.transform(items, lambda x: F.try_variant_get(x, "$", "map<string,variant>"))
    return compute_once(rows, "items", as_map).drop("_v")


def validate_payloads(payloads: DataFrame) -> DataFrame:
    """Per payload: violations in checking order, first error, validity, findings, high findings.

    ``payloads``: unit_id, attempt_id, task, n_lines, payload.
    """
    rows = parse_payloads(payloads)
    n_lines = F.col("n_lines")
    whole = _messages([
        (ERRORS["missing"], F.col("payload").isNull()),
        (ERRORS["empty"], F.octet_length("payload") == 0),
        (ERRORS["long"].format(MAX_PAYLOAD_BYTES), F.octet_length("payload") > MAX_PAYLOAD_BYTES),
        (ERRORS["utf8"], ~F.is_valid_utf8("payload")),
        (ERRORS["json"], F.col("_json").isNull()),
        (ERRORS["top_level"], F.col("items").isNull()),
        (ERRORS["many_findings"].format(MAX_FINDINGS), F.size("items") > MAX_FINDINGS),
        (
            ERRORS["one_verdict"],
            (F.col("task") == "classification") & (F.size("items") != 1),
        ),
    ])
    per_item = _by_task(
        lambda task: F.flatten(F.transform(
            "items",
            lambda item, i: F.transform(
                _messages(_item_rules(task, item, n_lines)), lambda m: F.concat_ws(" ", F.lit("finding"), i, m)
            ),
        ))
    )
    none = F.array().cast("array<string>")
    rows = compute_once(rows, "violations", F.concat(whole, F.coalesce(per_item, none)))
    valid = F.size("violations") == 0
    high = F.filter("items", lambda item: _text(item["verdict"]) == HIGH)
    return rows.withColumn("schema_valid", valid).withColumn(
        "first_error", F.get("violations", F.lit(0))
    ).withColumn("n_findings", F.when(valid, F.size("items"))).withColumn("n_high", F.when(valid, F.size(high))).drop("_json")


def explode_findings(validated: DataFrame) -> DataFrame:
    """Findings of the valid payloads, one row each."""
    field = F.create_map(*[F.lit(x) for pair in FINDING_FIELD.items() for x in pair])[F.col("task")]
    rows = validated.filter("schema_valid").select(
        "unit_id", "attempt_id", "task", F.posexplode("items").alias("finding_index", "_item")
    )
    item = F.col("_item")
    return rows.select(
        "unit_id", "attempt_id", "task", "finding_index", _text(item["verdict"]).alias("verdict"),
        ws_trim(_text(item["timestamp"])).alias("timestamp"), ws_trim(_text(item[field])).alias("entity"),
        F.try_variant_get(item["source_lines"], "$", "array<bigint>").alias("source_lines"),
    )


def line_count_errors(slices: DataFrame, units: DataFrame) -> DataFrame:
    """Units whose slice length differs from the manifest: an infrastructure error, not a score.

    ``slices``: unit_id, n_found. ``units``: unit_id, n_lines.
    """
    rows = units.select("unit_id", "n_lines").join(slices.select("unit_id", "n_found"), "unit_id", "left")
    return rows.withColumn("n_found", F.coalesce("n_found", F.lit(0))).filter("n_found <> n_lines")
