"""Typed JSONL manifests and partitioned sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT_SCHEMA = (
    "unit_id string, rel_path string, sha256 string, dataset string, task string, representation string, os string, "
    "scenario_key string, group_id string, split string, start_line bigint, end_line bigint, n_lines bigint, "
    "window_index bigint, n_windows bigint, label string, quarantine_reason string"
)
TARGET_SCHEMA = (
    "target_id string, dataset string, task string, scenario string, scenario_key string, entity_kind string, "
    "aliases array<string>, precision string, status string, reason string, merged_records bigint"
)
EDGE_SCHEMA = "a string, b string, rule string, strength string, evidence string"


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows of a JSONL manifest. Blank lines hold no row; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_manifest(df: DataFrame, path: str, *partition_by: str, fmt: str = "json") -> None:
    """Write rows as ``json`` or ``parquet``, in one folder per value of ``partition_by``."""
    writer = df.write.mode("overwrite").format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def nested_split_manifest(files: DataFrame, groups: DataFrame, part_files: int = 1_000) -> DataFrame:
    """Groups with their attributes and files, in parts: one row per (split, group_id, part), of ``n_parts``.

    ``files``: split, group_id, rel_path, sha256, task, representation, lines, host, scenario_key. ``groups``: group_id,
    dataset, label, os, tasks. A group may hold a third of all files, so its array is cut into hashed parts of about
    ``part_files`` files, each with the hosts and scenario keys of its files; together the parts are the whole group.
    """
    sizes = files.groupBy("split", "group_id").agg(F.ceil(F.count(F.lit(1)) / part_files).alias("n_parts"))
    rows = files.join(sizes, ["split", "group_id"])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rel_path"), F.col("n_parts")))
    entry = F.struct("rel_path", "sha256", "task", "representation", "lines")
    parts = rows.groupBy("split", "group_id", "part", "n_parts").agg(
        F.array_sort(F.collect_set("host")).alias("hosts"), F.array_sort(F.collect_set("scenario_key")).alias("scenario_keys"),
        F.array_sort(F.collect_list(entry)).alias("files"),
    )
    return parts.join(groups.select("group_id", "dataset", "label", "os", "tasks"), "group_id")


def write_draws(draws: DataFrame, meta: DataFrame, path: str) -> None:
    """Draws as parquet, with the one-row description beside them."""
    draws.write.mode("overwrite").parquet(f"{path}/draws")
    meta.write.mode("overwrite").json(f"{path}/meta")


def json_cells(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for tabular sinks."""
    nested = ("array", "struct", "map", "variant")
    return df.select([
        F.to_json(c).alias(c) if t.startswith(nested) else F.col(c) for c, t in df.dtypes
    ])
