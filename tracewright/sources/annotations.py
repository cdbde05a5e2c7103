"""Annotation files: one ``{scenario: [records]}`` object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import unescape
from ..lookups import ANNOTATION_FIELD
from .logs import artifact_hashes, decoded

RECORDS = "MAP<STRING, ARRAY<MAP<STRING, ARRAY<STRING>>>>"


def read_annotations(spark: SparkSession, root: str) -> DataFrame:
    """All files ``root/<dataset>/groundtruth-<task>.jsonl`` that exist, one row per record.

    dataset, task, scenario, record_index, timestamps, entities, extra. ``extra`` holds every other key of the record.
    """
    text = spark.read.option("pathGlobFilter", "groundtruth-*.jsonl").option("recursiveFileLookup", "true").text(root)
    path = F.split(decoded(F.col("_metadata.file_path")), "/")
    rows = text.filter(F.trim("value") != "").select(
        F.element_at(path, -2).alias("dataset"),
        F.regexp_extract(F.element_at(path, -1), r"^groundtruth-(.*)\.jsonl$", 1).alias("task"),
        F.explode(F.from_json("value", RECORDS)).alias("scenario", "_records"),
    )
    rows = rows.select("dataset", "task", "scenario", F.posexplode("_records").alias("record_index", "_r"))
    field = F.create_map(*[F.lit(x) for pair in ANNOTATION_FIELD.items() for x in pair])[F.col("task")]
    extra = F.map_filter("_r", lambda key, _: (key != "timestamp") & ~key.eqNullSafe(field))
    return rows.select(
        "dataset", "task", "scenario", F.col("record_index").cast("long").alias("record_index"),
        F.col("_r")["timestamp"].alias("timestamps"), F.transform(F.col("_r")[field], unescape).alias("entities"),
        extra.alias("extra"),
    )


def annotation_hashes(spark: SparkSession, root: str) -> DataFrame:
    return artifact_hashes(spark, root, "*.jsonl")
