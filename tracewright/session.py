"""Session settings the operators are designed for, and the lineage-cutting helper."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Mapping
from pathlib import Path
from types import MappingProxyType

from pyspark.sql import DataFrame, SparkSession

# Runtime settings, safe to set on a session that already exists.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Joins here have one row per key on one side, so AQE can split a hot partition of the other
    # side without a rewrite; "force" keeps that even where it costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A broadcast passes through the driver's heap, and a plan here holds up to a score of them at once: only small tables go
    # that way, larger ones are shuffled.
    "spark.sql.autoBroadcastJoinThreshold": "1m",
    # A task sorts the whole of what it reads, and some megabytes of compressed rows are twenty times that in memory: tables grow
    # the number of tasks, not their size. A partition four times that size is split.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32m",
    "spark.sql.files.maxPartitionBytes": "16m",
    # Small tables still carry costly expressions (patterns, JSON): keep them on many cores.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # The evidence and grounding joins probe the full corpus with few keys.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


# The training-data operators join texts with tables of a few columns per document; their check figures hold with this.
LLM_CONF = {"spark.sql.autoBroadcastJoinThreshold": "64m"}


def configure(spark: SparkSession, changes: Mapping[str, str] = MappingProxyType({})) -> SparkSession:
    """Apply the runtime settings, with ``changes``, to ``spark`` and return it."""
    for key, value in {**RUNTIME_CONF, **changes}.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def send_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; the driver serves the archive."""
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    if not package.is_dir() or getattr(context, "_tracewright_package", None):
        return
    path = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(str(path))
    context._tracewright_package = str(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    A table is preferred to ``checkpoint()``: the plan runs once, later reads are pruned to their
    columns, and the planner knows the size of what it joins. A lost executor costs no replay.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tracewright-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
