"""Log lines as a stream: the batch column functions on ``readStream`` input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timestamps as T
from ..lookups import TECHNIQUE_INDICATORS
from ..operators.evidence import indicator_match


def indicator_hits(lines: DataFrame) -> DataFrame:
    """Stateless: parsed lines that show a technique, one row per (line, technique).

    ``lines``: rel_path, representation, line.
    """
    shown = F.array_compact(F.array(*[
        F.when(indicator_match(F.lit(name), F.col("line")), F.lit(name)) for name in TECHNIQUE_INDICATORS
    ]))
    rows = lines.withColumn("ts", T.line_time(F.col("line"), F.col("representation")))
    return rows.withColumn("technique", F.explode(shown)).select("rel_path", "ts", "technique", "line")


def hit_counts(hits: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Hits per technique and event-time window, in append mode: a window comes out once it is ``delay`` old.

    Windows leave the state as they come out. Run in a UTC session: watermarks need ``TIMESTAMP``.
    """
    timed = hits.filter("ts is not null").withColumn("event_time", F.col("ts").cast("timestamp"))
    return timed.withWatermark("event_time", delay).groupBy(F.window("event_time", window), "technique").agg(
        F.count(F.lit(1)).alias("n_hits")
    ).select(F.col("window.start").alias("window_start"), "technique", "n_hits")
