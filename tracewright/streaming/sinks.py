"""Running a stream to the end of its input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import shared_dir


def drain(stream: DataFrame, output_mode: str = "complete", base: str | None = None, latest_by: str | None = None) -> DataFrame:
    """Process all available input and return the result table.

    Each batch is written by the executors to the shared checkpoint folder, under its number, so that a batch
    that is run again replaces itself; in complete mode it replaces the one before it. Without a batch the table is empty.
    With ``base``, a folder, a later call goes on where the last one with it ended. In update mode, ``latest_by`` names the key whose
    last row counts.
    """
    base = base or f"{shared_dir(stream.sparkSession).rstrip('/')}/tracewright-stream-{uuid.uuid4().hex}"
    schema = StructType(stream.schema.fields + [StructField("_batch", LongType())])
    stream.sparkSession.createDataFrame([], schema).write.mode("overwrite").parquet(f"{base}/table/none")

    def write(batch: DataFrame, number: int) -> None:
        place = "all" if output_mode == "complete" else f"batch-{number}"
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{base}/table/{place}")

    query = (
        stream.writeStream.foreachBatch(write).outputMode(output_mode)
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    table = stream.sparkSession.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/table")
    if latest_by is not None:
        table = table.groupBy(latest_by).agg(F.max_by(F.struct(*[c for c in stream.columns if c != latest_by]), "_batch").alias("_r")).select(latest_by, "_r.*")
    return table.select(*stream.columns)
