"""Settings that keyed state needs."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import SparkSession

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession, module: str) -> None:
    """Use the state store that keeps values, maps and timers per key.

    Processors of ``module`` are sent whole: Spark also runs them beside the driver, where files added to the session are not seen.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    cloudpickle.register_pickle_by_value(sys.modules[module])
