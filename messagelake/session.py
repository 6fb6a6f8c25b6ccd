"""The Spark session that the bench, the tests and the examples share."""

from __future__ import annotations

import os
from pyspark.sql import DataFrame, SparkSession

#: Settings that the engine relies on at any size; sizes come from the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cpus: int | str = 8, partitions: int = 8, **more: str) -> SparkSession:
    """A single-process session for tests and measurements."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("messagelake")
    conf = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": os.environ.get("MESSAGELAKE_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | more
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
