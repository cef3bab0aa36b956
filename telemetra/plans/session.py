"""Session settings for the jobs.

Only settings a Spark user would put in ``spark-defaults.conf`` for this
workload: AQE (runtime coalescing, skew-join splitting, broadcast decisions made
on measured sizes), a shuffle-partition count that AQE coalesces down, the
broadcast threshold that bounds what may be broadcast, and the UI off.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # partial aggregation always on; skewed groups are pre-aggregated map-side
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # broadcasts are only planned below this measured size (10 MB): the bound
    # that keeps a growing dimension from being shipped to every executor
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "telemetra",
                  extra: dict[str, str] | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app)
    conf = dict(CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf["spark.driver.memory"] = os.environ.get("SPARK_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
