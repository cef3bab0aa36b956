"""Continuous OTLP ingest into the raw table.

Export requests arrive as JSON text files (one request per line) in a landing
folder (a topic works the same way through the Kafka source: its ``value`` is
the request). The stream flattens them with the batch ingest functions and
publishes every micro-batch as ``<raw>/hot/batch=<stream>-<id>/event_date=<day>/``.
Requests that hold nothing it can read are published beside them, with their text and the
cause, as ``<raw>/rejected/hot/batch=<stream>-<id>/``: every request of the landing folder
is in exactly one of the two, also after a replay (both are published once).
Each request is parsed once: what it holds is written unsorted to a staging folder, from
which both are published (a sort by ranges reads its input twice).
``trigger`` controls freshness (``{"processingTime": "1 second"}``) or runs a
catch-up (``{"availableNow": True}``, also the final run on shutdown).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from telemetra.functions.timecols import date_of_ns
from telemetra.plans import fs
from telemetra.plans.layout import MAX_RECORDS_PER_FILE
from telemetra.plans.storage import job_path
from telemetra.schemas import S, struct
from telemetra.settings import DEFAULT
from telemetra.sources import otlp
from telemetra.streaming.sinks import HOT, MAX_FILE_AGE, is_published, publish_batch, stream_id

_INGEST = {
    "logs": ("time_unix_nano", ("body", "time_unix_nano")),
    "traces": ("start_time_unix_nano", ("name", "start_time_unix_nano")),
    "gauge": ("time_unix_nano", ("name", "time_unix_nano")),
    "sum": ("time_unix_nano", ("name", "time_unix_nano")),
}


def write_raw_batch(df: DataFrame, path: str, time_col: str, sort: tuple[str, ...]) -> None:
    out = df.withColumn("event_date", date_of_ns(time_col))
    (
        out.repartitionByRange("event_date", *sort)  # a busy day spreads over tasks
        .sortWithinPartitions("event_date", *sort)
        .write.mode("overwrite")
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .partitionBy("event_date")
        .parquet(path)
    )


REJECTED = struct(("payload", S), ("cause", S))


def rejected_root(raw_root: str) -> str:
    return raw_root.rstrip("/") + "/rejected"


def write_rejected(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_rejected(spark: SparkSession, raw_root: str) -> DataFrame:
    """``payload, cause`` of every rejected request, and the ``batch`` it came with."""
    hot = f"{rejected_root(raw_root)}/{HOT}"
    schema = T.StructType([*REJECTED.fields, T.StructField("batch", S)])
    return spark.read.schema(schema).parquet(hot) if fs.exists(spark, hot) else spark.createDataFrame([], schema)


def start_ingest(spark: SparkSession, landing_dir: str, raw_root: str, kind: str = "logs",
                 checkpoint: str | None = None, trigger: dict | None = None,
                 promote: Iterable[str] = DEFAULT.promote_resource_attrs,
                 max_files_per_trigger: int | None = None) -> StreamingQuery:
    time_col, sort = _INGEST[kind]
    # files are taken however old they are next to the newest one
    reader = spark.readStream.format("text").option("maxFileAge", MAX_FILE_AGE)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    payloads = reader.load(landing_dir).select(F.col("value").alias("payload"))
    promote = tuple(promote)
    ckpt = checkpoint or job_path(spark, "telemetra", "checkpoints", "ingest-" + kind)

    def sink(batch: DataFrame, batch_id: int) -> None:
        stream = stream_id(spark, ckpt)
        if all(is_published(spark, root, batch_id, stream) for root in (rejected_root(raw_root), raw_root)):
            return
        read = otlp.read_requests(batch, kind, promote)
        staging = f"{raw_root.rstrip('/')}/_staging/read={stream}-{batch_id:020d}-{uuid.uuid4().hex[:8]}"
        read.write.parquet(staging)
        read = spark.read.schema(read.schema).parquet(staging)
        bad = read.where(F.col("cause").isNotNull()).select(*REJECTED.fieldNames())
        records = read.where(F.col("cause").isNull()).drop(*REJECTED.fieldNames())
        # first, so that whoever sees the batch's records also sees what is missing from them
        publish_batch(bad, rejected_root(raw_root), batch_id, write_rejected, stream)
        publish_batch(records, raw_root, batch_id, lambda d, p: write_raw_batch(d, p, time_col, sort), stream)
        fs.delete(spark, staging)

    return (
        payloads.writeStream.foreachBatch(sink)
        .option("checkpointLocation", ckpt)
        .trigger(**(trigger or {"availableNow": True}))
        .queryName(f"telemetra_ingest_{kind}")
        .start()
    )
