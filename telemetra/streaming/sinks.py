"""Exactly-once micro-batch publishing for ``foreachBatch`` sinks.

Structured Streaming may run a micro-batch again after a failure (the sink
wrote, the offset commit did not happen). Each batch is therefore written to a
hidden staging folder and published by renaming it to ``batch=<stream>-<id>``,
where ``<stream>`` is the id the stream's own checkpoint gave it: a second feed
into the table, or the same feed with a fresh checkpoint, counts from 0 again but
never meets the folders of another stream. A batch whose folder is already
published is skipped, because a replayed batch of a replayable source carries the
same rows. A downstream file stream therefore
never sees a batch's files twice, and a half-written attempt is never visible
(staging folders start with ``_`` and are ignored by Spark's file listing).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from telemetra.plans import fs

HOT = "hot"
COLD = "cold"
MAX_FILE_AGE = "365000d"  # a file source otherwise ignores files a week older than the newest it has seen


def batch_dir(root: str, batch_id: int, stream: str = "0") -> str:
    return f"{root.rstrip('/')}/{HOT}/batch={stream}-{batch_id:020d}"


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id a running stream's checkpoint holds; it lives as long as the checkpoint."""
    return spark.read.json(checkpoint.rstrip("/") + "/metadata").first()["id"]


def is_published(spark: SparkSession, root: str, batch_id: int, stream: str = "0") -> bool:
    return fs.exists(spark, batch_dir(root, batch_id, stream) + "/_SUCCESS")


def publish_batch(df: DataFrame, root: str, batch_id: int, write, stream: str = "0") -> bool:
    """Write ``df`` with ``write(df, path)`` as batch ``batch_id`` of ``stream``; False if already published."""
    spark = df.sparkSession
    final = batch_dir(root, batch_id, stream)
    if is_published(spark, root, batch_id, stream):
        return False
    staging = f"{root.rstrip('/')}/_staging/batch={stream}-{batch_id:020d}-{uuid.uuid4().hex[:8]}"
    write(df, staging)
    if fs.exists(spark, final):
        fs.delete(spark, final)  # an unpublished partial attempt
    if not fs.rename(spark, staging, final):
        raise OSError(f"batch {batch_id} could not be published as {final}")
    return True
