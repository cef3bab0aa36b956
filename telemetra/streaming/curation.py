"""Incremental curation of the raw log table into ``user_events``.

The curated table is fed by a file stream over the raw table's published
batches. Progress is the stream's checkpoint (which raw files were consumed),
never event time, so late and out-of-order events are always picked up; there
is deliberately no watermark (it could only drop rows). Each micro-batch is
curated with the same :func:`telemetra.operators.curate.curate` as the full
backfill and published once as ``<ue>/hot/batch=<stream>-<id>/subject=/person_bucket=/``
(see :mod:`telemetra.streaming.sinks`), so a restart neither loses nor repeats
rows. The first run of a fresh checkpoint is the full backfill: what was already
compacted into the raw table's ``cold`` part is curated as one batch of its own, the
rest by the stream. Beside each curated batch the raw files it read are published
(``consumed``), from which upkeep knows what may be compacted (``streaming/upkeep.py``).

Raw and curated tables each have a ``hot`` part (published micro-batches, the
part the downstream stream watches) and a ``cold`` part (compacted data, never
streamed). :func:`read_table` returns their union.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from telemetra.operators.curate import curate, has_curated_schema
from telemetra.plans import fs
from telemetra.plans.layout import CURATED_SORT, MAX_RECORDS_PER_FILE, curated_layout
from telemetra.plans.storage import job_path
from telemetra.schemas import USER_EVENTS, struct, L, S, I
from telemetra.settings import DEFAULT, Settings
from telemetra.streaming.sinks import COLD, HOT, MAX_FILE_AGE, publish_batch, stream_id

RAW_LOGS_INGESTED = struct(
    ("time_unix_nano", L), ("body", S), ("severity_text", S), ("severity_number", I), ("service_name", S),
    ("log_attributes", S), ("trace_id", S), ("span_id", S),
)


def _with(schema: T.StructType, *extra: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField(n, t, True) for n, t in extra])


def raw_schema(promote: tuple[str, ...] = DEFAULT.promote_resource_attrs) -> T.StructType:
    extra = [("resource_attr_" + n.replace(".", "_"), T.StringType()) for n in promote]
    return _with(RAW_LOGS_INGESTED, *extra, ("event_date", T.DateType()))


CURATED_PARTS = _with(USER_EVENTS, ("event_date", T.DateType()), ("person_bucket", T.IntegerType()))


def read_table(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Union of the hot (per-batch) and cold (compacted) parts of a streamed table."""
    parts = []
    for sub, sch in ((HOT, _with(schema, ("batch", T.StringType()))), (COLD, schema)):
        path = f"{root.rstrip('/')}/{sub}"
        if fs.exists(spark, path):
            parts.append(spark.read.schema(sch).parquet(path).select(*schema.fieldNames()))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_curated_batch(df: DataFrame, path: str, settings: Settings = DEFAULT) -> None:
    out = curated_layout(curate(df, settings.subject_attr), settings.buckets)
    parts = ["subject", "person_bucket"]
    (
        out.hint("rebalance", *parts)  # large folders spread over tasks; unlike ranges, no first pass that curates all rows
        .sortWithinPartitions(*parts, *CURATED_SORT)
        .write.mode("overwrite")
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .partitionBy("subject", "person_bucket")
        .parquet(path)
    )


FILE = "_raw_file"
CONSUMED = struct(("raw_batch", S), ("file", S), ("batch", S))


def consumed_root(ue_root: str) -> str:
    return f"{ue_root.rstrip('/')}/consumed"


def backfill_cold(spark: SparkSession, raw_root: str, ue_root: str, ckpt: str, settings: Settings = DEFAULT,
                  rollup_path: str | None = None) -> bool:
    """Before the first run of a stream: curates the compacted raw rows, which no stream reads, as one batch."""
    cold = f"{raw_root.rstrip('/')}/{COLD}"
    if fs.exists(spark, f"{ckpt.rstrip('/')}/metadata") or not fs.exists(spark, cold):
        return False
    rows = spark.read.schema(raw_schema(settings.promote_resource_attrs)).parquet(cold)
    new = publish_batch(rows, ue_root, 0, lambda d, p: write_curated_batch(d, p, settings), COLD)
    if rollup_path is not None:
        from telemetra.plans.rollup import publish_partials
        publish_partials(curate(rows, settings.subject_attr), rollup_path, 0, COLD)
    return new


def start_curation(spark: SparkSession, raw_root: str, ue_root: str, checkpoint: str | None = None,
                   settings: Settings = DEFAULT, trigger: dict | None = None,
                   max_files_per_trigger: int | None = None, rollup_path: str | None = None) -> StreamingQuery:
    """Curate every raw file published since the last run (first run = backfill).

    With ``rollup_path`` the stored daily rollup and distinct sketches (A20) are kept
    current: each micro-batch publishes the partials of its own rows beside it
    (:func:`telemetra.plans.rollup.publish_partials`), once, also when it is replayed.
    """
    schema = _with(raw_schema(settings.promote_resource_attrs), ("batch", T.StringType()))
    reader = spark.readStream.schema(schema).option("maxFileAge", MAX_FILE_AGE)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.parquet(f"{raw_root.rstrip('/')}/{HOT}").select("*", F.col("_metadata.file_path").alias(FILE))

    ckpt = checkpoint or job_path(spark, "telemetra", "checkpoints", "curate")
    backfill_cold(spark, raw_root, ue_root, ckpt, settings, rollup_path)

    def sink(batch: DataFrame, batch_id: int) -> None:
        stream = stream_id(spark, ckpt)
        publish_batch(batch, ue_root, batch_id, lambda d, p: write_curated_batch(d, p, settings), stream)
        if rollup_path is not None:
            from telemetra.plans.rollup import publish_partials
            publish_partials(curate(batch, settings.subject_attr), rollup_path, batch_id, stream)
        read = batch.select(F.col("batch").alias("raw_batch"), F.col(FILE).alias("file")).distinct()
        publish_batch(read, consumed_root(ue_root), batch_id, lambda d, p: d.write.mode("overwrite").parquet(p), stream)

    return (
        raw.writeStream.foreachBatch(sink)
        .option("checkpointLocation", ckpt)
        .trigger(**(trigger or {"availableNow": True}))
        .queryName("telemetra_curate")
        .start()
    )


def stored_columns(spark: SparkSession, ue_root: str) -> list[str]:
    """Columns of the stored curated files (empty if there are none yet)."""
    for sub in (HOT, COLD):
        path = f"{ue_root.rstrip('/')}/{sub}"
        if fs.exists(spark, path):
            try:
                return spark.read.parquet(path).columns
            except Exception:  # noqa: BLE001 - an empty folder has no schema
                continue
    return []


def ensure_curated(spark: SparkSession, ue_root: str, checkpoint: str) -> bool:
    """Drop a curated table whose schema predates ``subject`` and reset its progress.

    The table is fully derived from the raw table, so the next
    :func:`start_curation` rebuilds it from scratch. Returns True when reset.
    """
    cols = stored_columns(spark, ue_root)
    if cols and not has_curated_schema(cols):
        # progress first: if the driver is lost in between, the next run still finds the old
        # schema and starts over, instead of an empty table with full progress
        fs.delete(spark, checkpoint)
        fs.delete(spark, ue_root)
        return True
    return False


def curated_view(spark: SparkSession, ue_root: str) -> DataFrame:
    """The curated table (12 columns + layout columns) across hot and cold parts."""
    return read_table(spark, ue_root, CURATED_PARTS).withColumn("person_bucket", F.col("person_bucket").cast("int"))
