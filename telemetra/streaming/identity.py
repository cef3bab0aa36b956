"""J4 as a stored table, kept current arrival by arrival.

A sign-in gives a device an owner, also for everything the device did before. Rather than
backfilling the whole history each time, an arrival rewrites only what its sign-ins change:

* ``owners/``: per arrival, each device's earliest sign-in *of that arrival*. The owner of a
  device is the earliest over all arrivals, a minimum, so arrivals only ever add folders.
* ``events/batch=<arrival>/device_bucket=<b>/``: curated rows under their person as known,
  and the id each row came with (``own_id``), which a later owner can't be told from. New rows go into their own folder. Where an arrival changes a device's owner, the stored
  (batch, bucket) folders that hold rows of such a device are written anew by dynamic
  partition overwrite; all others, and every other bucket, aren't touched or even read.

Everything an arrival publishes is keyed by its id, and the rewritten folders are staged
as a table first: a replay, or the next run after a driver was lost half way, finds the staged
table complete and only repeats the overwrite (or, without one, computes it again from
folders not touched yet). While folders are swapped a reader can miss them for a moment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetra.operators.curate import IDENTIFY
from telemetra.plans import fs
from telemetra.plans.layout import bucket_of
from telemetra.schemas import L, S, USER_EVENTS, struct

OWNERS = struct(("device", S), ("at", L), ("uid", S), ("batch", L))
EVENTS = T.StructType([*USER_EVENTS.fields, T.StructField("own_id", S), T.StructField("batch", L), T.StructField("device_bucket", T.IntegerType())])
BUCKETS = 64


def _sign_ins(ue: DataFrame) -> DataFrame:
    """Per device its earliest sign-in: when, and as whom (ties: smallest uid)."""
    ident = ue.where((F.col("event") == IDENTIFY) & F.col("anonymous_id").isNotNull() & F.col("user_id").isNotNull())
    return ident.groupBy(F.col("anonymous_id").alias("device")).agg(
        F.min(F.struct(F.col("event_time_unix_nano").alias("at"), F.col("user_id").alias("uid"))).alias("s")).select("device", "s.at", "s.uid")


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if fs.exists(spark, path) else spark.createDataFrame([], schema)


def owners(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """``device, at, uid``: the earliest sign-in of each device (of the arrivals up to ``before``)."""
    rows = _read(spark, f"{root}/owners", OWNERS)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return rows.groupBy("device").agg(F.min(F.struct("at", "uid")).alias("s")).select("device", "s.at", "s.uid")


def read_events(spark: SparkSession, root: str) -> DataFrame:
    """The stored curated rows, every one under its person as known now."""
    return _read(spark, f"{root}/events", EVENTS).select(*USER_EVENTS.fieldNames())


def _identified(rows: DataFrame, own: DataFrame) -> DataFrame:
    """``rows`` under the id they came with, else their device's owner; rows without a device bypass the join."""
    held = rows.where(F.col("anonymous_id").isNotNull())
    joined = held.join(own.select("device", "uid"), held["anonymous_id"] == F.col("device"), "left")
    uid = F.coalesce(F.col("own_id"), F.col("uid"))
    new = {"user_id": uid, "person_id": F.coalesce(uid, F.col("anonymous_id"))}
    return joined.select(*(new.get(c, F.col(c)).alias(c) for c in rows.columns)).unionByName(
        rows.where(F.col("anonymous_id").isNull()))


def _publish(df: DataFrame, path: str) -> None:
    """Writes ``df`` as ``path`` once: through a staging folder and one rename."""
    spark = df.sparkSession
    if fs.exists(spark, path):
        return
    parent, name = path.rsplit("/", 1)
    staging = f"{parent}/_new-{name}"
    df.write.mode("overwrite").parquet(staging)
    if not fs.rename(spark, staging, path):
        raise OSError(f"{path} could not be published")


def add_arrival(ue: DataFrame, root: str, batch: int, buckets: int = BUCKETS) -> int:
    """Adds the curated rows ``ue`` as arrival ``batch`` (a growing number) and carries its sign-ins back to
    stored rows; returns how many stored folders were rewritten. Repeating an arrival changes nothing."""
    spark = ue.sparkSession
    _publish(_sign_ins(ue), f"{root}/owners/batch={batch}")
    own = owners(spark, root)
    mine = ue.select(*USER_EVENTS.fieldNames(), F.col("user_id").alias("own_id")).withColumn("batch", F.lit(batch).cast("long")).withColumn(
        "device_bucket", bucket_of(F.col("anonymous_id"), buckets).cast("int"))
    overwrite = {"partitionOverwriteMode": "dynamic"}

    def put(rows: DataFrame) -> None:
        rows.repartitionByRange("batch", "device_bucket", "anonymous_id", "event_time_unix_nano").sortWithinPartitions(
            "batch", "device_bucket", "anonymous_id", "event_time_unix_nano").write.mode("overwrite").options(**overwrite) \
            .partitionBy("batch", "device_bucket").parquet(f"{root}/events")

    staged = f"{root}/_changed/batch={batch}"
    if not fs.exists(spark, staged):
        earlier = owners(spark, root, before=batch)
        changed = own.join(earlier.withColumnsRenamed({"at": "was_at", "uid": "was_uid"}), "device", "left").where(
            ~F.col("uid").eqNullSafe(F.col("was_uid"))).select("device", "uid", bucket_of(F.col("device"), buckets).alias("b"))
        hit = [r["b"] for r in changed.select("b").distinct().collect()]       # at most ``buckets`` numbers
        stored = _read(spark, f"{root}/events", EVENTS).where(F.col("device_bucket").isin(hit) & (F.col("batch") < batch))
        folders = stored.join(changed, stored["anonymous_id"] == changed["device"], "left_semi").select("batch", "device_bucket").distinct()
        rows = stored.join(folders, ["batch", "device_bucket"], "left_semi").select(*EVENTS.fieldNames())
        _publish(_identified(rows, own), staged)
    put(_identified(mine, own))
    again = spark.read.schema(EVENTS).parquet(staged)
    put(again)
    return again.select("batch", "device_bucket").distinct().count()
