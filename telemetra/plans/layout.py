"""Physical layout of the stored tables and the read helpers that exploit it.

Raw tables (``logs``, ``traces``) are partitioned by UTC day and sorted by
event name and time inside each file. The curated ``user_events`` table is
partitioned ``subject / event_date / person_bucket`` (``person_bucket =
pmod(hash(coalesce(person_id, '')), buckets)``) and sorted by ``person_id,
event_time_unix_nano``, so a subject read, a time window and a single-person
read each prune to a few directories, and the sort lets Parquet row-group
statistics skip the rest.

Writers range-partition on the full layout key *including* the sort columns:
Spark samples the key distribution, so one hot person or one busy day is split
across many tasks instead of landing in one, while each task still writes only
a contiguous key range (few directories, few files). AQE coalesces the range
partitions to the advisory size; ``maxRecordsPerFile`` caps file size.

Read helpers add the partition predicates Catalyst cannot derive on its own: a
``person_id = x`` filter does not imply ``person_bucket = b`` and an
``event_time > t`` filter does not imply ``event_date >= d``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetra.functions.timecols import date_of_ns, ns_of, ntz_literal
from telemetra.plans import fs
from telemetra.plans.storage import job_path
from telemetra.schemas import LOGS, METRICS, TRACES, USER_EVENTS
from telemetra.settings import DEFAULT

MAX_RECORDS_PER_FILE = 5_000_000
NO_DAY = "__HIVE_DEFAULT_PARTITION__"  # folder of the rows whose partition value is NULL

RAW_LOGS_PARTITION = "event_date"
RAW_LOGS_SORT = ("body", "time_unix_nano")
TRACES_SORT = ("name", "start_time_unix_nano")
METRICS_SORT = ("name", "time_unix_nano")
CURATED_PARTITION = ("subject", "event_date", "person_bucket")
CURATED_SORT = ("person_id", "event_time_unix_nano")


def bucket_of(person: Column, buckets: int) -> Column:
    return F.pmod(F.hash(F.coalesce(person, F.lit(""))), F.lit(buckets))


def _with_schema(base: T.StructType, *extra: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType(list(base.fields) + [T.StructField(n, t, True) for n, t in extra])


RAW_LOGS_STORED = _with_schema(LOGS, ("event_date", T.DateType()))
TRACES_STORED = _with_schema(TRACES, ("event_date", T.DateType()))
METRICS_STORED = _with_schema(METRICS, ("event_date", T.DateType()))
CURATED_STORED = _with_schema(USER_EVENTS, ("event_date", T.DateType()), ("person_bucket", T.IntegerType()))
# the row-versioned raw log: raw layout plus the commit that added / removed each row
VERSIONED_LOGS_STORED = _with_schema(RAW_LOGS_STORED, ("begin_snapshot", T.LongType()), ("end_snapshot", T.LongType()))
COMMITS_STORED = T.StructType([T.StructField("snapshot_id", T.LongType(), True),
                               T.StructField("snapshot_time", T.TimestampNTZType(), True)])


# --- writers ---------------------------------------------------------------------

def bloom_options(*columns: str) -> dict[str, str]:
    """Parquet write options for Bloom filters on columns that are looked up by single values.

    The columns aren't sorted by, so row-group minima and maxima cover every value; a filter
    (sized to the row group's distinct values, 1 MB at most) lets a reader skip the row
    groups without the value. Chunks whose values fit a dictionary are skipped by that instead.
    """
    options = {"parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": str(1 << 20)}
    return options | {f"parquet.bloom.filter.enabled#{c}": "true" for c in columns}


def _write_sorted(df: DataFrame, path: str, partition: tuple[str, ...], sort: tuple[str, ...], mode: str,
                  looked_up: tuple[str, ...] = ()) -> None:
    keys = [*partition, *sort]
    (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.mode(mode)
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .options(**bloom_options(*looked_up))
        .partitionBy(*partition)
        .parquet(path)
    )


def write_raw_logs(logs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``logs`` partitioned by UTC day of ``time_unix_nano``, sorted by body, time."""
    out = logs.withColumn(RAW_LOGS_PARTITION, date_of_ns("time_unix_nano"))
    _write_sorted(out, path, (RAW_LOGS_PARTITION,), RAW_LOGS_SORT, mode)


def write_traces(traces: DataFrame, path: str, mode: str = "overwrite") -> None:
    out = traces.withColumn("event_date", date_of_ns("start_time_unix_nano"))
    _write_sorted(out, path, ("event_date",), TRACES_SORT, mode, looked_up=("trace_id",))


def write_metrics(points: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Metric points (gauge or sum): day partitions, sorted by metric name and time."""
    out = points.withColumn("event_date", date_of_ns("time_unix_nano"))
    _write_sorted(out, path, ("event_date",), METRICS_SORT, mode)


def curated_layout(ue: DataFrame, buckets: int = DEFAULT.buckets) -> DataFrame:
    return ue.withColumn("event_date", F.to_date("event_time")).withColumn(
        "person_bucket", bucket_of(F.col("person_id"), buckets))


def write_curated(ue: DataFrame, path: str, buckets: int = DEFAULT.buckets, mode: str = "overwrite",
                  day_level: bool = True) -> None:
    """``subject / event_date / person_bucket``, sorted by person and time.

    ``day_level=False`` drops the day directory level: worth it when a (subject, day,
    bucket) directory would hold less than about 64 MB, as the three levels then multiply
    into tiny files. ``event_date`` then stays a column inside the files, so the same
    read schema and predicates work and row-group statistics still prune by day.
    """
    partition = CURATED_PARTITION if day_level else tuple(c for c in CURATED_PARTITION if c != "event_date")
    _write_sorted(curated_layout(ue, buckets), path, partition, CURATED_SORT, mode)


# --- readers -----------------------------------------------------------------------

def partition_days(spark: SparkSession, *patterns: str) -> list[date | None]:
    """Days of the ``event_date=`` folders that match the glob patterns, newest first; the folder of
    rows without a day last. One listing per pattern, nothing is read."""
    names = {p.rstrip("/").rsplit("event_date=", 1)[1] for g in patterns for p in fs.glob(spark, f"{g.rstrip('/')}/event_date=*")}
    days = sorted((date.fromisoformat(n) for n in names if n != NO_DAY), reverse=True)
    return days + [None] * (NO_DAY in names)


def read_raw_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_LOGS_STORED).parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_STORED).parquet(path)


def read_versioned_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VERSIONED_LOGS_STORED).parquet(path)


def write_commits(commits: DataFrame, path: str) -> None:
    """The commit table: one row per snapshot (small by nature), one file."""
    commits.coalesce(1).write.mode("overwrite").parquet(path)


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMMITS_STORED).parquet(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACES_STORED).parquet(path)


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CURATED_STORED).parquet(path)


def person_filter(df: DataFrame, person_id: str, buckets: int = DEFAULT.buckets) -> Column:
    """``person_id = x`` plus the bucket predicate when the frame carries the layout."""
    cond = F.col("person_id") == F.lit(person_id)
    if "person_bucket" in df.columns:
        cond = cond & (F.col("person_bucket") == bucket_of(F.lit(person_id), buckets))
    return cond


def since_filter(df: DataFrame, lower: datetime, time_col: str = "event_time") -> Column:
    """``time > lower`` plus ``event_date >= date(lower)`` when partitioned by day."""
    cond = F.col(time_col) > ntz_literal(lower)
    if "event_date" in df.columns:
        cond = cond & (F.col("event_date") >= F.lit(lower.date()))
    return cond


def ns_between(df: DataFrame, lower: datetime | None, upper: datetime | None, time_col: str) -> Column:
    """``lower <= time <= upper`` on an epoch-ns column (None: open), plus the days when partitioned by them."""
    cond = F.lit(True)
    for at, inside in ((lower, lambda c, v: c >= F.lit(v)), (upper, lambda c, v: c <= F.lit(v))):
        if at is not None:
            cond = cond & inside(F.col(time_col), ns_of(at))
            if "event_date" in df.columns:
                cond = cond & inside(F.col("event_date"), at.date())
    return cond


# --- derived tables, landed once -------------------------------------------------------

def landed_path(spark: SparkSession, key: str, name: str) -> str:
    digest = hashlib.sha1(key.encode()).hexdigest()[:16]
    return job_path(spark, "telemetra", "tables", digest, name)


def materialized(spark: SparkSession, key: str, name: str, build: Callable[[], DataFrame],
                 write: Callable[[DataFrame, str], None], read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """Land ``build()`` once under the shared job folder and read it back.

    The location is keyed by ``key`` (source identity + layout version), so a
    changed source gets a new table. The table is written to a staging path and
    renamed into place after a successful write; a half-written attempt (lost
    executor, killed driver) is never read, and a rerun overwrites its staging.
    """
    digest = hashlib.sha1(key.encode()).hexdigest()[:16]
    final = landed_path(spark, key, name)
    if not fs.exists(spark, final + "/_SUCCESS"):
        staging = job_path(spark, "telemetra", "staging", digest, name + "-" + uuid.uuid4().hex[:8])
        write(build(), staging)
        if not fs.exists(spark, final + "/_SUCCESS"):
            fs.delete(spark, final)  # a half-published attempt, never a complete table
            if not fs.rename(spark, staging, final):
                raise OSError(f"{final} could not be published")
        else:
            fs.delete(spark, staging)  # another writer published the same table first
    return read(spark, final)
