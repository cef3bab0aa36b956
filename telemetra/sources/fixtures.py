"""Adapters from the driver's ``events`` table to the telemetry tables.

The driver ships TPC-H-style tables plus ``events(event_id, ts, user_id,
event_type, value, props)``. These functions derive, with plain column
expressions (no shuffle, fully pipelined into the scan's codegen stage), the
flat telemetry tables the operators consume:

* :func:`logs_from_events`   -> ``logs`` (OTLP log records, one per event)
* :func:`traces_from_events` -> ``traces`` (spans for view / click / error)
* :func:`gauge_from_events`, :func:`sum_from_events` -> metric points
* :func:`versioned_logs` / :func:`commits_from_versions` -> row-versioned history

The rules are fixed so that an independent SQL engine reproduces them
bit-for-bit (see ``telemetra/oracle.py``).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.functions.keys import hash_key
from telemetra.functions.timecols import ntz_literal, timestamp_to_micros
from telemetra.settings import DEFAULT

# Fixed value of the fixture adapter: commit 0 time.
COMMIT_EPOCH = datetime(2024, 2, 1)


def _s(c: Column) -> Column:
    return c.cast("string")


def _time_unix_nano() -> Column:
    return timestamp_to_micros("ts") * F.lit(1000) + F.col("event_id") % 1000


def _service() -> Column:
    return F.when(F.col("event_id") % 2 == 0, F.lit("web")).otherwise(F.lit("ios"))


def _device() -> Column:
    return F.concat(F.lit("d"), _s(F.col("user_id")), F.lit("-"), _s(F.col("event_id") % 2))


def logs_from_events(
    events: DataFrame,
    salt: str = DEFAULT.salt,
    subject_attr: str = DEFAULT.subject_attr,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    eid, et = F.col("event_id"), F.col("event_type")
    signup = et == "signup"
    body = (
        F.when(et == "view", "page_view")
        .when(et == "error", "exception")
        .when(et == "purchase", "purchase")
        .when(signup & (eid % 3 == 0), "signup_start")
        .when(signup & (eid % 3 == 1), "signup_complete")
        .when(signup, "identify")
        .when(eid % 4 == 0, "ai_request")
        .otherwise("add_to_cart")
    )
    severity = (
        F.when((et == "error") & (eid % 5 != 0), "ERROR")
        .when(eid % 211 == 0, F.lit(None).cast("string"))
        .otherwise("INFO")
    )
    uid_hash = hash_key(F.concat(F.lit("user"), _s(F.col("user_id"))), salt)
    m3 = _s(eid % 3)
    attributes = F.concat(
        F.lit('{"event.name":"'), et, F.lit('"'),
        F.when(eid % 101 == 0, F.lit("")).otherwise(F.concat(F.lit(',"anonymous.id":"'), _device(), F.lit('"'))),
        F.lit(',"session.id":"s'), _s(F.col("user_id")), F.lit("-"), _s(eid % 7), F.lit('"'),
        F.when(signup & (eid % 3 == 2), F.concat(F.lit(',"user.id":"'), uid_hash, F.lit('"'))).otherwise(F.lit("")),
        F.lit(',"page":"/p'), _s(eid % 5), F.lit('"'),
        F.when(et == "error", F.lit(',"exception.type":"TypeError","exception.message":"boom"')).otherwise(F.lit("")),
        F.when((et == "click") & (eid % 4 == 0), F.concat(
            F.lit(',"gen_ai.system":"sys'), m3, F.lit('","gen_ai.request.model":"m'), m3,
            F.lit('","gen_ai.usage.input_tokens":"'), _s(eid % 1950 + 50),
            F.lit('","gen_ai.usage.output_tokens":"'), _s(eid % 1480 + 20), F.lit('"'),
        )).otherwise(F.lit("")),
        F.when(eid % 83 == 0, F.lit(',"audit.action":"login"')).otherwise(F.lit("")),
        F.when(eid % 97 == 0, F.lit(f',"{subject_attr}":"billing"'))
        .when(eid % 89 == 0, F.lit(f',"{subject_attr}":"errors"'))
        .otherwise(F.lit("")),
        F.lit("}"),
    )
    return events.select(
        eid.alias("event_id"),
        _time_unix_nano().alias("time_unix_nano"),
        body.alias("body"),
        severity.alias("severity_text"),
        _service().alias("service_name"),
        attributes.alias("log_attributes"),
        *keep,
    )


def with_trace_context(logs: DataFrame) -> DataFrame:
    """``logs`` plus ``trace_id`` and ``span_id``: every second event that has a span names it, as an
    instrumented client does."""
    eid = F.col("event_id")
    named = F.col("body").isin("page_view", "exception", "ai_request", "add_to_cart") & (eid % 2 == 0)
    return logs.withColumn("trace_id", F.when(named, F.concat(F.lit("t"), _s(F.floor(eid / 4).cast("long"))))).withColumn(
        "span_id", F.when(named, F.concat(F.lit("s"), _s(eid))))


def traces_from_events(events: DataFrame) -> DataFrame:
    eid, et = F.col("event_id"), F.col("event_type")
    start = _time_unix_nano()
    duration = F.round(F.col("value") * F.lit(1e6)).cast("long")
    is_error = et == "error"
    attributes = F.concat(
        F.lit('{"http.route":"/r'), _s(F.col("user_id") % 5),
        F.lit('","outcome":"'), F.when(is_error, F.lit("failed")).otherwise(F.lit("success")),
        F.lit('","anonymous.id":"'), _device(), F.lit('"}'),
    )
    return events.where(et.isin("view", "click", "error")).select(
        F.concat(F.lit("t"), _s(F.floor(eid / 4).cast("long"))).alias("trace_id"),
        F.concat(F.lit("s"), _s(eid)).alias("span_id"),
        F.when(et == "view", "page_load").when(et == "click", "api_call").otherwise("route_change").alias("name"),
        _service().alias("service_name"),
        F.lit(1).alias("kind"),
        start.alias("start_time_unix_nano"),
        (start + duration).alias("end_time_unix_nano"),
        duration.alias("duration_time_unix_nano"),
        F.when(is_error, 2).otherwise(1).alias("status_code"),
        attributes.alias("span_attributes"),
    )


def _metric_points(events: DataFrame, name: Column, unit: str) -> DataFrame:
    return events.select(
        _time_unix_nano().alias("time_unix_nano"),
        name.alias("name"),
        F.lit(unit).alias("unit"),
        F.col("value").alias("double_value"),
        _service().alias("service_name"),
        F.concat(F.lit('{"page":"/p'), _s(F.col("event_id") % 5), F.lit('"}')).alias("metric_attributes"),
    )


def gauge_from_events(events: DataFrame) -> DataFrame:
    et = F.col("event_type")
    name = F.when(et == "view", "web_vitals_lcp_ms").otherwise("web_vitals_inp_ms")
    return _metric_points(events.where(et.isin("view", "click")), name, "ms")


def sum_from_events(events: DataFrame) -> DataFrame:
    return _metric_points(events.where(F.col("event_type") == "purchase"), F.lit("purchases_total"), "1")


def versioned_logs(events: DataFrame, salt: str = DEFAULT.salt, subject_attr: str = DEFAULT.subject_attr) -> DataFrame:
    """``logs`` plus row-version columns, in the same projection (no join).

    ``begin_snapshot`` is the commit that added the row (one commit per six days
    of data; 2 % of rows arrive one commit late) and ``end_snapshot`` the commit
    that deleted it (the first two days are deleted by commit 7), NULL = live.
    """
    day = F.dayofmonth("ts")
    begin = (F.floor((day - 1) / 6) + 1).cast("long") + F.when(F.col("event_id") % 50 == 0, 1).otherwise(0)
    end = F.when(day <= 2, F.lit(7).cast("long"))
    tagged = events.select("*", begin.alias("begin_snapshot"), end.alias("end_snapshot"))
    return logs_from_events(tagged, salt, subject_attr, keep=("begin_snapshot", "end_snapshot"))


def commits_from_versions(logs_v: DataFrame) -> DataFrame:
    """One row per snapshot id referenced by any row version.

    ``snapshot_time`` is one hour per id after 2024-02-01 00:00 (fixture rule).
    The id set is tiny (a handful of commits) and produced by a distinct
    aggregate, never collected.
    """
    ids = (
        logs_v.select(F.col("begin_snapshot").alias("snapshot_id"))
        .unionByName(logs_v.select(F.col("end_snapshot").alias("snapshot_id")))
        .where(F.col("snapshot_id").isNotNull())
        .distinct()
    )
    return ids.select(
        "snapshot_id",
        F.timestamp_add("HOUR", F.col("snapshot_id"), ntz_literal(COMMIT_EPOCH)).alias("snapshot_time"),
    )
