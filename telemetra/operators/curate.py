"""Curation: raw ``logs`` -> the typed, classified per-person ``user_events``.

Everything is a per-row projection (no shuffle): the attribute JSON is parsed
once into a narrow struct, the subject is a ``coalesce``/``when`` chain over it
and the time is integer arithmetic. The same function is used for the full
backfill and inside each incremental micro-batch, so both paths agree by
construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.functions.attrs import parse_attrs
from telemetra.functions.timecols import ns_to_timestamp
from telemetra.schemas import USER_EVENT_COLUMNS
from telemetra.settings import DEFAULT, KNOWN_SUBJECTS

# Attribute keys read by curation.
USER_ID = "user.id"
ANONYMOUS_ID = "anonymous.id"
SESSION_ID = "session.id"
PAGE = "page"
EXCEPTION_TYPE = "exception.type"
AI_KEYS = ("gen_ai.system", "gen_ai.request.model", "llm.model")
AUDIT_ACTION = "audit.action"
IDENTIFY = "identify"

IDENTITY_KEYS = (USER_ID, ANONYMOUS_ID, SESSION_ID, PAGE)


def subject_keys(subject_attr: str) -> tuple[str, ...]:
    return (subject_attr, EXCEPTION_TYPE, *AI_KEYS, AUDIT_ACTION)


def subject_expr(a: Column, body: Column, severity: Column, subject_attr: str) -> Column:
    """Five-way subject from a parsed attribute struct ``a``.

    An explicit override wins; otherwise ERROR severity or an exception type ->
    errors; an AI model/system attribute -> ai_usage; an ``identify`` event or an
    audit action -> traceability; else activities. Any value outside the four
    known subjects (including an empty override) becomes ``other``.
    """
    derived = (
        F.when((severity == "ERROR") | a[EXCEPTION_TYPE].isNotNull(), F.lit("errors"))
        .when(a[AI_KEYS[0]].isNotNull() | a[AI_KEYS[1]].isNotNull() | a[AI_KEYS[2]].isNotNull(), F.lit("ai_usage"))
        .when((body == IDENTIFY) | a[AUDIT_ACTION].isNotNull(), F.lit("traceability"))
        .otherwise(F.lit("activities"))
    )
    raw = F.coalesce(a[subject_attr], derived)
    return F.when(raw.isin(*KNOWN_SUBJECTS), raw).otherwise(F.lit("other"))


def classify_subject(logs: DataFrame, subject_attr: str = DEFAULT.subject_attr) -> DataFrame:
    """``logs`` + ``subject`` column."""
    a = parse_attrs("log_attributes", subject_keys(subject_attr))
    return logs.withColumn("subject", subject_expr(a, F.col("body"), F.col("severity_text"), subject_attr))


def lift_identity(logs: DataFrame) -> DataFrame:
    """``logs`` + typed identity columns; ``person_id`` = user id if known, else device id."""
    a = parse_attrs("log_attributes", IDENTITY_KEYS)
    return logs.select(
        "*",
        a[USER_ID].alias("user_id"),
        a[ANONYMOUS_ID].alias("anonymous_id"),
        a[SESSION_ID].alias("session_id"),
        F.coalesce(a[USER_ID], a[ANONYMOUS_ID]).alias("person_id"),
        a[PAGE].alias("page"),
    )


def with_event_time(logs: DataFrame) -> DataFrame:
    return logs.withColumn("event_time", ns_to_timestamp("time_unix_nano"))


def curate(logs: DataFrame, subject_attr: str = DEFAULT.subject_attr, keep: tuple[str, ...] = ()) -> DataFrame:
    """Whole ``logs`` -> 12-column ``user_events`` (plus any ``keep`` columns).

    One JSON parse per row (``from_json`` into a struct of exactly the keys read).
    """
    parsed = logs.select(
        "time_unix_nano", "body", "severity_text", "service_name", "log_attributes", *keep,
        parse_attrs("log_attributes", (*IDENTITY_KEYS, *subject_keys(subject_attr))).alias("_a"),
    )
    a = F.col("_a")
    return parsed.select(
        ns_to_timestamp("time_unix_nano").alias("event_time"),
        F.col("time_unix_nano").alias("event_time_unix_nano"),
        subject_expr(a, F.col("body"), F.col("severity_text"), subject_attr).alias("subject"),
        F.col("body").alias("event"),
        a[USER_ID].alias("user_id"),
        a[ANONYMOUS_ID].alias("anonymous_id"),
        a[SESSION_ID].alias("session_id"),
        F.coalesce(a[USER_ID], a[ANONYMOUS_ID]).alias("person_id"),
        a[PAGE].alias("page"),
        "severity_text",
        "service_name",
        F.col("log_attributes").alias("attributes"),
        *keep,
    )


def has_curated_schema(columns: list[str]) -> bool:
    """False when a stored curated table predates ``subject`` and must be rebuilt."""
    return "subject" in columns and all(c in columns for c in USER_EVENT_COLUMNS)
