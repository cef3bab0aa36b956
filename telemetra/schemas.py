"""Explicit schemas for every table and payload (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
L = T.LongType()
I = T.IntegerType()
D = T.DoubleType()
NTZ = T.TimestampNTZType()


def struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# --- flat tables -----------------------------------------------------------
LOGS = struct(
    ("event_id", L),
    ("time_unix_nano", L),
    ("body", S),
    ("severity_text", S),
    ("service_name", S),
    ("log_attributes", S),
)

TRACES = struct(
    ("trace_id", S),
    ("span_id", S),
    ("name", S),
    ("service_name", S),
    ("kind", I),
    ("start_time_unix_nano", L),
    ("end_time_unix_nano", L),
    ("duration_time_unix_nano", L),
    ("status_code", I),
    ("span_attributes", S),
)

METRICS = struct(
    ("time_unix_nano", L),
    ("name", S),
    ("unit", S),
    ("double_value", D),
    ("service_name", S),
    ("metric_attributes", S),
)

USER_EVENTS = struct(
    ("event_time", NTZ),
    ("event_time_unix_nano", L),
    ("subject", S),
    ("event", S),
    ("user_id", S),
    ("anonymous_id", S),
    ("session_id", S),
    ("person_id", S),
    ("page", S),
    ("severity_text", S),
    ("service_name", S),
    ("attributes", S),
)
USER_EVENT_COLUMNS = USER_EVENTS.fieldNames()

COMMITS = struct(("snapshot_id", L), ("snapshot_time", NTZ))

# --- OTLP/JSON payloads (public OTLP JSON encoding) ------------------------
# arrays, key-value lists and bytes keep their JSON (or base64) text
ANY_VALUE = struct(("stringValue", S), ("intValue", S), ("doubleValue", D), ("boolValue", T.BooleanType()),
                   ("arrayValue", S), ("kvlistValue", S), ("bytesValue", S))
KEY_VALUE = T.ArrayType(struct(("key", S), ("value", ANY_VALUE)))
RESOURCE = struct(("attributes", KEY_VALUE))
SCOPE = struct(("name", S))

LOG_RECORD = struct(
    ("timeUnixNano", S),
    ("severityNumber", I),
    ("severityText", S),
    ("body", ANY_VALUE),
    ("attributes", KEY_VALUE),
    ("traceId", S),
    ("spanId", S),
)
LOGS_PAYLOAD = struct(
    ("resourceLogs", T.ArrayType(struct(
        ("resource", RESOURCE),
        ("scopeLogs", T.ArrayType(struct(("scope", SCOPE), ("logRecords", T.ArrayType(LOG_RECORD))))),
    ))),
)

SPAN = struct(
    ("traceId", S),
    ("spanId", S),
    ("name", S),
    ("kind", I),
    ("startTimeUnixNano", S),
    ("endTimeUnixNano", S),
    ("status", struct(("code", I))),
    ("attributes", KEY_VALUE),
)
TRACES_PAYLOAD = struct(
    ("resourceSpans", T.ArrayType(struct(
        ("resource", RESOURCE),
        ("scopeSpans", T.ArrayType(struct(("scope", SCOPE), ("spans", T.ArrayType(SPAN))))),
    ))),
)

DATA_POINT = struct(("timeUnixNano", S), ("asDouble", D), ("asInt", S), ("attributes", KEY_VALUE))
POINTS = struct(("dataPoints", T.ArrayType(DATA_POINT)))
METRIC = struct(("name", S), ("unit", S), ("gauge", POINTS), ("sum", POINTS))
METRICS_PAYLOAD = struct(
    ("resourceMetrics", T.ArrayType(struct(
        ("resource", RESOURCE),
        ("scopeMetrics", T.ArrayType(struct(("scope", SCOPE), ("metrics", T.ArrayType(METRIC))))),
    ))),
)
