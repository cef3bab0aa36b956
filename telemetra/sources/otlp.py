"""OTLP/JSON export requests <-> flat telemetry tables.

Ingest (``ingest_logs`` / ``ingest_traces`` / ``ingest_gauge`` / ``ingest_sum``)
takes a DataFrame with one export request per row in a string column
``payload`` (as read with ``spark.read.text`` / ``readStream.text`` from a
landing folder, or from a topic's value) and flattens it with ``from_json`` and
``explode`` (resource -> scope -> record). Each request is parsed once against an
explicit schema; nothing is inferred.

Attribute lists ``[{key, value: {stringValue | intValue | doubleValue |
boolValue}}]`` become one JSON object text. Duplicate keys keep the last value,
resolved inside the expression (no reliance on map-key policies).

The payload builders (``logs_payloads`` ...) go the other way; they exist to
produce landing data from the fixture tables and for round-trip tests. Each
request holds at most ``per_request`` records, so no group is unbounded.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetra.schemas import LOGS_PAYLOAD, METRICS_PAYLOAD, TRACES_PAYLOAD
from telemetra.settings import DEFAULT

# OTLP severity numbers for the texts the emitters use, the
# resource attribute holding the service name, the scope name written.
SEVERITY_NUMBER = {"ERROR": 17, "INFO": 9}
SERVICE_NAME = "service.name"
SCOPE_NAME = "telemetra"


# --- attribute lists ----------------------------------------------------------

def _value_text(v: Column) -> Column:
    return F.coalesce(
        v["stringValue"],
        v["intValue"],
        v["doubleValue"].cast("string"),
        v["boolValue"].cast("string"),
        v["arrayValue"],
        v["kvlistValue"],
        v["bytesValue"],
    )


def kv_to_json(kvs: Column) -> Column:
    """Attribute list -> JSON object text, last value wins for duplicate keys."""
    keys = F.transform(kvs, lambda x: x["key"])
    last = F.filter(
        kvs,
        lambda x, i: x["key"].isNotNull() & ~F.exists(
            F.slice(kvs, i + 2, F.greatest(F.size(kvs) - i - 1, F.lit(0))), lambda y: y["key"].eqNullSafe(x["key"])),
    )
    # an attribute without a key has no name to be read by; lists without a repeated key need no look at the rest
    kept = F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.filter(kvs, lambda x: x["key"].isNotNull())).otherwise(last)
    entries = F.transform(kept, lambda x: F.struct(x["key"].alias("key"), _value_text(x["value"]).alias("value")))
    return F.when(F.size(kvs) > 0, F.to_json(F.map_from_entries(entries))).otherwise(F.lit("{}"))


def kv_get(kvs: Column, key: str) -> Column:
    """Value text of one key in an attribute list (last occurrence)."""
    hits = F.filter(kvs, lambda x: x["key"] == key)
    return F.when(F.size(hits) > 0, _value_text(F.element_at(hits, -1)["value"]))


def json_to_kv(json_text: Column) -> Column:
    """JSON object text -> attribute list of string values (key order preserved)."""
    m = F.from_json(json_text, T.MapType(T.StringType(), T.StringType()))
    return F.transform(
        F.map_entries(m),
        lambda e: F.struct(
            e["key"].alias("key"),
            F.struct(
                e["value"].alias("stringValue"),
                F.lit(None).cast("string").alias("intValue"),
                F.lit(None).cast("double").alias("doubleValue"),
                F.lit(None).cast("boolean").alias("boolValue"),
            ).alias("value"),
        ),
    )


def _promoted(resource_kvs: Column, names: Iterable[str]) -> list[Column]:
    return [kv_get(resource_kvs, n).alias("resource_attr_" + n.replace(".", "_")) for n in names]


def parse_promote_list(text: str) -> tuple[str, ...]:
    """Comma list of resource attribute names; empty text disables promotion."""
    return tuple(s.strip() for s in text.split(",") if s.strip())


# --- ingest ---------------------------------------------------------------------

# payload schema and the list a request of each signal has to hold
SIGNALS = {"logs": (LOGS_PAYLOAD, "resourceLogs"), "traces": (TRACES_PAYLOAD, "resourceSpans"),
           "gauge": (METRICS_PAYLOAD, "resourceMetrics"), "sum": (METRICS_PAYLOAD, "resourceMetrics")}


def rejected(payloads: DataFrame, kind: str = "logs") -> DataFrame:
    """The requests that :func:`ingest_logs` (``kind``: and so on) can read nothing from, with a ``cause``:

    * ``blank``: no text at all;
    * ``malformed``: not one JSON value (a truncated request, say);
    * ``no_<list>``: JSON without the list of this signal, or with something else in its place.

    A request whose list is empty is valid and holds no records.
    """
    schema, top = SIGNALS[kind]
    bad = payloads.where(F.from_json(F.col("payload"), schema)[top].isNull())
    return bad.select("payload", _cause(F.col("payload"), top).alias("cause"))


def _cause(payload: Column, top: str) -> Column:
    text = F.coalesce(payload, F.lit(""))
    return (F.when(F.trim(text) == "", F.lit("blank"))
            .when(F.try_parse_json(text).isNull(), F.lit("malformed"))
            .otherwise(F.lit("no_" + top)))


def read_requests(payloads: DataFrame, kind: str = "logs", promote: Iterable[str] = ()) -> DataFrame:
    """The records of :func:`ingest_logs` (``kind``: and so on) and the requests of :func:`rejected`, both
    from one parse of each request: a rejected request is a row with a ``cause``, its ``payload`` and no
    record; records have neither."""
    ingest, schema, top, lists = _READERS[kind]
    parsed = payloads.select("payload", F.from_json(F.col("payload"), schema)[top].alias("_top"))
    cause = F.when(F.col("_top").isNull(), _cause(F.col("payload"), top))
    rows = parsed.select("_top", F.when(F.col("_top").isNull(), F.col("payload")).alias("payload"), cause.alias("cause"))
    return ingest(_flat(rows, "_top", *lists, keep=("payload", "cause")), promote, keep=("payload", "cause"))


def _explode(items: str, to: str, keep: tuple[str, ...]) -> list[Column]:
    """One row per item; with ``keep`` also one for a row without items that keeps a value, ``_at`` null."""
    return [F.posexplode_outer(items).alias("_at", to)] if keep else [F.explode(items).alias(to)]


def _held(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Drops the rows that hold neither an item nor a ``keep`` value."""
    return rows.where(F.col("_at").isNotNull() | F.col(keep[-1]).isNotNull()) if keep else rows


def _flat(rows: DataFrame, resources: str, scopes: str, items: str, keep: tuple[str, ...] = ()) -> DataFrame:
    each = _held(rows.select(*keep, *_explode(resources, "_r", keep)), keep)
    each = each.select(*keep, F.col("_r.resource.attributes").alias("_res"), F.col("_r." + scopes).alias("_l"))
    each = _held(each.select(*keep, "_res", *_explode("_l", "_s", keep)), keep)
    each = each.select(*keep, "_res", F.col("_s." + items).alias("_l"))
    return _held(each.select(*keep, "_res", *_explode("_l", "_x", keep)), keep).select(*keep, "_res", "_x")


def _records(payloads: DataFrame, schema: T.StructType, top: str, scopes: str, items: str) -> DataFrame:
    p = F.from_json(F.col("payload"), schema)
    return _flat(payloads.select(p[top].alias("_top")), "_top", scopes, items)


def ingest_logs(payloads: DataFrame, promote: Iterable[str] = DEFAULT.promote_resource_attrs) -> DataFrame:
    """``resourceLogs[].scopeLogs[].logRecords[]`` -> one ``logs`` row per record."""
    return _logs(_records(payloads, LOGS_PAYLOAD, "resourceLogs", "scopeLogs", "logRecords"), promote)


def _logs(records: DataFrame, promote: Iterable[str], keep: tuple[str, ...] = ()) -> DataFrame:
    x = F.col("_x")
    return records.select(
        *keep,
        x["timeUnixNano"].try_cast("long").alias("time_unix_nano"),
        _value_text(x["body"]).alias("body"),
        x["severityText"].alias("severity_text"),
        x["severityNumber"].alias("severity_number"),
        kv_get(F.col("_res"), SERVICE_NAME).alias("service_name"),
        kv_to_json(x["attributes"]).alias("log_attributes"),
        F.nullif(x["traceId"], F.lit("")).alias("trace_id"),
        F.nullif(x["spanId"], F.lit("")).alias("span_id"),
        *_promoted(F.col("_res"), promote),
    )


def ingest_traces(payloads: DataFrame, promote: Iterable[str] = ()) -> DataFrame:
    """``resourceSpans[].scopeSpans[].spans[]`` -> ``traces``; duration = end - start."""
    return _spans(_records(payloads, TRACES_PAYLOAD, "resourceSpans", "scopeSpans", "spans"), promote)


def _spans(records: DataFrame, promote: Iterable[str], keep: tuple[str, ...] = ()) -> DataFrame:
    x = F.col("_x")
    start = x["startTimeUnixNano"].try_cast("long")
    end = x["endTimeUnixNano"].try_cast("long")
    return records.select(
        *keep,
        x["traceId"].alias("trace_id"),
        x["spanId"].alias("span_id"),
        x["name"].alias("name"),
        kv_get(F.col("_res"), SERVICE_NAME).alias("service_name"),
        x["kind"].alias("kind"),
        start.alias("start_time_unix_nano"),
        end.alias("end_time_unix_nano"),
        (end - start).alias("duration_time_unix_nano"),
        F.coalesce(x["status"]["code"], F.lit(0)).alias("status_code"),
        kv_to_json(x["attributes"]).alias("span_attributes"),
        *_promoted(F.col("_res"), promote),
    )


def _ingest_points(payloads: DataFrame, kind: str, promote: Iterable[str]) -> DataFrame:
    return _points(_records(payloads, METRICS_PAYLOAD, "resourceMetrics", "scopeMetrics", "metrics"), kind, promote)


def _points(metrics: DataFrame, kind: str, promote: Iterable[str], keep: tuple[str, ...] = ()) -> DataFrame:
    pts = metrics.select(*keep, "_res", F.col("_x.name").alias("_n"), F.col("_x.unit").alias("_u"),
                         F.col("_x")[kind]["dataPoints"].alias("_l"))
    pts = _held(pts.select(*keep, "_res", "_n", "_u", *_explode("_l", "_d", keep)), keep)
    d = F.col("_d")
    return pts.select(
        *keep,
        d["timeUnixNano"].try_cast("long").alias("time_unix_nano"),
        F.col("_n").alias("name"),
        F.col("_u").alias("unit"),
        F.coalesce(d["asDouble"], d["asInt"].try_cast("double")).alias("double_value"),
        kv_get(F.col("_res"), SERVICE_NAME).alias("service_name"),
        kv_to_json(d["attributes"]).alias("metric_attributes"),
        *_promoted(F.col("_res"), promote),
    )


def ingest_gauge(payloads: DataFrame, promote: Iterable[str] = ()) -> DataFrame:
    """``...metrics[].gauge.dataPoints[]`` -> gauge points."""
    return _ingest_points(payloads, "gauge", promote)


def ingest_sum(payloads: DataFrame, promote: Iterable[str] = ()) -> DataFrame:
    """``...metrics[].sum.dataPoints[]`` -> sum points."""
    return _ingest_points(payloads, "sum", promote)


_READERS = {
    "logs": (_logs, *SIGNALS["logs"], ("scopeLogs", "logRecords")),
    "traces": (_spans, *SIGNALS["traces"], ("scopeSpans", "spans")),
    "gauge": (lambda m, promote, keep: _points(m, "gauge", promote, keep), *SIGNALS["gauge"], ("scopeMetrics", "metrics")),
    "sum": (lambda m, promote, keep: _points(m, "sum", promote, keep), *SIGNALS["sum"], ("scopeMetrics", "metrics")),
}


# --- payload builders (landing data for fixtures and round trips) --------------------

def _resource(service: Column, env: str | None) -> Column:
    kv = [F.struct(F.lit(SERVICE_NAME).alias("key"), F.struct(service.alias("stringValue")).alias("value"))]
    if env is not None:
        kv.append(F.struct(F.lit("deployment.environment").alias("key"), F.struct(F.lit(env).alias("stringValue")).alias("value")))
    return F.struct(F.array(*kv).alias("attributes"))


def _requests(df: DataFrame, record: Column, request_key: Column, top: str, scopes: str, items: str,
              env: str | None) -> DataFrame:
    grouped = df.groupBy(request_key.alias("_req"), F.col("service_name").alias("_svc")).agg(
        F.collect_list(record).alias("_items")
    )
    scope = F.struct(F.struct(F.lit(SCOPE_NAME).alias("name")).alias("scope"), F.col("_items").alias(items))
    res = F.struct(_resource(F.col("_svc"), env).alias("resource"), F.array(scope).alias(scopes))
    return grouped.select(F.to_json(F.struct(F.array(res).alias(top))).alias("payload"))


def _chunk(per_request: int) -> Column:
    # contiguous ids inside one input partition; never spans two partitions
    return F.floor(F.monotonically_increasing_id() / per_request)


def logs_payloads(logs: DataFrame, per_request: int = 50, env: str | None = "production") -> DataFrame:
    """``logs`` rows -> OTLP logs export requests of at most ``per_request`` records (with their trace
    context where ``logs`` has ``trace_id`` and ``span_id``)."""
    context = [F.col(c).alias(to) for c, to in (("trace_id", "traceId"), ("span_id", "spanId")) if c in logs.columns]
    sev = F.col("severity_text")
    sev_num = F.when(sev == "ERROR", SEVERITY_NUMBER["ERROR"]).when(sev == "INFO", SEVERITY_NUMBER["INFO"]).otherwise(0)
    record = F.struct(
        F.col("time_unix_nano").cast("string").alias("timeUnixNano"),
        sev_num.alias("severityNumber"),
        sev.alias("severityText"),
        F.struct(F.col("body").alias("stringValue")).alias("body"),
        json_to_kv(F.col("log_attributes")).alias("attributes"),
        *context,
    )
    key = F.floor(F.col("event_id") / per_request) if "event_id" in logs.columns else _chunk(per_request)
    return _requests(logs, record, key, "resourceLogs", "scopeLogs", "logRecords", env)


def traces_payloads(traces: DataFrame, per_request: int = 50, env: str | None = "production") -> DataFrame:
    record = F.struct(
        F.col("trace_id").alias("traceId"),
        F.col("span_id").alias("spanId"),
        F.col("name"),
        F.col("kind"),
        F.col("start_time_unix_nano").cast("string").alias("startTimeUnixNano"),
        F.col("end_time_unix_nano").cast("string").alias("endTimeUnixNano"),
        F.struct(F.col("status_code").alias("code")).alias("status"),
        json_to_kv(F.col("span_attributes")).alias("attributes"),
    )
    return _requests(traces, record, _chunk(per_request), "resourceSpans", "scopeSpans", "spans", env)


def metrics_payloads(points: DataFrame, kind: str = "gauge", per_request: int = 50,
                     env: str | None = "production") -> DataFrame:
    """Metric points -> export requests, one metric entry per point name and request."""
    point = F.struct(
        F.col("time_unix_nano").cast("string").alias("timeUnixNano"),
        F.col("double_value").alias("asDouble"),
        json_to_kv(F.col("metric_attributes")).alias("attributes"),
    )
    keyed = points.withColumn("_req0", _chunk(per_request))
    per_metric = keyed.groupBy("_req0", "service_name", "name", "unit").agg(F.collect_list(point).alias("_pts"))
    other = "sum" if kind == "gauge" else "gauge"
    metric = F.struct(
        F.col("name"), F.col("unit"),
        F.struct(F.col("_pts").alias("dataPoints")).alias(kind),
        F.lit(None).cast("struct<dataPoints:array<struct<timeUnixNano:string,asDouble:double>>>").alias(other),
    )
    grouped = per_metric.groupBy(F.col("_req0").alias("_req"), F.col("service_name").alias("_svc")).agg(
        F.collect_list(metric).alias("_items")
    )
    scope = F.struct(F.struct(F.lit(SCOPE_NAME).alias("name")).alias("scope"), F.col("_items").alias("metrics"))
    res = F.struct(_resource(F.col("_svc"), env).alias("resource"), F.array(scope).alias("scopeMetrics"))
    return grouped.select(F.to_json(F.struct(F.array(res).alias("resourceMetrics"))).alias("payload"))
