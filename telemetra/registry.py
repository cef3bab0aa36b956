"""Registered queries: one per operator of the inventory, each with its oracle SQL.

``QUERIES[name] = (build, sql)``: ``build(spark, sf_dir) -> DataFrame`` runs the
operator over the whole tables of ``sf_dir``; ``sql`` is the equivalent DuckDB
query over the same ``events`` parquet (``None`` where no SQL form exists).
Column names are aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra import oracle as O
from telemetra.functions.keys import hash_key, hash_key_py, normalize_key, person_of_key
from telemetra.functions.timecols import date_of_ns, ns_of, ns_to_timestamp
from telemetra.operators import curate as C
from telemetra.operators import history as H
from telemetra.operators import identity as J
from telemetra.operators import product as W
from telemetra.operators import reports as R
from telemetra.operators import upkeep as M
from telemetra.schemas import USER_EVENT_COLUMNS
from telemetra.settings import DEFAULT
from telemetra.sources import otlp
from telemetra.sources.fixtures import with_trace_context
from telemetra.tables import Tables

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Build, str | None]] = {}
# entries that run a storage or streaming job (fresh folder per call) before returning its result
JOBS = ("ingest_stream", "ingest_rejected", "backfill_incremental", "cohort_retention_merged", "curate_incremental", "rebuild_curated", "rollup_incremental", "rollup_range",
        "visitors_range", "retention_sweep",
        "retention_sweep_signals", "retention_sweep_streamed", "retention_sweep_versioned", "compact", "expire_history")

# Parameters of the registered instances (the operators take them as arguments).
PERSON = "d3-0"              # a device-level person present at every scale
TRACE = "t7"
TRACE_TIMES = (datetime(2024, 1, 1), datetime(2024, 1, 20, 12))
SUBJECT = "errors"
BACKFILLED = hash_key_py("user3", DEFAULT.salt)  # a person known on some devices only after a sign-in
RAW_KEY = " User3 "          # the key a user types; the fixture's users are hashed under user<number>
PERSON_DAYS = 16
AI_DAYS = 7
AS_OF_AT = datetime(2024, 2, 1, 3, 30)
CHANGES = (2, 7)
RETENTION_DAYS = 7
FUNNEL = ("page_view", "add_to_cart", "purchase")
FUNNEL_DAYS = 7
RANGE = (date(2024, 1, 5), date(2024, 1, 24))  # day range of the long-range reports
RANGE_ERROR = 0.05           # three standard errors of the stored sketches
LATE_BEFORE = datetime(2024, 1, 16)  # curate_incremental: rows before this arrive after the newer ones


def register(name: str, sql: str | None):
    def deco(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = (lambda spark, sf_dir: fn(Tables(spark, sf_dir)), sql)
        return fn
    return deco


W_ = O.with_
UE_COLS = "event_time, event_time_unix_nano, subject, event, user_id, anonymous_id, session_id, person_id, page, severity_text, service_name, attributes"


# ---------------------------------------------------------------- curation

@register("classify_subject", W_("ue") + "SELECT event_time_unix_nano, event, subject FROM ue")
def _(t: Tables):
    return C.classify_subject(t.logs).select(
        F.col("time_unix_nano").alias("event_time_unix_nano"), F.col("body").alias("event"), "subject")


@register("lift_identity", W_("ue") + "SELECT event_time_unix_nano, user_id, anonymous_id, session_id, person_id, page FROM ue")
def _(t: Tables):
    return C.lift_identity(t.logs).select(
        F.col("time_unix_nano").alias("event_time_unix_nano"), "user_id", "anonymous_id", "session_id", "person_id", "page")


@register("event_time", W_("ue") + "SELECT event_time_unix_nano, event_time FROM ue")
def _(t: Tables):
    return C.with_event_time(t.logs).select(F.col("time_unix_nano").alias("event_time_unix_nano"), "event_time")


@register("curate_full", W_("ue") + f"SELECT {UE_COLS} FROM ue")
def _(t: Tables):
    return t.ue_columns


_LAID_OUT = W_("ue") + f"SELECT {UE_COLS}, CAST(event_time AS DATE) AS event_date FROM ue"


@register("write_curated", _LAID_OUT)
def _(t: Tables):
    return t.ue.select(*USER_EVENT_COLUMNS, "event_date")


@register("write_curated_by_day", _LAID_OUT)
def _(t: Tables):
    return t.by_day.ue.select(*USER_EVENT_COLUMNS, "event_date")


@register("hash_key", "SELECT user_id, substr(sha256(concat('salt', 'user', CAST(user_id AS VARCHAR))), 1, 32) AS person_key "
          "FROM (SELECT DISTINCT user_id FROM events) u")
def _(t: Tables):
    u = t.events.select("user_id").distinct()
    return u.select("user_id", hash_key(F.concat(F.lit("user"), F.col("user_id").cast("string")), DEFAULT.salt).alias("person_key"))


_RAW_KEY = "concat(' User', CAST(user_id AS VARCHAR), '@Example.COM ')"


@register("normalize_key",
          f"SELECT user_id, lower(trim({_RAW_KEY})) AS normalized, "
          f"substr(sha256(concat('salt', lower(trim({_RAW_KEY})))), 1, 32) AS person_key "
          "FROM (SELECT DISTINCT user_id FROM events) u")
def _(t: Tables):
    raw = F.concat(F.lit(" User"), F.col("user_id").cast("string"), F.lit("@Example.COM "))
    norm = normalize_key(raw)
    return t.events.select("user_id").distinct().select(
        "user_id", norm.alias("normalized"), hash_key(norm, DEFAULT.salt).alias("person_key"))


# ---------------------------------------------------------------- projections

@register("sample", W_("logs") + "SELECT body, severity_text, log_attributes FROM logs ORDER BY time_unix_nano, body, log_attributes LIMIT 1")
def _(t: Tables):
    return R.sample(t.logs, t.days("logs"))


@register("trace_journey", W_("traces") +
          f"SELECT start_time_unix_nano, service_name, name, status_code, span_id FROM traces "
          f"WHERE trace_id = '{TRACE}' ORDER BY start_time_unix_nano, span_id")
def _(t: Tables):
    return R.trace_journey(t.traces, TRACE)


@register("trace_journey_between", W_("traces") +
          f"SELECT start_time_unix_nano, service_name, name, status_code, span_id FROM traces WHERE trace_id = '{TRACE}' "
          f"AND start_time_unix_nano BETWEEN {O.ns(TRACE_TIMES[0])} AND {O.ns(TRACE_TIMES[1])}")
def _(t: Tables):
    return R.trace_journey(t.traces, TRACE, *TRACE_TIMES)


@register("person_window", W_("ue") +
          f"SELECT event_time, event_time_unix_nano, subject, event, severity_text, page FROM ue "
          f"WHERE person_id = '{PERSON}' AND {O.since(PERSON_DAYS)} ORDER BY event_time_unix_nano DESC, event")
def _(t: Tables):
    return R.person_window(t.ue, PERSON, PERSON_DAYS)


# the logs carry no consent attribute: here every fifth event denies it, every third grants it, in mixed spelling
@register("consent_filter", W_("logs") +
          ", asked AS (SELECT event_id, body, CASE WHEN event_id % 5 = 0 THEN 'Denied' WHEN event_id % 3 = 0 THEN ' Granted ' "
          "WHEN event_id % 7 = 0 THEN '' END AS consent FROM logs) "
          "SELECT event_id, body FROM asked WHERE consent IS NULL OR lower(trim(consent)) IN ('granted', 'true', 'yes', '1')")
def _(t: Tables):
    eid = F.col("event_id")
    consent = (F.when(eid % 5 == 0, "Denied").when(eid % 3 == 0, " Granted ").when(eid % 7 == 0, ""))
    added = F.concat(F.expr("substring(log_attributes, 1, length(log_attributes) - 1)"), F.lit(',"consent":"'), consent, F.lit('"}'))
    return R.consent_filter(t.logs.withColumn("log_attributes", F.coalesce(added, "log_attributes"))).select("event_id", "body")


_LOG_TYPES = (("event_id", "bigint"), ("time_unix_nano", "bigint"), ("body", "string"), ("severity_text", "string"),
              ("service_name", "string"), ("log_attributes", "string"))


@register("table_schema", W_("logs") + " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS place, '{c}' AS name, '{k}' AS type, count({c}) AS filled FROM logs"
    for i, (c, k) in enumerate(_LOG_TYPES, 1)))
def _(t: Tables):
    return R.table_schema(t.logs.drop("event_date"))


# ---------------------------------------------------------------- aggregations

@register("count_logs", W_("logs") + "SELECT count(*) AS n FROM logs")
def _(t: Tables):
    return R.count_logs(t.logs)


@register("events_by_name", W_("logs") + "SELECT body AS event, count(*) AS c FROM logs GROUP BY body")
def _(t: Tables):
    return R.events_by_name(t.logs)


@register("error_count", W_("logs") + "SELECT count(*) FILTER (WHERE severity_text = 'ERROR') AS errors FROM logs")
def _(t: Tables):
    return R.error_count(t.logs)


_ANON = "json_extract_string(log_attributes, '$.\"anonymous.id\"')"
_UID = "json_extract_string(log_attributes, '$.\"user.id\"')"
_PAGE = "json_extract_string(log_attributes, '$.\"page\"')"


@register("distinct_devices", W_("logs") + f"SELECT count(DISTINCT {_ANON}) AS devices FROM logs")
def _(t: Tables):
    return R.distinct_devices(t.logs)


@register("identified_persons", W_("logs") + f"SELECT count(DISTINCT {_UID}) AS identified FROM logs WHERE body = 'identify'")
def _(t: Tables):
    return R.identified_persons(t.logs)


_FUNNEL_SQL = ("count(*) FILTER (WHERE body = 'signup_start') AS starts, "
               "count(*) FILTER (WHERE body = 'signup_complete') AS completes")
_CONV = "CASE WHEN starts > 0 THEN completes / starts * 100.0 ELSE 0.0 END AS conv"


@register("signup_funnel", W_("logs") + f"SELECT starts, completes, {_CONV} FROM (SELECT {_FUNNEL_SQL} FROM logs) f")
def _(t: Tables):
    return R.signup_funnel(t.logs)


@register("page_views", W_("logs") + f"SELECT {_PAGE} AS page, count(*) AS views FROM logs WHERE body = 'page_view' GROUP BY 1")
def _(t: Tables):
    return R.page_views(t.logs)


@register("report", W_("logs") +
          f"SELECT total, errors, devices, identified, starts, completes, {_CONV} FROM ("
          f"SELECT count(*) AS total, count(*) FILTER (WHERE severity_text = 'ERROR') AS errors, "
          f"count(DISTINCT {_ANON}) AS devices, "
          f"count(DISTINCT CASE WHEN body = 'identify' THEN {_UID} END) AS identified, {_FUNNEL_SQL} FROM logs) r")
def _(t: Tables):
    return R.report(t.logs)


@register("span_p95", W_("traces") +
          "SELECT name, round(quantile_cont(duration_time_unix_nano, 0.95)) / 1e6 AS p95_ms, count(*) AS c "
          "FROM traces GROUP BY name")
def _(t: Tables):
    return R.span_p95(t.traces)


@register("metrics_summary", W_("gauge") + "SELECT name, count(*) AS c, round(avg(double_value), 1) AS avg FROM gauge GROUP BY name")
def _(t: Tables):
    return R.metrics_summary(t.gauge)


_ROUTE = "json_extract_string(span_attributes, '$.\"http.route\"')"


@register("route_health", W_("traces") +
          f"SELECT {_ROUTE} AS route, count(*) AS calls, count(*) FILTER (WHERE status_code = 2) AS errors, "
          "round(quantile_cont(duration_time_unix_nano, 0.95) / 1e6) AS p95_ms FROM traces GROUP BY 1")
def _(t: Tables):
    return R.route_health(t.traces)


@register("outcome_rate", W_("traces") +
          "SELECT outcome, spans, errors, round(errors / spans, 6) AS error_rate FROM ("
          "SELECT json_extract_string(span_attributes, '$.\"outcome\"') AS outcome, count(*) AS spans, "
          "count(*) FILTER (WHERE status_code = 2) AS errors FROM traces GROUP BY 1) o")
def _(t: Tables):
    return R.outcome_rate(t.traces)


@register("curated_totals", W_("ue") +
          "SELECT count(*) AS total, count(DISTINCT person_id) AS persons, count(DISTINCT user_id) AS identified FROM ue")
def _(t: Tables):
    return R.curated_totals(t.ue)


@register("curated_by_subject", W_("ue") + "SELECT subject, count(*) AS c FROM ue GROUP BY subject")
def _(t: Tables):
    return R.curated_by_subject(t.ue)


@register("curation_lag", W_("ue") +
          "SELECT ((SELECT max(time_unix_nano) FROM logs) - (SELECT max(event_time_unix_nano) FROM ue)) / 1e9 AS lag_seconds")
def _(t: Tables):
    return R.curation_lag(t.logs, t.ue)


@register("top_persons", W_("ue") +
          "SELECT person_id, count(*) AS c, max(event_time) AS last_time FROM ue GROUP BY person_id "
          "ORDER BY c DESC, person_id ASC NULLS LAST LIMIT 10")
def _(t: Tables):
    return R.top_persons(t.ue)


@register("user_event_types", W_("ue") + f"SELECT event, count(*) AS c FROM ue WHERE person_id = '{PERSON}' GROUP BY event")
def _(t: Tables):
    return R.user_event_types(t.ue, PERSON)


@register("subject_top_events", W_("ue") +
          f"SELECT event, count(*) AS c FROM ue WHERE subject = '{SUBJECT}' GROUP BY event "
          "ORDER BY c DESC, event ASC NULLS LAST LIMIT 10")
def _(t: Tables):
    return R.subject_top_events(t.ue, SUBJECT)


@register("user_event_types_window", W_("ue") +
          f"SELECT event, count(*) AS c FROM ue WHERE person_id = '{PERSON}' AND {O.since(PERSON_DAYS)} GROUP BY event")
def _(t: Tables):
    return R.user_event_types(t.ue, PERSON, PERSON_DAYS)


@register("subject_top_events_window", W_("ue") +
          f"SELECT event, count(*) AS c FROM ue WHERE subject = '{SUBJECT}' AND {O.since(PERSON_DAYS)} GROUP BY event "
          "ORDER BY c DESC, event ASC NULLS LAST LIMIT 10")
def _(t: Tables):
    return R.subject_top_events(t.ue, SUBJECT, PERSON_DAYS)


@register("ai_usage_by_model", W_("ue") +
          "SELECT json_extract_string(attributes, '$.\"gen_ai.request.model\"') AS model, count(*) AS calls FROM ue "
          f"WHERE subject = 'ai_usage' AND {O.since(AI_DAYS)} GROUP BY 1")
def _(t: Tables):
    return R.ai_usage_by_model(t.ue, AI_DAYS)


@register("ai_tokens_by_model", W_("ue") +
          "SELECT json_extract_string(attributes, '$.\"gen_ai.request.model\"') AS model, count(*) AS calls, "
          "CAST(sum(TRY_CAST(json_extract_string(attributes, '$.\"gen_ai.usage.input_tokens\"') AS BIGINT)) AS BIGINT) AS input_tokens, "
          "CAST(sum(TRY_CAST(json_extract_string(attributes, '$.\"gen_ai.usage.output_tokens\"') AS BIGINT)) AS BIGINT) AS output_tokens "
          "FROM ue WHERE json_extract_string(attributes, '$.\"gen_ai.request.model\"') IS NOT NULL GROUP BY 1")
def _(t: Tables):
    return R.ai_tokens_by_model(t.ue)


_DAY = "DATE '1970-01-01' + CAST(event_time_unix_nano // 86400000000000 AS INTEGER)"


@register("rollup_daily", W_("ue") + f"SELECT {_DAY} AS event_date, event, page, count(*) AS events FROM ue GROUP BY 1, 2, 3")
def _(t: Tables):
    return W.rollup_daily(t.ue)


_ROLLUP_SQL = W_("ue") + f"SELECT {_DAY} AS event_date, event, page, count(*) AS events FROM ue GROUP BY 1, 2, 3"


def _land_partials(t: Tables, job: str) -> str:
    """The partials of three arrivals: the newer half of the month, the older mornings, the older afternoons.

    The second arrival is replayed and the first two are merged before the third."""
    from telemetra.plans import rollup
    root = f"{_run_dir(t, job)}/rollup"
    newer, morning = F.col("event_time_unix_nano") >= F.lit(ns_of(LATE_BEFORE)), F.hour("event_time") < 12
    parts = [newer, ~newer & morning, ~newer & ~morning]
    for batch in (0, 1, 1):
        rollup.publish_partials(t.ue.where(parts[batch]), root, batch)
    rollup.merge_partials(t.spark, root)
    rollup.publish_partials(t.ue.where(parts[2]), root, 2)
    return root


@register("rollup_incremental", _ROLLUP_SQL)
def _(t: Tables):
    from telemetra.plans import rollup
    return rollup.read_rollup(t.spark, _land_partials(t, "rollup_incremental"))


@register("rollup_range", W_("ue") + f"SELECT event, CAST(count(*) AS BIGINT) AS events FROM ue "
          f"WHERE {_DAY} BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}' GROUP BY event")
def _(t: Tables):
    from telemetra.plans import rollup
    return rollup.read_rollup(t.spark, _land_partials(t, "rollup_range"), *RANGE).groupBy("event").agg(
        F.sum("events").alias("events"))


# stored sketches of a day range beside the exact counts; near: off by at most RANGE_ERROR
@register("visitors_range", W_("ue") +
          f", r AS (SELECT * FROM ue WHERE {_DAY} BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}') "
          "SELECT 'events' AS measure, count(*) AS exact, true AS near FROM r UNION ALL "
          "SELECT 'devices', count(DISTINCT anonymous_id), true FROM r UNION ALL "
          "SELECT 'persons', count(DISTINCT person_id), true FROM r UNION ALL "
          "SELECT 'users', count(DISTINCT user_id), true FROM r UNION ALL "
          "SELECT 'signed_in', count(DISTINCT user_id) FILTER (WHERE event = 'identify'), true FROM r")
def _(t: Tables):
    from telemetra.plans import rollup
    got = rollup.read_visitors(t.spark, _land_partials(t, "visitors_range"), *RANGE)
    inside = t.ue.where(date_of_ns("event_time_unix_nano").between(*map(F.lit, RANGE)))
    exact = inside.agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("anonymous_id").alias("devices"),
        F.count_distinct("person_id").alias("persons"), F.count_distinct("user_id").alias("users"),
        F.count_distinct(F.when(F.col("event") == C.IDENTIFY, F.col("user_id"))).alias("signed_in"))
    long = [d.unpivot([], list(exact.columns), "measure", v) for d, v in ((got, "estimate"), (exact, "exact"))]
    return long[0].join(long[1], "measure").select(
        "measure", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= RANGE_ERROR * F.col("exact")).alias("near"))


# ---------------------------------------------------------------- top-k (K1-K5)

_NEWEST = "time_unix_nano DESC, service_name, body, log_attributes"


@register("recent_errors", W_("logs") +
          f", newest AS (SELECT *, row_number() OVER (ORDER BY {_NEWEST}) AS place FROM logs WHERE severity_text = 'ERROR') "
          "SELECT time_unix_nano, service_name, log_attributes ->> '$.\"exception.type\"' AS exception_type, "
          "log_attributes ->> '$.\"exception.message\"' AS exception_message FROM newest WHERE place <= 10")
def _(t: Tables):
    return R.recent_errors(t.logs, days=t.days("logs"))


@register("recent_events", W_("logs") +
          f", newest AS (SELECT *, row_number() OVER (ORDER BY {_NEWEST}) AS place FROM logs) "
          f"SELECT time_unix_nano, body, severity_text, {_ANON} AS anonymous_id, {_PAGE} AS page FROM newest WHERE place <= 5")
def _(t: Tables):
    return R.recent_events(t.logs, days=t.days("logs"))


@register("recent_spans", W_("traces") +
          "SELECT start_time_unix_nano, name, service_name, duration_time_unix_nano FROM traces "
          "ORDER BY start_time_unix_nano DESC, span_id DESC LIMIT 5")
def _(t: Tables):
    return R.recent_spans(t.traces, days=t.days("traces"))


@register("user_timeline", W_("ue") +
          f", f AS (SELECT * FROM ue WHERE person_id = '{PERSON}') "
          "SELECT event_time, event, page, severity_text, session_id, (SELECT count(*) FROM f) AS total, "
          f"greatest((SELECT count(*) FROM f) - {DEFAULT.timeline_cap}, 0) AS more FROM f "
          f"ORDER BY event_time_unix_nano DESC, event, session_id, attributes LIMIT {DEFAULT.timeline_cap}")
def _(t: Tables):
    return R.user_timeline(t.ue, PERSON)


@register("subject_recent", W_("ue") +
          f"SELECT event_time, event, person_id, page FROM ue WHERE subject = '{SUBJECT}' "
          f"ORDER BY event_time_unix_nano DESC, person_id ASC NULLS LAST, event, attributes LIMIT {DEFAULT.subject_recent_cap}")
def _(t: Tables):
    day = t.by_day
    return R.subject_recent(day.ue, SUBJECT, partition_days=day.days("user_events", f"subject={SUBJECT}"))


@register("subject_recent_window", W_("ue") +
          f"SELECT event_time, event, person_id, page FROM ue WHERE subject = '{SUBJECT}' AND {O.since(AI_DAYS)} "
          f"ORDER BY event_time_unix_nano DESC, person_id ASC NULLS LAST, event, attributes LIMIT {DEFAULT.subject_recent_cap}")
def _(t: Tables):
    day = t.by_day
    return R.subject_recent(day.ue, SUBJECT, AI_DAYS, partition_days=day.days("user_events", f"subject={SUBJECT}"))


@register("timeline_of_key", W_("ue") +
          f", f AS (SELECT * FROM ue WHERE person_id = substr(sha256('salt' || '{RAW_KEY.strip().lower()}'), 1, 32)) "
          "SELECT event_time, event, page, severity_text, session_id, (SELECT count(*) FROM f) AS total, "
          f"greatest((SELECT count(*) FROM f) - {DEFAULT.timeline_cap}, 0) AS more FROM f "
          f"ORDER BY event_time_unix_nano DESC, event, session_id, attributes LIMIT {DEFAULT.timeline_cap}")
def _(t: Tables):
    return R.user_timeline(t.ue, person_of_key(RAW_KEY, DEFAULT.salt, "email"))


# ---------------------------------------------------------------- identity

# who signed in on which device, once per pair
_SIGN_INS = (f", sign_in AS (SELECT {_ANON} AS device, {_UID} AS person FROM logs WHERE body = 'identify' GROUP BY ALL), "
             "owned AS (SELECT person AS uid, count(device) AS devices FROM sign_in GROUP BY person) ")


@register("stitch_devices", W_("logs") + _SIGN_INS +
          "SELECT uid, devices FROM owned QUALIFY row_number() OVER (ORDER BY devices DESC, uid NULLS LAST) <= 10")
def _(t: Tables):
    return J.stitch_devices(t.logs)


@register("stitch_multi_device", W_("logs") + _SIGN_INS +
          "SELECT count(*) AS persons, count_if(devices > 1) AS multi_device FROM owned")
def _(t: Tables):
    return J.stitch_multi_device(t.logs)


@register("stitch_events", W_("logs") + _SIGN_INS +
          f", activity AS (SELECT {_ANON} AS device, count(*) AS n FROM logs WHERE body <> 'identify' GROUP BY 1), "
          "person_activity AS (SELECT person AS uid, CAST(sum(n) AS BIGINT) AS events FROM sign_in JOIN activity USING (device) GROUP BY person) "
          "SELECT uid, events FROM person_activity QUALIFY row_number() OVER (ORDER BY events DESC, uid NULLS LAST) <= 5")
def _(t: Tables):
    return J.stitch_events(t.logs)


@register("backfill_identity", W_("ue") +
          ", owner AS (SELECT anonymous_id AS _anon, user_id AS _owner FROM ("
          "SELECT anonymous_id, user_id, row_number() OVER (PARTITION BY anonymous_id ORDER BY event_time_unix_nano, user_id) AS rn "
          "FROM ue WHERE event = 'identify' AND anonymous_id IS NOT NULL AND user_id IS NOT NULL) o WHERE rn = 1) "
          "SELECT event_time, event_time_unix_nano, subject, event, coalesce(user_id, _owner) AS user_id, anonymous_id, "
          "session_id, coalesce(user_id, _owner, anonymous_id) AS person_id, page, severity_text, service_name, attributes "
          "FROM ue LEFT JOIN owner ON ue.anonymous_id = owner._anon")
def _(t: Tables):
    return J.backfill_identity(t.ue).select(*USER_EVENT_COLUMNS)


@register("backfill_incremental", QUERIES["backfill_identity"][1])
def _(t: Tables):
    from telemetra.streaming import identity
    root = f"{_run_dir(t, 'backfill_incremental')}/people"
    late = F.dayofmonth("event_time")
    # the newest third of the month arrives first; sign-ins of the older thirds then change who owns a device
    for batch, part in enumerate([late > 20, (late > 10) & (late <= 20), late <= 10]):
        identity.add_arrival(t.ue.where(part), root, batch)
    return identity.read_events(t.spark, root)


@register("timeline_after_backfill", W_("ue") +
          ", owner AS (SELECT anonymous_id AS device, arg_min(user_id, (event_time_unix_nano, user_id)) AS person FROM ue "
          "WHERE event = 'identify' AND anonymous_id IS NOT NULL AND user_id IS NOT NULL GROUP BY 1), "
          "known AS (SELECT ue.*, coalesce(user_id, owner.person, anonymous_id) AS who FROM ue LEFT JOIN owner ON anonymous_id = device), "
          f"mine AS (SELECT * FROM known WHERE who = '{BACKFILLED}') "
          "SELECT event_time, event, page, severity_text, session_id, (SELECT count(*) FROM mine) AS total, "
          f"greatest((SELECT count(*) FROM mine) - {DEFAULT.timeline_cap}, 0) AS more FROM mine "
          f"ORDER BY event_time_unix_nano DESC, event, session_id, attributes LIMIT {DEFAULT.timeline_cap}")
def _(t: Tables):
    return R.user_timeline(J.backfill_identity(t.ue), BACKFILLED)


@register("client_backend_journey", W_("logs", "traces") +
          f"SELECT {_ANON} AS anonymous_id, time_unix_nano, 'client' AS source, body AS name, service_name, "
          "CAST(NULL AS VARCHAR) AS trace_id, severity_text AS status FROM logs UNION ALL "
          "SELECT json_extract_string(span_attributes, '$.\"anonymous.id\"'), start_time_unix_nano, 'backend', name, "
          "service_name, trace_id, CASE WHEN status_code = 2 THEN 'ERROR' ELSE 'OK' END FROM traces")
def _(t: Tables):
    return J.client_backend_journey(t.logs, t.traces)


_PERSONS = (
    f", event AS (SELECT {_ANON} AS device, {_UID} AS uid, time_unix_nano AS t, 'client' AS source, body AS name, service_name, "
    "trace_id, span_id, severity_text AS status FROM logs_t), "
    "owner AS (SELECT device, arg_min(uid, (t, uid)) AS person FROM event "
    "WHERE name = 'identify' AND device IS NOT NULL AND uid IS NOT NULL GROUP BY device), "
    "client AS (SELECT event.*, coalesce(uid, owner.person, device) AS who FROM event LEFT JOIN owner USING (device)), "
    "link AS (SELECT trace_id, arg_min(who, (t, who)) AS person FROM client WHERE trace_id IS NOT NULL AND who IS NOT NULL GROUP BY trace_id), "
    "span AS (SELECT json_extract_string(span_attributes, '$.\"anonymous.id\"') AS device, * FROM traces), "
    "everyone AS (SELECT device AS anonymous_id, t AS time_unix_nano, source, name, service_name, trace_id, span_id, status, who AS person_id FROM client "
    "UNION ALL SELECT device, start_time_unix_nano, 'backend', name, service_name, span.trace_id, span_id, "
    "CASE WHEN status_code = 2 THEN 'ERROR' ELSE 'OK' END, coalesce(link.person, owner.person, device) "
    "FROM span LEFT JOIN link ON span.trace_id = link.trace_id LEFT JOIN owner USING (device)) ")


@register("persons_journeys", W_("logs_t", "traces") + _PERSONS + "SELECT * FROM everyone")
def _(t: Tables):
    return J.person_journey(with_trace_context(t.logs), t.traces)


@register("person_journey", W_("logs_t", "traces") + _PERSONS + f"SELECT * FROM everyone WHERE person_id = '{BACKFILLED}'")
def _(t: Tables):
    return J.person_journey(with_trace_context(t.logs), t.traces, BACKFILLED)


# ---------------------------------------------------------------- product analytics

def _funnel_sql(steps: tuple[str, ...], days: float, by: str) -> str:
    w = int(days * 86_400 * 1_000_000_000)
    inlist = ", ".join(f"'{s}'" for s in steps)
    parts = [f", b AS (SELECT {by} AS p, event AS e, event_time_unix_nano AS t FROM ue "
             f"WHERE {by} IS NOT NULL AND event IN ({inlist})), "
             f"s1 AS (SELECT p, min(t) AS t1, min(t) AS tp FROM b WHERE e = '{steps[0]}' GROUP BY p)"]
    for k in range(2, len(steps) + 1):
        parts.append(f", s{k} AS (SELECT b.p, s.t1, min(b.t) AS tp FROM b JOIN s{k-1} s ON b.p = s.p "
                     f"WHERE b.e = '{steps[k-1]}' AND b.t >= s.tp AND b.t <= s.t1 + {w} GROUP BY b.p, s.t1)")
    sel = " UNION ALL ".join(
        f"SELECT CAST({k} AS INTEGER) AS step, '{steps[k-1]}' AS event, count(*) AS persons FROM s{k}"
        for k in range(1, len(steps) + 1)
    )
    return W_("ue") + "".join(parts) + " " + sel


@register("funnel_ordered", _funnel_sql(FUNNEL, FUNNEL_DAYS, "anonymous_id"))
def _(t: Tables):
    return W.funnel_ordered(t.ue, FUNNEL, FUNNEL_DAYS, by="anonymous_id")


@register("cohort_retention", W_("ue") +
          f", d AS (SELECT DISTINCT anonymous_id AS p, {_DAY} AS dd FROM ue WHERE anonymous_id IS NOT NULL) "
          ", c AS (SELECT p, dd, min(dd) OVER (PARTITION BY p) AS cohort_day FROM d) "
          "SELECT cohort_day, CAST(dd - cohort_day AS INTEGER) AS day_offset, count(*) AS persons FROM c GROUP BY 1, 2")
def _(t: Tables):
    return W.cohort_retention(t.ue, by="anonymous_id")


@register("cohort_retention_merged", QUERIES["cohort_retention"][1])
def _(t: Tables):
    # three arrivals, a late one among them; the bitmaps of each are stored and merged, the events aren't read again
    path, day = f"{_run_dir(t, 'cohort_retention_merged')}/days", F.dayofmonth("event_time")
    for rows in (day > 20, day <= 10, (day > 10) & (day <= 20)):
        W.active_days(t.ue.where(rows), by="anonymous_id").write.mode("append").parquet(path)
    days = t.spark.read.parquet(path)
    return W.retention_of_days(W.merge_days(days))


@register("user_paths", W_("ue") +
          "SELECT page, next_page, count(*) AS transitions FROM ("
          "SELECT page, lead(page) OVER (PARTITION BY session_id ORDER BY event_time_unix_nano, attributes) AS next_page "
          "FROM ue WHERE session_id IS NOT NULL AND page IS NOT NULL) x WHERE next_page IS NOT NULL GROUP BY 1, 2")
def _(t: Tables):
    return W.user_paths(t.ue)


# ---------------------------------------------------------------- history (H1-H5)

_LOG_COLS = "event_id, time_unix_nano, body, severity_text, service_name, log_attributes"


LOG_COLS = [c.strip() for c in _LOG_COLS.split(",")]


@register("snapshots", W_("commits") + "SELECT snapshot_id, snapshot_time FROM commits ORDER BY snapshot_id DESC LIMIT 10")
def _(t: Tables):
    return H.snapshots(t.commits)


_AT = f"TIMESTAMP '{AS_OF_AT.isoformat(sep=' ')}'"
_S = f"(SELECT max(snapshot_id) FROM commits WHERE snapshot_time <= {_AT})"


@register("as_of_count", W_("logs_v", "commits") +
          f"SELECT now, past, now - past AS new_since, {_S} AS snapshot_id, "
          "(SELECT min(snapshot_time) FROM commits) AS earliest FROM ("
          "SELECT count(*) FILTER (WHERE end_snapshot IS NULL) AS now, "
          f"CASE WHEN {_S} IS NOT NULL THEN count(*) FILTER (WHERE begin_snapshot <= {_S} AND (end_snapshot IS NULL OR end_snapshot > {_S})) END AS past "
          "FROM logs_v) c")
def _(t: Tables):
    return H.as_of_count(t.logs_v, t.commits, AS_OF_AT)


@register("as_of", W_("logs_v", "commits") +
          f"SELECT {_LOG_COLS} FROM logs_v WHERE begin_snapshot <= {_S} AND (end_snapshot IS NULL OR end_snapshot > {_S})")
def _(t: Tables):
    return H.as_of_time(t.logs_v, t.commits, AS_OF_AT).select(*LOG_COLS)


_CH = (f"FROM logs_v, (SELECT count(*) AS nc FROM commits) k, "
       f"(SELECT 'insert' AS change_type UNION ALL SELECT 'delete') ct WHERE k.nc >= 2 AND "
       f"((ct.change_type = 'insert' AND begin_snapshot BETWEEN {CHANGES[0]} AND {CHANGES[1]}) OR "
       f"(ct.change_type = 'delete' AND end_snapshot BETWEEN {CHANGES[0]} AND {CHANGES[1]}))")


@register("changes", W_("logs_v", "commits") + f"SELECT change_type, count(*) AS n {_CH} GROUP BY change_type")
def _(t: Tables):
    return H.changes(t.logs_v, t.commits, *CHANGES)


@register("table_changes", W_("logs_v", "commits") + f"SELECT {_LOG_COLS}, begin_snapshot, end_snapshot, change_type {_CH}")
def _(t: Tables):
    return H.table_changes(t.logs_v, t.commits, *CHANGES).select(*LOG_COLS, "begin_snapshot", "end_snapshot", "change_type")


# ---------------------------------------------------------------- upkeep (M2, M6)

def _preview_sql() -> str:
    cutoff = O.ns(DEFAULT.as_of - timedelta(days=RETENTION_DAYS))
    src = {"logs": "logs", "traces": "traces", "metrics_gauge": "gauge", "metrics_sum": "sums", "user_events": "ue"}
    return W_("ue", "traces", "gauge", "sums") + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) FILTER (WHERE {c} < {cutoff}) AS expired, count(*) AS total FROM {src[t]}"
        for t, c in M.RETENTION_TABLES
    )


@register("retention_preview", _preview_sql())
def _(t: Tables):
    plan = M.retention_plan(RETENTION_DAYS, DEFAULT.as_of)
    return M.retention_preview({k: v[0] for k, v in t.by_name().items()}, plan)


@register("table_sizes", W_("ue", "traces", "gauge", "sums") + " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n FROM {s}"
    for n, s in (("logs", "logs"), ("traces", "traces"), ("metrics_gauge", "gauge"), ("metrics_sum", "sums"), ("user_events", "ue"))))
def _(t: Tables):
    return M.table_sizes({k: v[0] for k, v in t.by_name().items()})


# ---------------------------------------------------------------- ingest

_PAYLOAD_LOG_SQL = (W_("logs_t") +
                    "SELECT time_unix_nano, body, severity_text, "
                    "CAST(CASE WHEN severity_text = 'ERROR' THEN 17 WHEN severity_text = 'INFO' THEN 9 ELSE 0 END AS INTEGER) AS severity_number, "
                    "service_name, log_attributes, trace_id, span_id, 'production' AS resource_attr_deployment_environment FROM logs_t")


@register("ingest_logs", _PAYLOAD_LOG_SQL)
def _(t: Tables):
    return otlp.ingest_logs(otlp.logs_payloads(with_trace_context(t.logs)))


@register("ingest_traces", W_("traces") +
          "SELECT trace_id, span_id, name, service_name, kind, start_time_unix_nano, end_time_unix_nano, "
          "duration_time_unix_nano, status_code, span_attributes FROM traces")
def _(t: Tables):
    return otlp.ingest_traces(otlp.traces_payloads(t.traces))


@register("ingest_gauge", W_("gauge") + "SELECT time_unix_nano, name, unit, double_value, service_name, metric_attributes FROM gauge")
def _(t: Tables):
    return otlp.ingest_gauge(otlp.metrics_payloads(t.gauge, "gauge"))


@register("ingest_sum", W_("sums") + "SELECT time_unix_nano, name, unit, double_value, service_name, metric_attributes FROM sums")
def _(t: Tables):
    return otlp.ingest_sum(otlp.metrics_payloads(t.sums, "sum"))


@register("promote_attrs", W_("logs") + "SELECT service_name, 'production' AS resource_attr_deployment_environment, count(*) AS n "
          "FROM logs GROUP BY 1, 2")
def _(t: Tables):
    flat = otlp.ingest_logs(otlp.logs_payloads(t.logs), promote=otlp.parse_promote_list("deployment.environment"))
    return flat.groupBy("service_name", "resource_attr_deployment_environment").agg(F.count(F.lit(1)).alias("n"))


@register("adhoc_sql", W_("ue") + "SELECT subject, event, count(*) AS n FROM ue WHERE severity_text = 'INFO' GROUP BY subject, event")
def _(t: Tables):
    t.ue.createOrReplaceTempView("user_events")
    return t.spark.sql("SELECT subject, event, count(*) AS n FROM user_events WHERE severity_text = 'INFO' GROUP BY subject, event")


# ---------------------------------------------------------------- jobs run end to end
# These build their input from the tables, run the storage / streaming job in a
# fresh folder under the shared job folder and return what the job produced.

def _run_dir(t: Tables, job: str) -> str:
    """A fresh folder for one run of ``job`` under the shared job folder.

    Nothing of an earlier run is removed: its result may still be read. Old runs
    are for whoever owns the shared folder to clear.
    """
    import uuid

    from telemetra.plans.storage import job_path
    return job_path(t.spark, "telemetra", "runs", job, uuid.uuid4().hex)


def _land_requests(t: Tables, logs: DataFrame, folder: str) -> None:
    otlp.logs_payloads(logs).write.mode("overwrite").text(folder)


def _stream(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


@register("ingest_stream", _PAYLOAD_LOG_SQL)
def _(t: Tables):
    from telemetra.streaming import curation, ingest
    run = _run_dir(t, "ingest_stream")
    _land_requests(t, with_trace_context(t.logs), f"{run}/landing/a")
    _stream(ingest.start_ingest(t.spark, f"{run}/landing/*", f"{run}/raw", checkpoint=f"{run}/ck_ingest"))
    raw = curation.read_table(t.spark, f"{run}/raw", curation.raw_schema())
    return raw.drop("event_date")


# every fifth request of 50 events arrives cut in half, every seventh as another signal's
_REQUEST = "CAST(event_id // 50 AS BIGINT)"


@register("ingest_rejected", W_("logs") +
          f", r AS (SELECT {_REQUEST} AS req, service_name, count(*) AS n, CASE WHEN {_REQUEST} % 5 = 0 THEN 'malformed' "
          f"WHEN {_REQUEST} % 7 = 0 THEN 'no_resourceLogs' ELSE 'landed' END AS cause FROM logs GROUP BY 1, 2, 4) "
          "SELECT cause, count(*) AS requests, CAST(CASE WHEN cause = 'landed' THEN sum(n) ELSE 0 END AS BIGINT) AS records "
          "FROM r GROUP BY cause")
def _(t: Tables):
    from telemetra.streaming import curation, ingest
    run = _run_dir(t, "ingest_rejected")
    req = F.floor(F.col("event_id") / 50)
    cut, other = req % 5 == 0, req % 7 == 0
    whole = otlp.logs_payloads(t.logs.where(~cut & ~other))
    half = otlp.logs_payloads(t.logs.where(cut)).select(F.expr("substring(payload, 1, length(payload) div 2)").alias("payload"))
    strange = otlp.logs_payloads(t.logs.where(~cut & other)).select(
        F.replace("payload", F.lit("resourceLogs"), F.lit("resourceSpans")).alias("payload"))
    requests = whole.unionByName(half).unionByName(strange)
    requests.write.mode("overwrite").text(f"{run}/landing/a")
    _stream(ingest.start_ingest(t.spark, f"{run}/landing/*", f"{run}/raw", checkpoint=f"{run}/ck"))
    bad = ingest.read_rejected(t.spark, f"{run}/raw").groupBy("cause").agg(
        F.count(F.lit(1)).alias("requests"), F.lit(0).cast("long").alias("records"))
    sent = t.spark.read.text(f"{run}/landing/a").agg(F.count(F.lit(1)).alias("sent"))
    lost = bad.agg(F.coalesce(F.sum("requests"), F.lit(0)).alias("lost"))
    landed = curation.read_table(t.spark, f"{run}/raw", curation.raw_schema()).agg(F.count(F.lit(1)).alias("records"))
    ok = landed.select(F.lit("landed").alias("cause"),
                       (sent.select("sent").scalar() - lost.select("lost").scalar()).alias("requests"), "records")
    return ok.unionByName(bad)


@register("curate_incremental", W_("ue") + f"SELECT {UE_COLS} FROM ue")
def _(t: Tables):
    from telemetra.streaming import curation, ingest
    run = _run_dir(t, "curate_incremental")
    # the newer half of the month arrives first, the older half late (after newer rows were curated)
    newer = F.col("time_unix_nano") >= F.lit(ns_of(LATE_BEFORE))
    early = t.logs.where(newer)
    late = t.logs.where(~newer)
    for part, rows in (("a", early), ("b", late)):
        _land_requests(t, rows, f"{run}/landing/{part}")
        _stream(ingest.start_ingest(t.spark, f"{run}/landing/*", f"{run}/raw", checkpoint=f"{run}/ck_ingest"))
        _stream(curation.start_curation(t.spark, f"{run}/raw", f"{run}/ue", checkpoint=f"{run}/ck_curate",
                                        settings=t.settings))
    return curation.curated_view(t.spark, f"{run}/ue").select(*USER_EVENT_COLUMNS)


@register("rebuild_curated", W_("ue") + f"SELECT {UE_COLS} FROM ue")
def _(t: Tables):
    from telemetra.operators.curate import curate
    from telemetra.streaming import curation, ingest
    from telemetra.streaming.sinks import publish_batch
    run = _run_dir(t, "rebuild_curated")
    raw, ue, ck = f"{run}/raw", f"{run}/ue", f"{run}/ck_curate"
    flat = otlp.ingest_logs(otlp.logs_payloads(t.logs))  # the raw table as the ingest stream publishes it
    publish_batch(flat, raw, 0, lambda d, p: ingest.write_raw_batch(d, p, "time_unix_nano", ("body", "time_unix_nano")))
    # an older release curated the raw table without ``subject`` and checkpointed its progress
    stale = t.spark.readStream.schema(curation.raw_schema().add("batch", "string")).parquet(f"{raw}/hot")

    def old_sink(batch: DataFrame, batch_id: int) -> None:
        publish_batch(batch, ue, batch_id, lambda d, p: curate(d).drop("subject").write.mode("overwrite").parquet(p))

    _stream(stale.writeStream.foreachBatch(old_sink).option("checkpointLocation", ck)
            .trigger(availableNow=True).start())
    if not curation.ensure_curated(t.spark, ue, ck):  # C6: detect, drop table and progress
        raise RuntimeError("stale curated table was not detected")
    _stream(curation.start_curation(t.spark, raw, ue, checkpoint=ck, settings=t.settings))
    return curation.curated_view(t.spark, ue).select(*USER_EVENT_COLUMNS)


def _sweep_sql() -> str:
    cutoff = O.ns(DEFAULT.as_of - timedelta(days=RETENTION_DAYS))
    return W_("ue") + " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) FILTER (WHERE {c} < {cutoff}) AS deleted, "
        f"count(*) FILTER (WHERE {c} >= {cutoff} OR {c} IS NULL) AS remaining FROM {src}"
        for n, c, src in (("logs", "time_unix_nano", "logs"), ("user_events", "event_time_unix_nano", "ue")))


@register("retention_sweep", _sweep_sql())
def _(t: Tables):
    from telemetra.plans import layout
    from telemetra.plans.maintenance import retention_sweep
    run = _run_dir(t, "retention_sweep")
    layout.write_raw_logs(t.logs.drop("event_date"), f"{run}/logs")
    layout.write_curated(t.ue_columns, f"{run}/user_events", t.settings.buckets, day_level=False)
    tables = {
        "logs": (f"{run}/logs", layout.RAW_LOGS_STORED, ["event_date"], list(layout.RAW_LOGS_SORT)),
        "user_events": (f"{run}/user_events", layout.CURATED_STORED, ["subject", "person_bucket"], list(layout.CURATED_SORT)),
    }
    plan = M.retention_plan(RETENTION_DAYS, DEFAULT.as_of, (("logs", "time_unix_nano"), ("user_events", "event_time_unix_nano")))
    deleted = retention_sweep(t.spark, tables, plan)
    left = [
        layout.read_raw_logs(t.spark, f"{run}/logs").agg(
            F.lit("logs").alias("table_name"), F.lit(deleted.get("logs", 0)).cast("long").alias("deleted"),
            F.count(F.lit(1)).alias("remaining")),
        layout.read_curated(t.spark, f"{run}/user_events").agg(
            F.lit("user_events").alias("table_name"), F.lit(deleted.get("user_events", 0)).cast("long").alias("deleted"),
            F.count(F.lit(1)).alias("remaining")),
    ]
    return left[0].unionByName(left[1])


_SIGNALS = (("traces", "start_time_unix_nano", "traces"), ("metrics_gauge", "time_unix_nano", "gauge"),
            ("metrics_sum", "time_unix_nano", "sums"))


def _sweep_signals_sql() -> str:
    cutoff = O.ns(DEFAULT.as_of - timedelta(days=RETENTION_DAYS))
    return W_("traces", "gauge", "sums") + " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) FILTER (WHERE {c} < {cutoff}) AS deleted, "
        f"count(*) FILTER (WHERE {c} >= {cutoff} OR {c} IS NULL) AS remaining FROM {src}"
        for n, c, src in _SIGNALS)


@register("retention_sweep_signals", _sweep_signals_sql())
def _(t: Tables):
    # the tables of the plan that retention_sweep leaves out
    from telemetra.plans import layout
    from telemetra.plans.maintenance import retention_sweep
    run = _run_dir(t, "retention_sweep_signals")
    tables, reads = {}, {}
    for name, _, source in _SIGNALS:
        spans = name == "traces"
        write, reads[name] = ((layout.write_traces, layout.read_traces) if spans
                              else (layout.write_metrics, layout.read_metrics))
        write(getattr(t, source).drop("event_date"), f"{run}/{name}")
        tables[name] = (f"{run}/{name}", layout.TRACES_STORED if spans else layout.METRICS_STORED, ["event_date"],
                        list(layout.TRACES_SORT if spans else layout.METRICS_SORT))
    deleted = retention_sweep(t.spark, tables, M.retention_plan(RETENTION_DAYS, DEFAULT.as_of))
    left = [reads[name](t.spark, f"{run}/{name}").agg(
        F.lit(name).alias("table_name"), F.lit(deleted.get(name, 0)).cast("long").alias("deleted"),
        F.count(F.lit(1)).alias("remaining")) for name, _, _ in _SIGNALS]
    return left[0].unionByName(left[1]).unionByName(left[2])


@register("retention_sweep_streamed", W_("ue") + " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) FILTER (WHERE {c} < {O.ns(DEFAULT.as_of - timedelta(days=RETENTION_DAYS))}) AS deleted, "
    f"0 AS waiting, count(*) FILTER (WHERE {c} >= {O.ns(DEFAULT.as_of - timedelta(days=RETENTION_DAYS))} OR {c} IS NULL) AS remaining FROM {src}"
    for n, c, src in (("logs", "time_unix_nano", "logs"), ("user_events", "event_time_unix_nano", "ue"))))
def _(t: Tables):
    from telemetra.plans import layout
    from telemetra.streaming import curation, ingest, upkeep
    run = _run_dir(t, "retention_sweep_streamed")
    raw, ue = f"{run}/raw", f"{run}/ue"
    # older events, then newer ones, then nothing due: the last batch of a stream can't leave ``hot`` yet
    day = F.dayofmonth(ns_to_timestamp("time_unix_nano"))
    for name, rows in (("a", day <= 12), ("b", (day > 12) & (day <= 24)), ("c", day > 24)):
        _land_requests(t, t.logs.where(rows), f"{run}/landing/{name}")
        _stream(ingest.start_ingest(t.spark, f"{run}/landing/*", raw, checkpoint=f"{run}/ck_ingest"))
        _stream(curation.start_curation(t.spark, raw, ue, checkpoint=f"{run}/ck_curate", settings=t.settings))
    tables = {
        "logs": (raw, curation.raw_schema(), ["event_date"], list(layout.RAW_LOGS_SORT), upkeep.curated_batches(t.spark, raw, ue)),
        "user_events": (ue, curation.CURATED_PARTS, ["subject", "person_bucket"], list(layout.CURATED_SORT), None),
    }
    plan = M.retention_plan(RETENTION_DAYS, DEFAULT.as_of, (("logs", "time_unix_nano"), ("user_events", "event_time_unix_nano")))
    return upkeep.sweep_streamed(t.spark, tables, plan)


SWEEP_AT = datetime(2024, 2, 1, 8)  # time of the commit a versioned retention sweep adds


@register("retention_sweep_versioned", W_("logs_v", "commits") +
          f"SELECT {_LOG_COLS}, begin_snapshot, CASE WHEN end_snapshot IS NULL AND time_unix_nano < "
          f"{O.ns(DEFAULT.as_of - timedelta(days=RETENTION_DAYS))} THEN (SELECT max(snapshot_id) + 1 FROM commits) "
          "ELSE end_snapshot END AS end_snapshot FROM logs_v")
def _(t: Tables):
    from telemetra.plans import layout
    from telemetra.plans.maintenance import retention_sweep_versioned
    run = _run_dir(t, "retention_sweep_versioned")
    root, croot = f"{run}/logs_v", f"{run}/commits"
    layout.write_raw_logs(t.logs_v.drop("event_date"), root)
    layout.write_commits(t.commits, croot)
    cutoff = ns_of(DEFAULT.as_of - timedelta(days=RETENTION_DAYS))
    retention_sweep_versioned(t.spark, root, layout.VERSIONED_LOGS_STORED, ["event_date"], "time_unix_nano", cutoff,
                              croot, SWEEP_AT, list(layout.RAW_LOGS_SORT))
    return layout.read_versioned_logs(t.spark, root).select(*LOG_COLS, "begin_snapshot", "end_snapshot")


@register("compact", W_("logs") + "SELECT event_id, time_unix_nano, body, severity_text, log_attributes FROM logs")
def _(t: Tables):
    from telemetra.plans import layout
    from telemetra.plans.maintenance import compact
    run = _run_dir(t, "compact")
    logs = t.logs.drop("event_date")
    block = F.floor(F.hour(ns_to_timestamp("time_unix_nano")) / 6)
    for i in range(4):  # four appends a day (one per six-hour block) leave several small files per day
        layout.write_raw_logs(logs.where(block == i), f"{run}/logs", mode="append")
    compact(t.spark, f"{run}/logs", layout.RAW_LOGS_STORED, ["event_date"], list(layout.RAW_LOGS_SORT))
    return layout.read_raw_logs(t.spark, f"{run}/logs").select(
        "event_id", "time_unix_nano", "body", "severity_text", "log_attributes")


_EXPIRE_SQL = (W_("logs_v", "commits") +
               f"SELECT {_LOG_COLS}, begin_snapshot, end_snapshot FROM logs_v "
               "WHERE end_snapshot IS NULL OR end_snapshot > (SELECT max(snapshot_id) FROM commits)")


@register("expire_preview", _EXPIRE_SQL)
def _(t: Tables):
    horizon = t.commits.select(F.max("snapshot_id")).scalar()
    return H.expire(t.logs_v, horizon).select(*LOG_COLS, "begin_snapshot", "end_snapshot")


@register("expire_history", _EXPIRE_SQL)
def _(t: Tables):
    from telemetra.plans import layout
    from telemetra.plans.maintenance import expire_history
    run = _run_dir(t, "expire_history")
    root = f"{run}/logs_v"
    layout.write_raw_logs(t.logs_v.drop("event_date"), root)  # day partitions, sorted like the raw table
    layout.write_commits(t.commits, f"{run}/commits")
    horizon = t.commits.agg(F.max("snapshot_id")).first()[0]  # one scalar: the job's parameter
    expire_history(t.spark, root, layout.VERSIONED_LOGS_STORED, ["event_date"], horizon, list(layout.RAW_LOGS_SORT),
                   commits_root=f"{run}/commits")
    return layout.read_versioned_logs(t.spark, root).select(*LOG_COLS, "begin_snapshot", "end_snapshot")


def queries() -> dict[str, Build]:
    return {k: v[0] for k, v in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in QUERIES.items() if v[1] is not None}


__all__ = ["QUERIES", "queries", "oracle_sql", "ns_to_timestamp"]
