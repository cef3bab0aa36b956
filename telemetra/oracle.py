"""Independent DuckDB SQL for every registered query (the correctness oracle).

The fixture tables are built from ``events`` with the same rules as
``telemetra.sources.fixtures`` but written in DuckDB SQL, so the comparison
checks our Spark expressions against a second engine end to end.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from telemetra.settings import DEFAULT

SUBJ = DEFAULT.subject_attr
AS_OF = DEFAULT.as_of


def _ts(d: datetime) -> str:
    return f"TIMESTAMP '{d.isoformat(sep=' ')}'"


def _j(col: str, key: str) -> str:
    return f"json_extract_string({col}, '$.\"{key}\"')"


_T = "epoch_us(ts) * 1000 + event_id % 1000"
_SVC = "CASE WHEN event_id % 2 = 0 THEN 'web' ELSE 'ios' END"
_DEV = "'d' || CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 2 AS VARCHAR)"

CTES: dict[str, str] = {}

CTES["logs"] = f"""
SELECT event_id, {_T} AS time_unix_nano,
 CASE WHEN event_type='view' THEN 'page_view'
      WHEN event_type='error' THEN 'exception'
      WHEN event_type='purchase' THEN 'purchase'
      WHEN event_type='signup' AND event_id % 3 = 0 THEN 'signup_start'
      WHEN event_type='signup' AND event_id % 3 = 1 THEN 'signup_complete'
      WHEN event_type='signup' THEN 'identify'
      WHEN event_id % 4 = 0 THEN 'ai_request'
      ELSE 'add_to_cart' END AS body,
 CASE WHEN event_type='error' AND event_id % 5 <> 0 THEN 'ERROR'
      WHEN event_id % 211 = 0 THEN NULL ELSE 'INFO' END AS severity_text,
 {_SVC} AS service_name,
 concat('{{"event.name":"', event_type, '"',
   CASE WHEN event_id % 101 = 0 THEN '' ELSE concat(',"anonymous.id":"d', CAST(user_id AS VARCHAR), '-', CAST(event_id % 2 AS VARCHAR), '"') END,
   ',"session.id":"s', CAST(user_id AS VARCHAR), '-', CAST(event_id % 7 AS VARCHAR), '"',
   CASE WHEN event_type='signup' AND event_id % 3 = 2 THEN concat(',"user.id":"', substr(sha256(concat('{DEFAULT.salt}','user',CAST(user_id AS VARCHAR))),1,32), '"') ELSE '' END,
   ',"page":"/p', CAST(event_id % 5 AS VARCHAR), '"',
   CASE WHEN event_type='error' THEN ',"exception.type":"TypeError","exception.message":"boom"' ELSE '' END,
   CASE WHEN event_type='click' AND event_id % 4 = 0 THEN concat(
     ',"gen_ai.system":"sys', CAST(event_id % 3 AS VARCHAR), '","gen_ai.request.model":"m', CAST(event_id % 3 AS VARCHAR),
     '","gen_ai.usage.input_tokens":"', CAST(50 + event_id % 1950 AS VARCHAR),
     '","gen_ai.usage.output_tokens":"', CAST(20 + event_id % 1480 AS VARCHAR), '"') ELSE '' END,
   CASE WHEN event_id % 83 = 0 THEN ',"audit.action":"login"' ELSE '' END,
   CASE WHEN event_id % 97 = 0 THEN ',"{SUBJ}":"billing"'
        WHEN event_id % 89 = 0 THEN ',"{SUBJ}":"errors"' ELSE '' END,
   '}}') AS log_attributes
FROM events"""

def _attr(key: str) -> str:
    return f"attr['{key}']"


# The subject rules as a table: each that applies gives (priority, subject), the lowest wins.
_SUBJECTS = ("errors", "activities", "ai_usage", "traceability")
_HAS = {1: ("errors", ["exception.type"]), 2: ("ai_usage", ["gen_ai.system", "gen_ai.request.model", "llm.model"]),
        3: ("traceability", ["audit.action"])}
_RULES = [(p, s, f"{_attr(k)} IS NOT NULL") for p, (s, keys) in _HAS.items() for k in keys]
_RULES += [(1, "errors", "severity_text = 'ERROR'"), (3, "traceability", "body = 'identify'"), (4, "activities", "true")]


def _rule(priority: int, subject: str, applies: str) -> str:
    return f"CASE WHEN {applies} THEN struct_pack(p := {priority}, s := '{subject}') END"


# an override names its subject outright, or 'other' when it is none of the known ones
_OVERRIDE = (f"CASE WHEN {_attr(SUBJ)} IS NOT NULL THEN struct_pack(p := 0, s := "
             f"coalesce(list_extract(list_filter({list(_SUBJECTS)}, lambda x: x = {_attr(SUBJ)}), 1), 'other')) END")

CTES["ue"] = f"""
SELECT make_timestamp(CAST(time_unix_nano / 1000 AS BIGINT)) AS event_time, time_unix_nano AS event_time_unix_nano,
  list_min(list_filter([{_OVERRIDE}, {", ".join(_rule(*r) for r in _RULES)}], lambda r: r IS NOT NULL)).s AS subject,
  body AS event, {_attr("user.id")} AS user_id, {_attr("anonymous.id")} AS anonymous_id, {_attr("session.id")} AS session_id,
  ifnull({_attr("user.id")}, {_attr("anonymous.id")}) AS person_id, {_attr("page")} AS page,
  severity_text, service_name, log_attributes AS attributes
FROM (SELECT *, CAST(CAST(log_attributes AS JSON) AS MAP(VARCHAR, VARCHAR)) AS attr FROM logs)"""

CTES["traces"] = f"""
SELECT 't' || CAST(CAST(floor(event_id / 4) AS BIGINT) AS VARCHAR) AS trace_id,
  's' || CAST(event_id AS VARCHAR) AS span_id,
  CASE event_type WHEN 'view' THEN 'page_load' WHEN 'click' THEN 'api_call' ELSE 'route_change' END AS name,
  {_SVC} AS service_name,
  CAST(1 AS INTEGER) AS kind,
  t AS start_time_unix_nano, t + d AS end_time_unix_nano, d AS duration_time_unix_nano,
  CAST(CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS INTEGER) AS status_code,
  '{{"http.route":"/r' || CAST(user_id % 5 AS VARCHAR) || '","outcome":"' ||
    CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END ||
    '","anonymous.id":"' || {_DEV} || '"}}' AS span_attributes
FROM (SELECT *, {_T} AS t, CAST(round(value * 1e6) AS BIGINT) AS d
      FROM events WHERE event_type IN ('view', 'click', 'error')) e"""

_POINT = f"""{_T} AS time_unix_nano, {{name}} AS name, '{{unit}}' AS unit, value AS double_value,
  {_SVC} AS service_name, '{{{{"page":"/p' || CAST(event_id % 5 AS VARCHAR) || '"}}}}' AS metric_attributes"""

CTES["logs_t"] = """
SELECT *, CASE WHEN named THEN 't' || CAST(event_id // 4 AS VARCHAR) END AS trace_id,
  CASE WHEN named THEN 's' || CAST(event_id AS VARCHAR) END AS span_id
FROM (SELECT *, body IN ('page_view', 'exception', 'ai_request', 'add_to_cart') AND event_id % 2 = 0 AS named FROM logs)"""

CTES["gauge"] = "SELECT " + _POINT.format(
    name="CASE WHEN event_type = 'view' THEN 'web_vitals_lcp_ms' ELSE 'web_vitals_inp_ms' END", unit="ms"
) + " FROM events WHERE event_type IN ('view', 'click')"

CTES["sums"] = "SELECT " + _POINT.format(name="'purchases_total'", unit="1") + " FROM events WHERE event_type = 'purchase'"

CTES["versions"] = """
SELECT event_id,
  CAST(floor((day(ts) - 1) / 6) + 1 AS BIGINT) + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS begin_snapshot,
  CASE WHEN day(ts) <= 2 THEN CAST(7 AS BIGINT) END AS end_snapshot
FROM events"""

CTES["logs_v"] = "SELECT l.*, v.begin_snapshot, v.end_snapshot FROM logs l JOIN versions v USING (event_id)"

CTES["commits"] = """
SELECT snapshot_id, TIMESTAMP '2024-02-01 00:00:00' + to_hours(snapshot_id) AS snapshot_time
FROM (SELECT DISTINCT s AS snapshot_id FROM (
  SELECT begin_snapshot AS s FROM versions UNION ALL SELECT end_snapshot FROM versions) WHERE s IS NOT NULL) c"""

DEPS = {
    "logs": [], "logs_t": ["logs"], "ue": ["logs"], "traces": [], "gauge": [], "sums": [], "versions": [],
    "logs_v": ["logs", "versions"], "commits": ["versions"],
}


def with_(*names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n"


def since(days: int) -> str:
    return f"event_time > {_ts(AS_OF - timedelta(days=days))}"


def ns(d: datetime) -> int:
    delta = d - datetime(1970, 1, 1)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000_000 + delta.microseconds * 1_000
