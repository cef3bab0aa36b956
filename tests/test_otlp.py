"""OTLP payload parsing: nesting, attribute values, duplicate keys, promotion."""

import json

from telemetra.sources import otlp


def payload(records, resource=None):
    res = {"attributes": resource or [{"key": "service.name", "value": {"stringValue": "svc"}},
                                      {"key": "deployment.environment", "value": {"stringValue": "prod"}}]}
    return json.dumps({"resourceLogs": [{"resource": res, "scopeLogs": [{"scope": {"name": "s"}, "logRecords": records}]}]})


def test_flatten_values_and_duplicates(spark):
    rec = {
        "timeUnixNano": "1700000000123456789", "severityNumber": 17, "severityText": "ERROR",
        "body": {"stringValue": "exception"},
        "attributes": [
            {"key": "user.id", "value": {"stringValue": "u1"}},
            {"key": "n", "value": {"intValue": "42"}},
            {"key": "f", "value": {"doubleValue": 1.5}},
            {"key": "b", "value": {"boolValue": True}},
            {"key": "user.id", "value": {"stringValue": "u2"}},
        ],
    }
    df = spark.createDataFrame([(payload([rec, dict(rec, attributes=[])]),)], "payload string")
    rows = otlp.ingest_logs(df).collect()
    assert len(rows) == 2
    r = rows[0]
    assert r.time_unix_nano == 1700000000123456789 and r.body == "exception" and r.severity_number == 17
    assert r.service_name == "svc" and r.resource_attr_deployment_environment == "prod"
    assert json.loads(r.log_attributes) == {"user.id": "u2", "n": "42", "f": "1.5", "b": "true"}
    assert rows[1].log_attributes == "{}"


def test_promote_list_parsing():
    assert otlp.parse_promote_list("") == ()
    assert otlp.parse_promote_list(" deployment.environment, host.name ,") == ("deployment.environment", "host.name")


def test_traces_and_metrics(spark):
    spans = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "api"}}]},
             "scopeSpans": [{"scope": {"name": "s"}, "spans": [
                 {"traceId": "t", "spanId": "s1", "name": "GET", "kind": 2, "startTimeUnixNano": "100",
                  "endTimeUnixNano": "350", "status": {"code": 2}, "attributes": []},
                 {"traceId": "t", "spanId": "s2", "name": "GET", "kind": 2, "startTimeUnixNano": "100",
                  "endTimeUnixNano": "150", "attributes": []}]}]}]}
    t = otlp.ingest_traces(spark.createDataFrame([(json.dumps(spans),)], "payload string")).orderBy("span_id").collect()
    assert [(r.duration_time_unix_nano, r.status_code, r.service_name) for r in t] == [(250, 2, "api"), (50, 0, "api")]
    m = {"resourceMetrics": [{"resource": {"attributes": []}, "scopeMetrics": [{"scope": {"name": "s"}, "metrics": [
        {"name": "g", "unit": "ms", "gauge": {"dataPoints": [{"timeUnixNano": "5", "asDouble": 2.5, "attributes": []}]}},
        {"name": "c", "unit": "1", "sum": {"dataPoints": [{"timeUnixNano": "6", "asDouble": 3.0, "attributes": []}]}}]}]}]}
    df = spark.createDataFrame([(json.dumps(m),)], "payload string")
    assert [(r.name, r.double_value) for r in otlp.ingest_gauge(df).collect()] == [("g", 2.5)]
    assert [(r.name, r.double_value) for r in otlp.ingest_sum(df).collect()] == [("c", 3.0)]


def test_malformed_time_is_null_not_a_failure(spark):
    from telemetra.operators.curate import curate

    good = {"timeUnixNano": "1700000000123456789", "body": {"stringValue": "page_view"}, "attributes": []}
    bad = dict(good, timeUnixNano="17e9x")
    df = spark.createDataFrame([(payload([good, bad]),)], "payload string")
    rows = sorted(curate(otlp.ingest_logs(df)).collect(), key=lambda r: r.event_time_unix_nano is None)
    assert [r.event_time_unix_nano for r in rows] == [1700000000123456789, None]
    assert rows[1].event_time is None and rows[1].subject == "activities"


def _odd(top, scopes, items, records):
    def request(*lists):
        return {top: [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "svc"}}]}, scopes: [{items: x} for x in lists]}]}

    whole = request(records, records[:1], [], None, [None])
    return [json.dumps(r) for r in (whole, request(), {top: []}, {top: [None]}, {top: [{}]}, {top: [{scopes: [None]}]}, {top: "text"}, {top: 3},
                                    {"other": []}, [1, 2], {})] + ["", "   ", None, json.dumps(whole)[:90], "null", json.dumps(whole)]


def test_one_parse_gives_the_records_and_the_rejected(spark):
    twice = [{"key": k, "value": {"stringValue": v}} for k, v in (("a", "1"), (None, "2"), ("b", "3"), ("a", "4"), (None, "5"))]
    record = {"timeUnixNano": "5", "startTimeUnixNano": "5", "endTimeUnixNano": "7", "body": {"stringValue": "x"}, "attributes": twice}
    lists = [dict(record, attributes=a) for a in (twice, twice[:2], twice[:1], [], None, [None], [twice[0], None])] + [{}]
    metric = [{"name": "m", "unit": "1", k: {"dataPoints": p}} for k in ("gauge", "sum") for p in (lists, [], None, [None])]
    for kind, read, scopes, items, records in (("logs", otlp.ingest_logs, "scopeLogs", "logRecords", lists), ("traces", otlp.ingest_traces, "scopeSpans", "spans", lists),
                                               ("gauge", otlp.ingest_gauge, "scopeMetrics", "metrics", metric), ("sum", otlp.ingest_sum, "scopeMetrics", "metrics", metric)):
        df = spark.createDataFrame([(p,) for p in _odd(otlp.SIGNALS[kind][1], scopes, items, records)], "payload string")
        both = otlp.read_requests(df, kind, ("service.name",))
        assert both._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
        bad = both.where("cause is not null").select("payload", "cause")
        rows = both.where("cause is null").drop("payload", "cause")
        want = read(df, promote=("service.name",))
        assert rows.columns == want.columns
        assert sorted(map(str, rows.collect())) == sorted(map(str, want.collect())) != []
        assert sorted(map(str, bad.collect())) == sorted(map(str, otlp.rejected(df, kind).collect())) != []


def test_attributes_keep_the_last_value_of_a_key(spark):
    kv = "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,arrayValue:string,kvlistValue:string,bytesValue:string>>>"
    lists = {"[]": "{}", '[{"key":"a","value":{"stringValue":"1"}},{"value":{"stringValue":"2"}}]': '{"a":"1"}',
             '[{"key":"a","value":{"stringValue":"1"}},{"key":"b"},{"key":"a","value":{"intValue":"2"}}]': '{"a":"2"}', "[{},{}]": "{}"}
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(k, v) for k, v in lists.items()], "kvs string, want string")
    for r in df.select("want", otlp.kv_to_json(F.from_json("kvs", kv)).alias("got")).collect():
        assert {k: v for k, v in json.loads(r.got).items() if v is not None} == json.loads(r.want)
