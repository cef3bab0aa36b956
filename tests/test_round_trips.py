"""Every OTLP value form, and streams that must not lose rows: old files, a second feed, a fresh checkpoint."""

import json
import os
import time

from pyspark.sql import functions as F

from telemetra.operators import reports as R
from telemetra.sources import otlp
from telemetra.streaming.ingest import start_ingest


def request(records, scope="scopeLogs", items="logRecords", top="resourceLogs"):
    return json.dumps({top: [{"resource": {"attributes": []}, scope: [{items: records}]}]})


def test_every_log_value_form(spark):
    bodies = [{"stringValue": "s"}, {"intValue": "7"}, {"doubleValue": 1.5}, {"boolValue": True},
              {"arrayValue": {"values": [{"stringValue": "a"}]}}, {"kvlistValue": {"values": [{"key": "k", "value": {"intValue": "1"}}]}},
              {"bytesValue": "AAE="}]
    attrs = [{"value": {"stringValue": "no key"}}, {"key": "list", "value": {"arrayValue": {"values": [{"intValue": "2"}]}}},
             {"key": "raw", "value": {"bytesValue": "AAE="}}, {"key": "list", "value": {"stringValue": "last"}}]
    payload = request([{"timeUnixNano": str(i), "body": b, "attributes": attrs} for i, b in enumerate(bodies)])
    rows = otlp.ingest_logs(spark.createDataFrame([(payload,)], "payload string")).orderBy("time_unix_nano").collect()
    assert [r.body for r in rows[:4]] == ["s", "7", "1.5", "true"]
    assert json.loads(rows[4].body) == bodies[4]["arrayValue"] and json.loads(rows[5].body) == bodies[5]["kvlistValue"]
    assert rows[6].body == "AAE=" and json.loads(rows[0].log_attributes) == {"raw": "AAE=", "list": "last"}


def test_integer_points(spark):
    metric = {"name": "n", "sum": {"dataPoints": [{"timeUnixNano": "1", "asInt": "41"}, {"timeUnixNano": "2", "asDouble": 0.5}]}}
    payload = request([metric], "scopeMetrics", "metrics", "resourceMetrics")
    got = otlp.ingest_sum(spark.createDataFrame([(payload,)], "payload string")).orderBy("time_unix_nano").collect()
    assert [r.double_value for r in got] == [41.0, 0.5]


def land(folder, name, first, n, age_days=0):
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}"
    with open(path, "w") as f:
        f.write(request([{"timeUnixNano": str(first + i), "body": {"stringValue": "page_view"}, "severityText": "ERROR"} for i in range(n)]) + "\n")
    old = time.time() - age_days * 86400
    os.utime(path, (old, old))


def test_streams_lose_no_rows(spark, tmp_root):
    raw, inbox, other = f"{tmp_root}/raw", f"{tmp_root}/in", f"{tmp_root}/other"

    def run(source, checkpoint):
        start_ingest(spark, source, raw, checkpoint=f"{tmp_root}/{checkpoint}").awaitTermination()
        return spark.read.option("recursiveFileLookup", "true").parquet(f"{raw}/hot").count()

    land(inbox, "a.json", 0, 5)
    assert run(inbox, "c1") == 5
    land(inbox, "b.json", 100, 5, age_days=40)          # older than the newest file by far
    assert run(inbox, "c1") == 10 and run(inbox, "c1") == 10
    land(other, "c.json", 200, 5)
    assert run(other, "c2") == 15                        # a second feed, counting batches from 0 again
    land(f"{tmp_root}/in2", "d.json", 300, 5)
    assert run(f"{tmp_root}/in2", "c3") == 20
    logs = spark.read.parquet(f"{raw}/hot")
    assert R.recent_errors(logs, 3).count() == 3 and R.recent_events(logs).count() == 5 and R.sample(logs).count() == 1


def test_backfilled_rows_are_found_in_their_new_bucket(spark):
    from telemetra.operators.identity import backfill_identity
    from telemetra.plans.layout import bucket_of
    from telemetra.tables import Tables

    ue = Tables(spark, "/root/testdata/sf0.001", land=False).ue
    for buckets in (16, 64):
        laid = ue.drop("person_bucket").withColumn("person_bucket", bucket_of(F.col("person_id"), buckets))
        filled = backfill_identity(laid, buckets)
        busiest = filled.groupBy("person_id").count().orderBy(F.desc("count"), "person_id").first()
        assert R.user_timeline(filled, busiest.person_id, buckets=buckets).first().total == busiest["count"]
