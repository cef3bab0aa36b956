"""Streaming ingest + incremental curation: no gaps, no duplicates, late rows kept."""

import os

import pytest

from pyspark.sql import functions as F

from telemetra.operators.curate import curate
from telemetra.plans.maintenance import compact_batches
from telemetra.sources import otlp
from telemetra.sources.fixtures import logs_from_events
from telemetra.streaming import curation, ingest
from telemetra.tables import EVENTS

from conftest import SF_SMALL


def land(spark, logs, folder, name):
    """Write export requests as JSON-lines files (one request per line) into the landing folder."""
    otlp.logs_payloads(logs).coalesce(1).write.mode("overwrite").text(f"{folder}/_tmp_{name}")
    src = f"{folder}/_tmp_{name}"
    for f in os.listdir(src):
        if f.endswith(".txt"):
            os.rename(f"{src}/{f}", f"{folder}/{name}.json")


def run(q):
    q.awaitTermination(300)
    assert q.exception() is None


def test_incremental_equals_full_with_late_rows_and_replay(spark, tmp_root):
    events = spark.read.schema(EVENTS).parquet(f"{SF_SMALL}/events.parquet")
    logs = logs_from_events(events)
    early = logs.where(F.col("event_id") % 3 != 0)
    late = logs.where(F.col("event_id") % 3 == 0)  # old timestamps arriving later
    landing, raw, ue = f"{tmp_root}/landing", f"{tmp_root}/raw", f"{tmp_root}/ue"
    os.makedirs(landing)
    ck_i, ck_c = f"{tmp_root}/ck_ingest", f"{tmp_root}/ck_curate"

    land(spark, early, landing, "a")
    run(ingest.start_ingest(spark, landing, raw, checkpoint=ck_i))
    run(curation.start_curation(spark, raw, ue, checkpoint=ck_c))
    n1 = curation.curated_view(spark, ue).count()
    assert n1 == early.count()

    # idle run: nothing new, nothing written
    run(curation.start_curation(spark, raw, ue, checkpoint=ck_c))
    assert curation.curated_view(spark, ue).count() == n1

    land(spark, late, landing, "b")
    run(ingest.start_ingest(spark, landing, raw, checkpoint=ck_i))
    run(curation.start_curation(spark, raw, ue, checkpoint=ck_c))

    cols = ["event_time_unix_nano", "subject", "event", "person_id", "attributes"]
    got = curation.curated_view(spark, ue).select(*cols)
    want = curate(logs).select(*cols)
    assert got.count() == want.count() == logs.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0

    # compaction of published batches into the cold part keeps the multiset and is never re-streamed
    moved = compact_batches(spark, ue, curation.CURATED_PARTS, ["subject", "person_bucket"], ["person_id", "event_time_unix_nano"])
    assert moved == logs.count()
    run(curation.start_curation(spark, raw, ue, checkpoint=ck_c))
    after = curation.curated_view(spark, ue).select(*cols)
    assert after.exceptAll(want).count() == 0 and want.exceptAll(after).count() == 0


def test_replayed_batch_is_published_once(spark, tmp_root):
    from telemetra.streaming.sinks import publish_batch

    df = spark.range(100).withColumn("k", F.col("id") % 3)
    w = lambda d, p: d.write.mode("overwrite").parquet(p)
    assert publish_batch(df, tmp_root, 7, w) is True
    assert publish_batch(df, tmp_root, 7, w) is False
    assert spark.read.parquet(f"{tmp_root}/hot").count() == 100


def test_rebuild_when_schema_predates_subject(spark, tmp_root):
    ue, ck = f"{tmp_root}/ue", f"{tmp_root}/ck"
    spark.range(3).withColumn("event", F.lit("x")).write.parquet(f"{ue}/hot/batch=00000000000000000000")
    os.makedirs(ck)
    assert curation.ensure_curated(spark, ue, ck) is True
    assert not os.path.exists(ue) and not os.path.exists(ck)


def test_stream_ingest_of_spans_and_metric_points(spark, tmp_root):
    from telemetra.sources.fixtures import gauge_from_events, sum_from_events, traces_from_events

    events = spark.read.schema(EVENTS).parquet(f"{SF_SMALL}/events.parquet")
    cases = (
        ("traces", otlp.traces_payloads(traces_from_events(events)), traces_from_events(events)),
        ("gauge", otlp.metrics_payloads(gauge_from_events(events), "gauge"), gauge_from_events(events)),
        ("sum", otlp.metrics_payloads(sum_from_events(events), "sum"), sum_from_events(events)),
    )
    for kind, payloads, want in cases:
        landing, raw = f"{tmp_root}/{kind}/landing", f"{tmp_root}/{kind}/raw"
        payloads.write.text(landing)
        run(ingest.start_ingest(spark, landing, raw, kind=kind, checkpoint=f"{tmp_root}/{kind}/ck", promote=()))
        got = spark.read.parquet(f"{raw}/hot").select(*want.columns)
        assert got.count() == want.count() > 0
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("after_publish", [True, False])
def test_curation_restart_after_failure(spark, tmp_root, monkeypatch, after_publish):
    events = spark.read.schema(EVENTS).parquet(f"{SF_SMALL}/events.parquet")
    logs = logs_from_events(events)
    landing, raw, ue, ck = f"{tmp_root}/landing", f"{tmp_root}/raw", f"{tmp_root}/ue", f"{tmp_root}/ck_c"
    os.makedirs(landing)
    land(spark, logs, landing, "a")
    run(ingest.start_ingest(spark, landing, raw, checkpoint=f"{tmp_root}/ck_i"))
    real = curation.publish_batch

    def lost(batch, root, batch_id, write):
        if after_publish:  # the batch is published, the offset commit never happens
            real(batch, root, batch_id, write)
        raise RuntimeError("driver lost")

    monkeypatch.setattr(curation, "publish_batch", lost)
    q = curation.start_curation(spark, raw, ue, checkpoint=ck)
    with pytest.raises(Exception):
        q.awaitTermination(300)
    monkeypatch.setattr(curation, "publish_batch", real)
    run(curation.start_curation(spark, raw, ue, checkpoint=ck))  # restart from the checkpoint
    cols = ["event_time_unix_nano", "subject", "event", "person_id", "attributes"]
    got = curation.curated_view(spark, ue).select(*cols)
    want = curate(logs).select(*cols)
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stream_keeps_daily_rollup_current(spark, tmp_root):
    from telemetra.operators.product import rollup_daily
    from telemetra.plans import rollup

    events = spark.read.schema(EVENTS).parquet(f"{SF_SMALL}/events.parquet")
    logs = logs_from_events(events)
    newer = F.col("time_unix_nano") >= F.lit(1705363200 * 10**9)  # 2024-01-16
    landing, raw, ue, ru = f"{tmp_root}/landing", f"{tmp_root}/raw", f"{tmp_root}/ue", f"{tmp_root}/rollup"
    os.makedirs(landing)
    for name, part in (("a", logs.where(newer)), ("b", logs.where(~newer))):  # older rows arrive late
        land(spark, part, landing, name)
        run(ingest.start_ingest(spark, landing, raw, checkpoint=f"{tmp_root}/ck_i"))
        run(curation.start_curation(spark, raw, ue, checkpoint=f"{tmp_root}/ck_c", rollup_path=ru))
    cols = ["event_date", "event", "page", "events"]
    want = rollup_daily(curate(logs)).select(*cols)
    got = rollup.read_rollup(spark, ru).select(*cols)
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_requests_of_a_batch_are_read_once(spark, tmp_root, monkeypatch):
    """Both tables are published from what one pass over the landing files left in the staging folder."""
    logs = logs_from_events(spark.read.schema(EVENTS).parquet(f"{SF_SMALL}/events.parquet"))
    landing, raw, read = f"{tmp_root}/landing", f"{tmp_root}/raw", []
    os.makedirs(landing)
    land(spark, logs, landing, "a")
    real = ingest.publish_batch

    def publish(df, *rest):
        read.extend(df.inputFiles())
        return real(df, *rest)

    monkeypatch.setattr(ingest, "publish_batch", publish)
    run(ingest.start_ingest(spark, landing, raw, checkpoint=f"{tmp_root}/ck_i"))
    assert read and not [f for f in read if "/landing/" in f]
    assert curation.read_table(spark, raw, curation.raw_schema()).count() == logs.count()
    assert not [n for n in os.listdir(f"{raw}/_staging") if n.startswith("read=")]
