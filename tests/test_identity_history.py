"""Identity golden cases and history properties."""

from pyspark.sql import functions as F

from telemetra.operators import history as H
from telemetra.operators import identity as J
from telemetra.operators.curate import curate
from telemetra.schemas import COMMITS, LOGS
from telemetra.sources.fixtures import commits_from_versions, versioned_logs
from telemetra.tables import EVENTS

from conftest import SF_SMALL


def golden_logs(spark, persons=3):
    """P persons x 2 devices x 8 events + 1 identify per device."""
    rows, i = [], 0
    for p in range(persons):
        for d in range(2):
            dev = f"p{p}d{d}"
            for _ in range(8):
                rows.append((i, 10**18 + i, "page_view", "INFO", "web", f'{{"anonymous.id":"{dev}"}}'))
                i += 1
            rows.append((i, 10**18 + i, "identify", "INFO", "web", f'{{"anonymous.id":"{dev}","user.id":"u{p}"}}'))
            i += 1
    return spark.createDataFrame(rows, LOGS)


def test_stitch_golden(spark):
    logs = golden_logs(spark)
    assert {(r.uid, r.devices) for r in J.stitch_devices(logs).collect()} == {("u0", 2), ("u1", 2), ("u2", 2)}
    m = J.stitch_multi_device(logs).first()
    assert (m.persons, m.multi_device) == (3, 3)
    assert {(r.uid, r.events) for r in J.stitch_events(logs).collect()} == {("u0", 16), ("u1", 16), ("u2", 16)}


def test_multi_owner_device_counts_for_both(spark):
    rows = [
        (0, 1, "identify", "INFO", "web", '{"anonymous.id":"d","user.id":"a"}'),
        (1, 2, "identify", "INFO", "web", '{"anonymous.id":"d","user.id":"b"}'),
        (2, 3, "page_view", "INFO", "web", '{"anonymous.id":"d"}'),
        (3, 4, "page_view", "INFO", "web", "{}"),
    ]
    logs = spark.createDataFrame(rows, LOGS)
    assert {(r.uid, r.events) for r in J.stitch_events(logs).collect()} == {("a", 1), ("b", 1)}
    # backfill picks one owner: the earliest identify
    b = J.backfill_identity(curate(logs)).orderBy("event_time_unix_nano").collect()
    assert [r.user_id for r in b] == ["a", "b", "a", None]
    assert len(b) == 4


def test_history_properties(spark):
    events = spark.read.schema(EVENTS).parquet(f"{SF_SMALL}/events.parquet")
    v = versioned_logs(events)
    commits = commits_from_versions(v)
    last = commits.agg(F.max("snapshot_id")).first()[0]
    live = v.where(F.col("end_snapshot").isNull()).drop("begin_snapshot", "end_snapshot")
    assert H.as_of(v, last).exceptAll(live).count() == 0 and live.count() == H.as_of(v, last).count()
    first = commits.agg(F.min("snapshot_id")).first()[0]
    ch = {r.change_type: r.n for r in H.changes(v, commits, first + 1, last).collect()}
    growth = H.as_of(v, last).count() - H.as_of(v, first).count()
    assert ch.get("insert", 0) - ch.get("delete", 0) == growth


def test_as_of_before_history_and_short_history(spark):
    from datetime import datetime

    v = versioned_logs(spark.read.schema(EVENTS).parquet(f"{SF_SMALL}/events.parquet"))
    commits = commits_from_versions(v)
    r = H.as_of_count(v, commits, datetime(2020, 1, 1)).first()
    assert r.past is None and r.snapshot_id is None and r.earliest is not None
    one = spark.createDataFrame([(1, datetime(2024, 2, 1))], COMMITS)
    assert H.changes(v, one).count() == 0


def test_approx_variants_close_to_exact(spark):
    from telemetra.operators import reports as R
    from telemetra.tables import Tables

    t = Tables(spark, SF_SMALL, land=False)
    exact, approx = R.report(t.logs).first(), R.report(t.logs, approx=True).first()
    assert approx.total == exact.total and approx.errors == exact.errors
    assert abs(approx.devices - exact.devices) <= 0.05 * exact.devices
    assert abs(approx.identified - exact.identified) <= 0.05 * exact.identified
    e = {r.name: r.p95_ms for r in R.span_p95(t.traces).collect()}
    a = {r.name: r.p95_ms for r in R.span_p95(t.traces, approx=True).collect()}
    assert e.keys() == a.keys() and all(abs(a[k] - e[k]) <= 0.05 * e[k] for k in e)
