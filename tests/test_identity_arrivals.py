"""The stored identity table against a full backfill after every arrival."""

import os

import pytest
from pyspark.sql import functions as F

from telemetra.operators.curate import curate
from telemetra.operators.identity import backfill_identity
from telemetra.schemas import USER_EVENTS, USER_EVENT_COLUMNS
from telemetra.sources.fixtures import logs_from_events
from telemetra.streaming import identity
from telemetra.tables import EVENTS

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def ue(spark):
    return curate(logs_from_events(spark.read.schema(EVENTS).parquet(f"{SF_SMALL}/events.parquet"))).select(*USER_EVENT_COLUMNS).cache()


def rows(df):
    return sorted(map(str, df.select(*USER_EVENT_COLUMNS).collect()))


def arrivals(ue):
    day = F.dayofmonth("event_time")
    return [ue.where(c) for c in (day > 20, (day > 10) & (day <= 20), day <= 10)]


def event(t, kind, device, uid=None):
    base = dict.fromkeys(USER_EVENT_COLUMNS)
    base.update(event_time_unix_nano=t, event=kind, anonymous_id=device, user_id=uid, person_id=uid or device, subject="activities")
    return tuple(base[c] for c in USER_EVENT_COLUMNS)


def test_equals_a_full_backfill_after_each_arrival(spark, ue, tmp_root):
    seen = None
    for batch, part in enumerate(arrivals(ue)):
        identity.add_arrival(part, tmp_root, batch)
        seen = part if seen is None else seen.unionByName(part)
        assert rows(identity.read_events(spark, tmp_root)) == rows(backfill_identity(seen))


def test_only_folders_of_newly_owned_devices_are_rewritten(spark, tmp_root):
    def frame(*events):
        return spark.createDataFrame(list(events), USER_EVENTS)

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{tmp_root}/events")
                for f in fs if f.endswith(".parquet")}

    first = [event(t, "click", f"d{t % 40}") for t in range(400)] + [event(401, "click", None), event(402, "click", "d1", "own")]
    assert identity.add_arrival(frame(*first), tmp_root, 0) == 0
    before = files()
    # d1 signs in late as u9; d2's sign-in tells nothing about stored rows of other devices
    assert identity.add_arrival(frame(event(900, "identify", "d1", "u9"), event(901, "click", "d3")), tmp_root, 1) == 1
    after = files()
    gone, same = set(before) - set(after), [p for p in before if after.get(p) == before[p]]
    assert gone and len({os.path.dirname(p) for p in gone}) == 1 and len(same) == len(before) - len(gone)
    got = identity.read_events(spark, tmp_root).where("anonymous_id = 'd1'").groupBy("user_id").count().collect()
    assert {r.user_id: r["count"] for r in got} == {"u9": 11, "own": 1}
    # an earlier sign-in takes the device over, but not the row that came with an id of its own
    assert identity.add_arrival(frame(event(5, "identify", "d1", "u7")), tmp_root, 2) == 2
    got = identity.read_events(spark, tmp_root).where("anonymous_id = 'd1'").groupBy("user_id").count().collect()
    assert {r.user_id: r["count"] for r in got} == {"u7": 11, "own": 1, "u9": 1}
    # a later one changes nothing
    assert identity.add_arrival(frame(event(999, "identify", "d1", "u8")), tmp_root, 3) == 0


def test_replays_and_a_lost_driver(spark, ue, tmp_root, monkeypatch):
    parts = arrivals(ue)
    for batch, part in enumerate(parts[:2]):
        identity.add_arrival(part, tmp_root, batch)
    want = rows(identity.read_events(spark, tmp_root))
    identity.add_arrival(parts[1], tmp_root, 1)
    assert rows(identity.read_events(spark, tmp_root)) == want
    real = identity._publish
    monkeypatch.setattr(identity, "_publish", lambda df, path: (real(df, path), (_ for _ in ()).throw(RuntimeError("driver lost")))[0])
    with pytest.raises(RuntimeError):                        # lost with only the sign-ins published
        identity.add_arrival(parts[2], tmp_root, 2)
    monkeypatch.setattr(identity, "_publish", real)
    identity.add_arrival(parts[2], tmp_root, 2)
    assert rows(identity.read_events(spark, tmp_root)) == rows(backfill_identity(ue))


def test_empty_arrivals(spark, ue, tmp_root):
    none = ue.where("false")
    assert identity.add_arrival(none, tmp_root, 0) == 0
    identity.add_arrival(ue, tmp_root, 1)
    identity.add_arrival(none, tmp_root, 2)
    assert rows(identity.read_events(spark, tmp_root)) == rows(backfill_identity(ue))
