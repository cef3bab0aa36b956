"""Additive daily partials: counts and distinct sketches that a replay, a merge or a crash leaves right."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from telemetra.functions.timecols import date_of_ns
from telemetra.operators.curate import curate
from telemetra.operators.product import rollup_daily
from telemetra.plans import fs, rollup
from telemetra.sources.fixtures import logs_from_events
from telemetra.tables import EVENTS

from conftest import SF_SMALL
from test_plans import scans_of

COLS = ["event_date", "event", "page", "events"]


@pytest.fixture(scope="module")
def ue(spark):
    return curate(logs_from_events(spark.read.schema(EVENTS).parquet(f"{SF_SMALL}/events.parquet"))).cache()


def split(ue, n):
    return [ue.where(F.pmod(F.xxhash64("attributes", "event_time_unix_nano"), F.lit(n)) == i) for i in range(n)]


def rows(df):
    return sorted(map(str, df.select(*COLS).collect()))


def test_partials_add_up_whatever_the_batches(spark, ue, tmp_root):
    want, visitors = rows(rollup_daily(ue)), None
    for n in (1, 3):
        root = f"{tmp_root}/r{n}"
        for i, part in enumerate(split(ue, n)):
            rollup.publish_partials(part, root, i)
        assert rows(rollup.read_rollup(spark, root)) == want
        got = rollup.read_visitors(spark, root).first()
        visitors = visitors or got
        assert got == visitors            # the union of sketches is the sketch of the union


def test_a_replay_keeps_the_totals_and_other_streams_count(spark, ue, tmp_root):
    root = f"{tmp_root}/r"
    a, b = split(ue, 2)
    assert rollup.publish_partials(a, root, 0) and not rollup.publish_partials(a, root, 0)
    assert rollup.publish_partials(b, root, 0, "second-feed")
    assert rows(rollup.read_rollup(spark, root)) == rows(rollup_daily(ue))
    merged = rollup.merge_partials(spark, root)
    assert merged == 0                     # one folder a stream: nothing to merge


def test_merging_changes_no_figure_at_any_point(spark, ue, tmp_root, monkeypatch):
    root, want = f"{tmp_root}/r", rows(rollup_daily(ue))
    parts = split(ue, 5)
    for i in range(4):
        rollup.publish_partials(parts[i], root, i)
    real = fs.rename
    monkeypatch.setattr(fs, "rename", lambda *a: (_ for _ in ()).throw(OSError("driver lost")))
    with pytest.raises(OSError):           # lost before the rename: the batches still count
        rollup.merge_partials(spark, root)
    monkeypatch.setattr(fs, "rename", real)
    before = rows(rollup.read_rollup(spark, root))
    assert rollup.merge_partials(spark, root) == 8
    assert rows(rollup.read_rollup(spark, root)) == before      # merged and covered folders both there
    assert not rollup.publish_partials(parts[2], root, 2)       # a late replay
    assert rollup.drop_covered(spark, root) == 8
    rollup.publish_partials(parts[2], root, 2)                  # a replay after the folders went: covered, not counted
    assert rows(rollup.read_rollup(spark, root)) == before
    rollup.publish_partials(parts[4], root, 4)
    assert rollup.merge_partials(spark, root) == 4              # the merged range and the new batch, per table
    assert rows(rollup.read_rollup(spark, root)) == want
    assert rollup.read_visitors(spark, root).first().events == ue.count()


def test_a_batch_not_published_yet_is_never_covered(spark, ue, tmp_root):
    root, parts = f"{tmp_root}/r", split(ue, 4)
    for i in (0, 1, 3):
        rollup.publish_partials(parts[i], root, i)
    rollup.merge_partials(spark, root)
    rollup.publish_partials(parts[2], root, 2)
    assert rows(rollup.read_rollup(spark, root)) == rows(rollup_daily(ue))


def test_a_refresh_reads_the_new_batch_only(spark, ue, tmp_root, monkeypatch):
    root = f"{tmp_root}/r"
    a, b = split(ue, 2)
    rollup.publish_partials(a, root, 0)

    def files():
        return {p: os.stat(p).st_mtime_ns for d, _, f in os.walk(root) for p in (os.path.join(d, x) for x in f)}

    before = files()
    monkeypatch.setattr(rollup, "_read", None)                  # stored partials aren't read
    rollup.publish_partials(b, root, 1)
    after = files()
    assert all(after[p] == t for p, t in before.items()) and all("-00000000000000000001/" in p for p in after.keys() - before.keys())


def test_day_ranges_prune_and_are_exact(spark, ue, tmp_root):
    root, first, last = f"{tmp_root}/r", date(2024, 1, 10), date(2024, 1, 12)
    for i, part in enumerate(split(ue, 2)):
        rollup.publish_partials(part, root, i)
    got = rollup.read_rollup(spark, root, first, last)
    assert rows(got) == rows(rollup_daily(ue.where(date_of_ns("event_time_unix_nano").between(F.lit(first), F.lit(last)))))
    for df in (got, rollup.read_visitors(spark, root, first, last)):
        scans = scans_of(df)
        assert scans and all("event_date" in s["PartitionFilters"] and "2024-01-10" in s["PartitionFilters"] for s in scans)
    by_day = {r.event_date: r for r in rollup.read_visitors(spark, root, by_day=True).collect()}
    exact = ue.groupBy(date_of_ns("event_time_unix_nano").alias("d")).agg(F.count_distinct("person_id").alias("p"), F.count("*").alias("n"))
    assert {d: (r.persons, r.events) for d, r in by_day.items()} == {r.d: (r.p, r.n) for r in exact.collect()}  # few: exact


def test_sketches_stay_within_their_error(spark, tmp_root):
    n = 60_000
    made = spark.range(n).selectExpr(
        "1704067200000000000 + (id % 30) * 86400000000000 AS event_time_unix_nano", "if(id % 9 = 0, 'identify', 'click') AS event",
        "concat('d', id) AS anonymous_id", "concat('p', id % 40000) AS person_id", "if(id % 2 = 0, concat('u', id), null) AS user_id", "'/' AS page")
    root = f"{tmp_root}/r"
    rollup.publish_partials(made, root)
    got = rollup.read_visitors(spark, root).first()
    assert got.events == n
    for c, exact in (("devices", n), ("persons", 40_000), ("users", n // 2), ("signed_in", len(range(0, n, 18)))):
        assert abs(got[c] - exact) <= 0.05 * exact, (c, got[c], exact)


def test_empty(spark, ue, tmp_root):
    assert rollup.read_rollup(spark, f"{tmp_root}/none").count() == 0
    assert rollup.read_visitors(spark, f"{tmp_root}/none").first().asDict() == dict.fromkeys(("events", *rollup.SKETCHES), 0)
    rollup.publish_partials(ue.where("false"), f"{tmp_root}/e", 0)
    rollup.publish_partials(ue.where("false"), f"{tmp_root}/e", 1)
    rollup.merge_partials(spark, f"{tmp_root}/e")
    assert rollup.read_rollup(spark, f"{tmp_root}/e").count() == 0


def test_day_bitmaps_merge_to_the_retention_of_all_events(spark, ue):
    from telemetra.operators import product as W

    want = sorted(map(tuple, W.cohort_retention(ue, by="anonymous_id").collect()))
    for n in (1, 3):
        days = None
        for part in split(ue, n):
            rows_ = W.active_days(part, by="anonymous_id")
            days = rows_ if days is None else days.unionByName(rows_)
        merged = W.merge_days(days.unionByName(days))         # repeated batches change nothing
        assert sorted(map(tuple, W.retention_of_days(merged).collect())) == want
    assert {len(r.days) for r in W.active_days(ue).collect()} == {4096}


def test_day_bitmaps_of_distant_days(spark):
    from telemetra.operators import product as W

    day = 86_400 * 10**9
    made = [("p", d * day) for d in (-40_000, -1, 0, 1, 19_700, 32_768, 32_769, 60_000)] + [("q", 7 * day), ("q", 7 * day + 5), ("r", None), (None, 0)]
    ue = spark.createDataFrame(made, "person_id string, event_time_unix_nano long")
    got = W.retention_of_days(W.merge_days(W.active_days(ue)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, W.cohort_retention(ue.where("event_time_unix_nano is not null")).collect()))
