"""Retention preview/sweep, compaction and history expiry on stored tables."""

from datetime import datetime

import pytest

from pyspark.sql import functions as F

from telemetra.operators import upkeep as M
from telemetra.plans import layout
from telemetra.plans.maintenance import compact, expire_history, retention_sweep
from telemetra.sources.fixtures import logs_from_events, versioned_logs
from telemetra.tables import EVENTS

from conftest import SF_SMALL

AS_OF = datetime(2024, 1, 31)


def events(spark):
    return spark.read.schema(EVENTS).parquet(f"{SF_SMALL}/events.parquet")


def test_plan_disabled_for_non_positive_days():
    assert M.retention_plan(0, AS_OF) == [] and M.retention_plan(-3, AS_OF) == [] and M.retention_plan(None, AS_OF) == []


def test_preview_matches_sweep_and_boundary_kept(spark, tmp_root):
    logs = logs_from_events(events(spark))
    root = f"{tmp_root}/logs"
    layout.write_raw_logs(logs, root)
    plan = [p for p in M.retention_plan(7, AS_OF) if p[0] == "logs"]
    cutoff = plan[0][2]
    stored = layout.read_raw_logs(spark, root)
    # a row exactly at the cutoff and one with NULL time must survive
    extra = spark.createDataFrame([(10**9, cutoff, "x", "INFO", "web", "{}"), (10**9 + 1, None, "y", "INFO", "web", "{}")],
                                  "event_id long, time_unix_nano long, body string, severity_text string, service_name string, log_attributes string")
    layout.write_raw_logs(extra, root, mode="append")
    stored = layout.read_raw_logs(spark, root)
    total = stored.count()
    preview = M.retention_preview({"logs": stored}, plan).first()
    assert preview.total == total
    deleted = retention_sweep(spark, {"logs": (root, layout.RAW_LOGS_STORED, ["event_date"], ["body", "time_unix_nano"])}, plan)
    assert deleted == {"logs": preview.expired}
    left = layout.read_raw_logs(spark, root)
    assert left.count() == total - preview.expired
    assert left.where(F.col("time_unix_nano") < cutoff).count() == 0
    assert left.where(F.col("time_unix_nano") == cutoff).count() == 1
    assert left.where(F.col("time_unix_nano").isNull()).count() == 1
    # nothing left to delete: idempotent
    assert retention_sweep(spark, {"logs": (root, layout.RAW_LOGS_STORED, ["event_date"], ["body", "time_unix_nano"])}, plan) == {}


def test_compact_keeps_multiset(spark, tmp_root):
    logs = logs_from_events(events(spark))
    root = f"{tmp_root}/logs"
    for i in range(4):  # four appends -> several small files per day
        layout.write_raw_logs(logs.where(F.col("event_id") % 4 == i), root, mode="append")
    before = layout.read_raw_logs(spark, root)
    snap = before.select("event_id", "time_unix_nano", "body", "log_attributes").collect()
    stats = compact(spark, root, layout.RAW_LOGS_STORED, ["event_date"], ["body", "time_unix_nano"])
    assert stats["partitions"] > 0 and stats["files_after"] < stats["files_before"]
    after = layout.read_raw_logs(spark, root).select("event_id", "time_unix_nano", "body", "log_attributes").collect()
    assert sorted(snap) == sorted(after)
    assert compact(spark, root, layout.RAW_LOGS_STORED, ["event_date"], ["body", "time_unix_nano"])["partitions"] == 0


def test_expire_history(spark, tmp_root):
    v = versioned_logs(events(spark)).withColumn("event_date", F.to_date(F.lit("2024-01-01")))
    root = f"{tmp_root}/v"
    v.write.partitionBy("event_date").parquet(root)
    schema = spark.read.parquet(root).schema
    live = v.where(F.col("end_snapshot").isNull()).count()
    purged = expire_history(spark, root, schema, ["event_date"], horizon_snapshot=7)
    assert purged == v.count() - live
    assert spark.read.parquet(root).count() == live


def test_day_pruned_search_equals_two_pass(spark, tmp_root):
    from telemetra.operators.curate import curate
    from telemetra.plans.maintenance import _touched, day_prune

    ue = curate(logs_from_events(events(spark)))
    root = f"{tmp_root}/ue"
    layout.write_curated(ue, root, buckets=4, day_level=True)
    parts = list(layout.CURATED_PARTITION)
    df = layout.read_curated(spark, root)
    for days in (3, 7, 29):
        cutoff = M.retention_plan(days, AS_OF)[0][2]
        cond = F.col("event_time_unix_nano") < F.lit(cutoff)
        key = lambda rows: sorted((r["subject"], r["event_date"], r["person_bucket"], r["hit"], r["survive"]) for r in rows)
        pruned = _touched(df, parts, cond, day_prune(parts, cutoff))
        assert pruned and key(pruned) == key(_touched(df, parts, cond))


def test_rewrite_keeps_null_partition(spark, tmp_root):
    v = versioned_logs(events(spark)).withColumn(
        "time_unix_nano", F.when(F.col("event_id") % 10 == 0, F.lit(None)).otherwise(F.col("time_unix_nano")))
    v = v.withColumn("event_date", F.when(F.col("time_unix_nano").isNotNull(), F.to_date(F.lit("2024-01-01"))))
    root = f"{tmp_root}/vn"
    v.write.partitionBy("event_date").parquet(root)
    schema = spark.read.parquet(root).schema
    keep = v.where(F.col("end_snapshot").isNull() | (F.col("end_snapshot") > 7))
    purged = expire_history(spark, root, schema, ["event_date"], horizon_snapshot=7)
    assert purged == v.count() - keep.count() > 0
    after = spark.read.schema(schema).parquet(root)
    assert after.count() == keep.count()
    assert after.where(F.col("event_date").isNull()).count() == keep.where(F.col("event_date").isNull()).count() > 0


@pytest.mark.parametrize("crash_at", [1, 2, 4])
def test_interrupted_swap_rolls_forward(spark, tmp_root, monkeypatch, crash_at):
    import os

    from telemetra.plans import fs as fsmod
    from telemetra.plans.maintenance import recover

    root = f"{tmp_root}/logs"
    layout.write_raw_logs(logs_from_events(events(spark)), root)
    plan = [p for p in M.retention_plan(7, AS_OF) if p[0] == "logs"]
    t = F.col("time_unix_nano")
    want = sorted(layout.read_raw_logs(spark, root).where(~(t < plan[0][2]) | t.isNull()).select("event_id").collect())
    real, calls = fsmod.move, {"n": 0}

    def lost_driver(*a):
        calls["n"] += 1
        if calls["n"] == crash_at:
            raise RuntimeError("driver lost")
        return real(*a)

    monkeypatch.setattr(fsmod, "move", lost_driver)
    with pytest.raises(RuntimeError, match="driver lost"):
        retention_sweep(spark, {"logs": (root, layout.RAW_LOGS_STORED, ["event_date"], ["body", "time_unix_nano"])}, plan)
    monkeypatch.setattr(fsmod, "move", real)
    assert sorted(layout.read_raw_logs(spark, root).select("event_id").collect()) != want  # mid-swap state
    assert recover(spark, root) == 1  # the journaled publish is finished
    assert sorted(layout.read_raw_logs(spark, root).select("event_id").collect()) == want
    assert not [n for n in os.listdir(root) if n.startswith(("_publish", "_staging"))]
    assert recover(spark, root) == 0


@pytest.mark.parametrize("crash_at", [1, 3])
def test_interrupted_batch_compaction_rolls_forward(spark, tmp_root, monkeypatch, crash_at):
    from telemetra.operators.curate import curate
    from telemetra.plans import fs as fsmod
    from telemetra.plans.maintenance import compact_batches, recover
    from telemetra.schemas import USER_EVENT_COLUMNS
    from telemetra.streaming import curation

    logs = logs_from_events(events(spark))
    root = f"{tmp_root}/ue"
    for i in range(2):  # two published micro-batches, as the curation stream leaves them
        curation.write_curated_batch(logs.where(F.col("event_id") % 2 == i), f"{root}/hot/batch={i:020d}")
    want = sorted(curate(logs).select(*USER_EVENT_COLUMNS).collect())
    real, calls = fsmod.move, {"n": 0}

    def lost_driver(*a):
        calls["n"] += 1
        if calls["n"] == crash_at:
            raise RuntimeError("driver lost")
        return real(*a)

    monkeypatch.setattr(fsmod, "move", lost_driver)
    with pytest.raises(RuntimeError, match="driver lost"):
        compact_batches(spark, root, curation.CURATED_PARTS, ["subject", "person_bucket"], ["person_id", "event_time_unix_nano"])
    monkeypatch.setattr(fsmod, "move", real)
    assert recover(spark, root) == 1
    after = curation.curated_view(spark, root).select(*USER_EVENT_COLUMNS)
    assert sorted(after.collect()) == want  # no row lost, none duplicated
    assert not fsmod.list_dir(spark, f"{root}/hot") or not [n for n, d, _ in fsmod.list_dir(spark, f"{root}/hot") if d]


def test_expire_trims_commits_so_old_reads_predate_history(spark, tmp_root):
    from telemetra.operators import history as H
    from telemetra.sources.fixtures import commits_from_versions

    v = versioned_logs(events(spark))
    root, croot = f"{tmp_root}/v", f"{tmp_root}/commits"
    layout.write_raw_logs(v, root)
    layout.write_commits(commits_from_versions(v), croot)
    commits = layout.read_commits(spark, croot)
    at_3 = commits.where(F.col("snapshot_id") == 3).first().snapshot_time
    at_7 = commits.where(F.col("snapshot_id") == 7).first().snapshot_time
    before = H.as_of_count(layout.read_versioned_logs(spark, root), commits, at_7).first()
    expire_history(spark, root, layout.VERSIONED_LOGS_STORED, ["event_date"], 7, commits_root=croot)
    table, commits = layout.read_versioned_logs(spark, root), layout.read_commits(spark, croot)
    assert [r.snapshot_id for r in commits.collect()] == [7]
    old = H.as_of_count(table, commits, at_3).first()
    assert old.snapshot_id is None and old.past is None and old.earliest == at_7
    now = H.as_of_count(table, commits, at_7).first()
    assert now.snapshot_id == 7 and now.past == before.past and now.now == before.now


def test_versioned_sweep_is_a_logical_delete_until_expiry(spark, tmp_root):
    from telemetra.operators import history as H
    from telemetra.plans.maintenance import retention_sweep_versioned
    from telemetra.sources.fixtures import commits_from_versions

    v = versioned_logs(events(spark))
    root, croot = f"{tmp_root}/v", f"{tmp_root}/commits"
    layout.write_raw_logs(v, root)
    layout.write_commits(commits_from_versions(v), croot)
    cutoff = M.retention_plan(7, AS_OF)[0][2]
    due = v.where(F.col("end_snapshot").isNull() & (F.col("time_unix_nano") < cutoff)).count()
    at_7 = layout.read_commits(spark, croot).where(F.col("snapshot_id") == 7).first().snapshot_time
    live_at_7 = H.as_of_time(v, commits_from_versions(v), at_7).count()
    sweep = lambda: retention_sweep_versioned(
        spark, root, layout.VERSIONED_LOGS_STORED, ["event_date"], "time_unix_nano", cutoff, croot,
        datetime(2024, 2, 1, 8), ["body", "time_unix_nano"])
    assert sweep() == (8, due) and due > 0
    table, commits = layout.read_versioned_logs(spark, root), layout.read_commits(spark, croot)
    assert table.count() == v.count()  # nothing physically removed yet
    assert {r.change_type: r.n for r in H.changes(table, commits, 8, 8).collect()} == {"delete": due}
    assert H.as_of_time(table, commits, at_7).count() == live_at_7  # time travel still sees the rows
    assert table.where(F.col("end_snapshot").isNull() & (F.col("time_unix_nano") < cutoff)).count() == 0
    assert sweep() == (8, 0)  # nothing due: no new commit
    purged = expire_history(spark, root, layout.VERSIONED_LOGS_STORED, ["event_date"], 8, commits_root=croot)
    assert purged == v.where(F.col("end_snapshot").isNotNull()).count() + due
    assert [r.snapshot_id for r in layout.read_commits(spark, croot).collect()] == [8]
