"""Compaction, sweep and rebuild of the tables the streams write (hot and cold parts)."""

import os

import pytest
from pyspark.sql import functions as F

from telemetra.operators import upkeep as M
from telemetra.operators.curate import curate
from telemetra.plans import layout, maintenance, rollup
from telemetra.operators.product import rollup_daily
from telemetra.sources.fixtures import logs_from_events
from telemetra.streaming import curation, ingest, upkeep
from telemetra.tables import EVENTS

from conftest import SF_SMALL
from test_streaming import land, run
from test_upkeep import AS_OF

RAW = (["event_date"], ["body", "time_unix_nano"])
CURATED = (["subject", "person_bucket"], ["person_id", "event_time_unix_nano"])
COLS = ["event_time_unix_nano", "subject", "event", "person_id", "attributes"]


@pytest.fixture(scope="module")
def logs(spark):
    return logs_from_events(spark.read.schema(EVENTS).parquet(f"{SF_SMALL}/events.parquet")).cache()


class Feed:
    """A landing folder with its raw and curated tables."""

    def __init__(self, spark, root):
        self.spark, self.root, self.raw, self.ue = spark, root, f"{root}/raw", f"{root}/ue"
        os.makedirs(f"{root}/landing")

    def ingest(self, name, rows):
        land(self.spark, rows, f"{self.root}/landing", name)
        run(ingest.start_ingest(self.spark, f"{self.root}/landing", self.raw, checkpoint=f"{self.root}/ck_i"))

    def curate(self, **options):
        run(curation.start_curation(self.spark, self.raw, self.ue, checkpoint=f"{self.root}/ck_c", **options))

    def raw_rows(self):
        return curation.read_table(self.spark, self.raw, curation.raw_schema())

    def rows(self):
        return sorted(map(str, curation.curated_view(self.spark, self.ue).select(*COLS).collect()))

    def compact(self):
        names = upkeep.curated_batches(self.spark, self.raw, self.ue)
        return (upkeep.compact_streamed(self.spark, self.raw, curation.raw_schema(), *RAW, names),
                upkeep.compact_streamed(self.spark, self.ue, curation.CURATED_PARTS, *CURATED))


def thirds(logs):
    t = logs.select(F.percentile("time_unix_nano", F.array(F.lit(1 / 3), F.lit(2 / 3)))).first()[0]
    at = F.col("time_unix_nano")
    return [logs.where(at < t[0]), logs.where((at >= t[0]) & (at < t[1])), logs.where(at >= t[1])]


def want(rows):
    return sorted(map(str, curate(rows).select(*COLS).collect()))


def test_only_curated_and_settled_batches_leave_hot(spark, logs, tmp_root):
    feed, (a, b, c) = Feed(spark, tmp_root), thirds(logs)
    feed.ingest("a", a)
    assert feed.compact() == (0, 0)                       # nothing is curated yet
    feed.curate()
    assert feed.compact() == (0, 0)                       # curated, but the batch might still be replayed
    feed.ingest("b", b)
    feed.curate()
    feed.ingest("c", c)                                   # landed, never curated
    assert feed.compact() == (a.count(), a.count())
    assert feed.raw_rows().count() == logs.count()
    feed.curate()
    assert feed.rows() == want(logs)                      # no row lost, none read twice
    feed.curate()
    assert feed.rows() == want(logs)


def test_batches_are_curated_and_moved_in_one_pass(spark, logs, tmp_root, monkeypatch):
    """A partition the moved batches fill is one file, which needs no second rewrite."""
    feed, (a, b, c) = Feed(spark, tmp_root), thirds(logs)
    for name, rows in zip("abc", (a, b, c)):
        feed.ingest(name, rows)
        feed.curate()
    rewritten = []
    real = maintenance.rewrite_partitions
    monkeypatch.setattr(maintenance, "rewrite_partitions", lambda *args, **kw: rewritten.append(args) or real(*args, **kw))
    assert feed.compact() == (a.count() + b.count(),) * 2
    assert not rewritten
    cold = f"{feed.ue}/cold"
    files = {d: sum(f.endswith(".parquet") for f in fs) for d, _, fs in os.walk(cold)}
    assert max(files.values()) == 1
    assert feed.rows() == want(logs)


def test_a_batch_read_in_two_runs_waits_for_both(spark, logs, tmp_root):
    feed, (a, b, c) = Feed(spark, tmp_root), thirds(logs)
    feed.ingest("a", a)
    feed.ingest("b", b)
    query = curation.start_curation(spark, feed.raw, feed.ue, checkpoint=f"{feed.root}/ck_c", max_files_per_trigger=1)
    run(query)
    moved, _ = feed.compact()
    assert 0 < moved < a.count() + b.count()              # the batch with the last file stays
    feed.ingest("c", c)
    feed.curate()
    assert feed.rows() == want(logs)


def test_sweep_deletes_what_left_hot_and_says_what_waits(spark, logs, tmp_root):
    feed, plan = Feed(spark, tmp_root), M.retention_plan(7, AS_OF)
    for name, rows in zip("abc", thirds(logs)):
        feed.ingest(name, rows)
        feed.curate()
    cutoff = plan[0][2]
    old = logs.where(F.col("time_unix_nano") < cutoff).count()
    late = thirds(logs)[2].where(F.col("time_unix_nano") < cutoff).count()      # expired, in the newest batch
    assert late > 0

    def sweep():
        tables = {"logs": (feed.raw, curation.raw_schema(), *RAW, upkeep.curated_batches(spark, feed.raw, feed.ue)),
                  "user_events": (feed.ue, curation.CURATED_PARTS, *CURATED, None)}
        return {r.table_name: (r.deleted, r.waiting, r.remaining) for r in upkeep.sweep_streamed(spark, tables, plan).collect()}

    n = logs.count()
    assert sweep() == dict.fromkeys(("logs", "user_events"), (old - late, late, n - old + late))
    assert sweep() == dict.fromkeys(("logs", "user_events"), (0, late, n - old + late))
    feed.curate()                                                                # rewritten files aren't new rows
    assert len(feed.rows()) == n - old + late
    extra = logs.limit(1).withColumn("time_unix_nano", F.lit(cutoff))           # a later batch settles the last one
    feed.ingest("d", extra)
    feed.curate()
    assert sweep() == dict.fromkeys(("logs", "user_events"), (late, 0, n - old + 1))
    kept = logs.where(F.col("time_unix_nano") >= cutoff).unionByName(extra)
    assert feed.rows() == want(kept)


def test_rebuild_after_compaction_ends_at_the_input(spark, logs, tmp_root):
    feed, totals = Feed(spark, tmp_root), f"{tmp_root}/rollup"
    for name, rows in zip("abc", thirds(logs)):
        feed.ingest(name, rows)
        feed.curate()
    assert feed.compact()[0] > 0
    # the curated table of an older release: no subject
    for d, _, files in os.walk(feed.ue):
        for f in files:
            if f.endswith(".parquet"):
                os.remove(f"{d}/{f}")
    spark.range(1).write.mode("overwrite").parquet(f"{feed.ue}/hot/batch=old-{0:020d}")
    assert curation.ensure_curated(spark, feed.ue, f"{tmp_root}/ck_c")
    feed.curate(rollup_path=totals)
    assert feed.rows() == want(logs)
    feed.curate(rollup_path=totals)
    assert feed.rows() == want(logs)
    cols = ["event_date", "event", "page", "events"]
    assert sorted(map(str, rollup.read_rollup(spark, totals).select(*cols).collect())) == \
        sorted(map(str, rollup_daily(curate(logs)).select(*cols).collect()))


def test_a_rejected_request_is_counted_once(spark, logs, tmp_root, monkeypatch):
    feed = Feed(spark, tmp_root)
    feed.ingest("a", logs.limit(60))
    with open(f"{tmp_root}/landing/b.json", "w") as f:
        f.write('{"resourceLogs": [{"resource"\n\n   \n{"resourceSpans": []}\n[1, 2]\nnot json\n{"resourceLogs": []}\n'
                '{"resourceLogs": "text"}\n')
    real = ingest.publish_batch

    def lost(df, root, *rest):
        if not root.endswith("rejected"):
            raise RuntimeError("driver lost")
        return real(df, root, *rest)

    monkeypatch.setattr(ingest, "publish_batch", lost)     # lost between the two sinks
    with pytest.raises(Exception):
        run(ingest.start_ingest(spark, f"{tmp_root}/landing", feed.raw, checkpoint=f"{tmp_root}/ck_i"))
    monkeypatch.setattr(ingest, "publish_batch", real)
    for _ in range(2):
        run(ingest.start_ingest(spark, f"{tmp_root}/landing", feed.raw, checkpoint=f"{tmp_root}/ck_i"))
        got = ingest.read_rejected(spark, feed.raw).groupBy("cause").count().collect()
        assert {r.cause: r["count"] for r in got} == {"malformed": 2, "blank": 2, "no_resourceLogs": 3}
        assert feed.raw_rows().count() == 60
