"""The day walk of newest-first lists: same rows as a full sort, and only the days needed are read."""

import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from telemetra.operators import reports as R
from telemetra.plans import layout, newest
from telemetra.schemas import LOGS
from telemetra.tables import Tables

from conftest import SF_SMALL
from test_plans import scans_of

DAY = 86_400 * 10**9


def rows_on(days, per_day=3):
    """``per_day`` rows on each of ``days`` (days since the epoch; None: rows without a time)."""
    return [(i * 100 + k, None if d is None else d * DAY + k, f"b{k}", "ERROR" if k == 0 else "INFO", "web", f'{{"page":"/{i}"}}')
            for i, d in enumerate(days) for k in range(per_day)]


@pytest.fixture()
def logs(spark, tmp_root):
    def land(days, per_day=3):
        path = f"{tmp_root}/logs"
        layout.write_raw_logs(spark.createDataFrame(rows_on(days, per_day), LOGS), path)
        return layout.read_raw_logs(spark, path), layout.partition_days(spark, path)
    return land


def lower_day(df):
    """The earliest day the partition filters of a plan let through; None where they let all through."""
    found = [re.findall(r"event_date#\d+ >= (\d{4}-\d\d-\d\d)", s["PartitionFilters"]) for s in scans_of(df)]
    return min((min(map(date.fromisoformat, f)) for f in found if f), default=None) if all(found) else None


def test_partition_days_are_newest_first_and_the_missing_day_last(logs):
    _, days = logs([19700, None, 19702, 19690])
    assert days == [date(1970, 1, 1) + timedelta(days=d) for d in (19702, 19700, 19690)] + [None]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 25, 31, 1000])
def test_same_rows_as_a_full_sort(logs, n):
    df, days = logs([19700 + 7 * i for i in range(10)] + [None])     # a week without rows between any two days
    assert R.recent_events(df, n, days).collect() == R.recent_events(df, n).collect()
    assert R.recent_errors(df, n, days).collect() == R.recent_errors(df, n).collect()


def test_days_without_a_match_are_walked_over(logs, spark, tmp_root):
    # errors on the oldest day alone, 40 later days without one
    rows = rows_on([19650], 4) + [(r[0] + 10_000, *r[1:3], "INFO", *r[4:]) for r in rows_on(range(19700, 19740))]
    path = f"{tmp_root}/sparse"
    layout.write_raw_logs(spark.createDataFrame(rows, LOGS), path)
    df, days = layout.read_raw_logs(spark, path), layout.partition_days(spark, path)
    got = R.recent_errors(df, 5, days).collect()
    assert len(got) == 1 and got == R.recent_errors(df, 5).collect()


def test_only_the_days_needed_are_read(logs):
    df, days = logs(range(19700, 19740))
    newest_day = date(1970, 1, 1) + timedelta(days=19739)
    assert lower_day(R.recent_events(df, 3, days)) == newest_day
    assert lower_day(R.recent_events(df, 4, days)) == newest_day - timedelta(days=2)    # one day, then two more
    assert lower_day(R.recent_errors(df, 6, days)) == newest_day - timedelta(days=6)    # 1 + 2 + 4 days hold 7 errors
    assert lower_day(R.recent_events(df, 3)) is None
    first = scans_of(R.sample(df, days))
    assert all("event_date" in s["PartitionFilters"] and "1970-01-01" not in s["PartitionFilters"] for s in first)
    assert R.sample(df, days).collect() == R.sample(df).collect()


def test_a_walk_takes_few_steps(logs, monkeypatch):
    df, days = logs(range(19600, 19700), 1)
    seen = []
    monkeypatch.setattr(newest, "in_days", lambda d, c: seen.append(len(d)) or F.lit(False))
    newest.walk(df, 1, days)                                            # nothing is ever found
    assert seen == [1, 2, 4, 8, 16, 32, 37]


@pytest.mark.parametrize("empty", [[], [None]])
def test_tables_without_days(logs, empty):
    df, days = logs(empty)
    assert R.recent_events(df, 5, days).collect() == R.recent_events(df, 5).collect()
    assert R.sample(df, days).count() == bool(empty)


def test_a_subjects_newest_rows_come_from_its_newest_days(spark):
    day = Tables(spark, SF_SMALL).by_day
    ue, days = day.ue, day.days("user_events", "subject=errors")
    assert len(days) > 20
    got = R.subject_recent(ue, "errors", partition_days=days)
    assert got.collect() == R.subject_recent(ue, "errors").collect()
    assert lower_day(got) > days[10]
    windowed = R.subject_recent(ue, "errors", days=3, partition_days=days)
    assert windowed.collect() == R.subject_recent(ue, "errors", days=3).collect()


def test_registered_lists_read_few_days(spark):
    t = Tables(spark, SF_SMALL)
    logs, traces = t.logs, t.traces
    assert lower_day(R.recent_events(logs, days=t.days("logs"))) >= t.days("logs")[2]
    assert lower_day(R.recent_spans(traces, days=t.days("traces"))) >= t.days("traces")[2]
    assert lower_day(R.recent_errors(logs, days=t.days("logs"))) > t.days("logs")[15]
