"""Product analytics and identity backfill against brute force, with one hot key.

The sf0.001 curated table is skewed so that one device and one session hold a
third of all rows; each operator's Spark result must equal a plain-Python
computation over the collected rows (small fixture, so collecting is fine here).
"""

from collections import Counter, defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from telemetra.operators import identity as J
from telemetra.operators import product as W
from telemetra.tables import Tables

from conftest import SF_SMALL

STEPS = ("page_view", "add_to_cart", "purchase")
NS_DAY = 86_400 * 10**9


@pytest.fixture(scope="module")
def skewed(spark):
    ue = Tables(spark, SF_SMALL, land=False).ue
    hot = F.col("event_time_unix_nano") % 5 < 2  # about 40 % of all rows
    return ue.withColumn("anonymous_id", F.when(hot, F.lit("hot-device")).otherwise(F.col("anonymous_id"))) \
             .withColumn("session_id", F.when(hot, F.lit("hot-session")).otherwise(F.col("session_id")))


@pytest.fixture(scope="module")
def rows(skewed):
    return [r.asDict() for r in skewed.collect()]


def test_hot_key_really_holds_a_third(rows):
    assert sum(r["anonymous_id"] == "hot-device" for r in rows) >= len(rows) // 3


def test_funnel_ordered(skewed, rows):
    w = 7 * NS_DAY
    by_p = defaultdict(list)
    for r in rows:
        if r["anonymous_id"] is not None and r["event"] in STEPS:
            by_p[r["anonymous_id"]].append((r["event"], r["event_time_unix_nano"]))
    reached = Counter()
    for evs in by_p.values():
        firsts = [t for e, t in evs if e == STEPS[0]]
        if not firsts:
            continue
        t1 = prev = min(firsts)
        reached[1] += 1
        for k, step in enumerate(STEPS[1:], start=2):
            cand = [t for e, t in evs if e == step and prev <= t <= t1 + w]
            if not cand:
                break
            prev = min(cand)
            reached[k] += 1
    got = {r.step: r.persons for r in W.funnel_ordered(skewed, STEPS, 7, by="anonymous_id").collect()}
    assert got == {k: reached[k] for k in range(1, len(STEPS) + 1)}


def test_cohort_retention(skewed, rows):
    days = defaultdict(set)
    for r in rows:
        if r["anonymous_id"] is not None:
            days[r["anonymous_id"]].add(r["event_time_unix_nano"] // NS_DAY)
    want = Counter()
    for ds in days.values():
        c = min(ds)
        for d in ds:
            want[(date(1970, 1, 1) + timedelta(days=c), d - c)] += 1
    got = {(r.cohort_day, r.day_offset): r.persons for r in W.cohort_retention(skewed, by="anonymous_id").collect()}
    assert got == dict(want)


def test_user_paths(skewed, rows):
    sessions = defaultdict(list)
    for r in rows:
        if r["session_id"] is not None and r["page"] is not None:
            sessions[r["session_id"]].append((r["event_time_unix_nano"], r["attributes"], r["page"]))
    want = Counter()
    for evs in sessions.values():
        evs.sort()
        for a, b in zip(evs, evs[1:]):
            want[(a[2], b[2])] += 1
    got = {(r.page, r.next_page): r.transitions for r in W.user_paths(skewed).collect()}
    assert got == dict(want)


def test_backfill_identity(skewed, rows):
    owner = {}
    for r in sorted(rows, key=lambda r: (r["event_time_unix_nano"], r["user_id"] or "")):
        if r["event"] == "identify" and r["anonymous_id"] is not None and r["user_id"] is not None:
            owner.setdefault(r["anonymous_id"], r["user_id"])
    want = Counter()
    for r in rows:
        uid = r["user_id"] if r["user_id"] is not None else owner.get(r["anonymous_id"])
        want[(r["event_time_unix_nano"], r["event"], uid, uid if uid is not None else r["anonymous_id"])] += 1
    got = Counter((r.event_time_unix_nano, r.event, r.user_id, r.person_id)
                  for r in J.backfill_identity(skewed).collect())
    assert got == want
