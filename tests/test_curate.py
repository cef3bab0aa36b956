"""Curation rules: subject truth table, identity lift, ns rounding, key hashing."""

from datetime import datetime

from pyspark.sql import functions as F

from telemetra.functions.keys import hash_key, hash_key_py, normalize_key
from telemetra.functions.timecols import date_of_ns, ns_to_timestamp
from telemetra.operators.curate import curate
from telemetra.schemas import LOGS, USER_EVENT_COLUMNS


def logs_rows(spark, rows):
    full = [(i, 1_700_000_000_000_000_000 + i, b, s, "web", a) for i, (b, s, a) in enumerate(rows)]
    return spark.createDataFrame(full, LOGS)


def subjects(spark, rows):
    return [r.subject for r in curate(logs_rows(spark, rows)).orderBy("event_time_unix_nano").collect()]


def test_subject_truth_table(spark):
    rows = [
        ("page_view", "INFO", '{"app.subject":"errors"}'),          # override inside the set
        ("page_view", "INFO", '{"app.subject":"billing"}'),         # override outside -> other
        ("page_view", "INFO", '{"app.subject":""}'),                # empty override -> other
        ("page_view", None, "{}"),                                  # NULL severity, no attrs
        ("identify", "ERROR", "{}"),                                # ERROR wins over identify
        ("identify", "INFO", '{"gen_ai.system":"x"}'),              # ai wins over identify
        ("page_view", "INFO", '{"exception.message":"m"}'),         # message alone is activity
        ("page_view", "INFO", '{"exception.type":"T"}'),
        ("page_view", "INFO", '{"llm.model":"m"}'),
        ("page_view", "INFO", '{"audit.action":"login"}'),
        ("identify", "INFO", "{}"),
        (None, None, None),
    ]
    assert subjects(spark, rows) == [
        "errors", "other", "other", "activities", "errors", "ai_usage", "activities",
        "errors", "ai_usage", "traceability", "traceability", "activities",
    ]


def test_curated_columns_and_identity(spark):
    df = curate(logs_rows(spark, [("identify", "INFO", '{"user.id":"u1","anonymous.id":"d1","session.id":"s","page":"/"}'),
                                  ("page_view", "INFO", '{"anonymous.id":"d1","page":"/x","n":5}')]))
    assert df.columns == USER_EVENT_COLUMNS
    r = df.orderBy("event_time_unix_nano").collect()
    assert (r[0].user_id, r[0].person_id, r[0].session_id, r[0].page) == ("u1", "u1", "s", "/")
    assert (r[1].user_id, r[1].person_id, r[1].page) == (None, "d1", "/x")


def test_ns_rounding_is_half_even_and_zone_free(spark):
    df = spark.createDataFrame([(1700000000123456789,), (1700000000123456500,)], "t long")
    got = [r.ts for r in df.select(ns_to_timestamp("t").alias("ts")).collect()]
    assert got == [datetime(2023, 11, 14, 22, 13, 20, 123457), datetime(2023, 11, 14, 22, 13, 20, 123456)]


def test_date_of_ns_exact_at_midnight(spark):
    day = 86_400 * 10**9
    df = spark.createDataFrame([(19_000 * day - 1,), (19_000 * day,)], "t long")
    got = [str(r.d) for r in df.select(date_of_ns("t").alias("d")).collect()]
    assert got == ["2022-01-07", "2022-01-08"]  # day 19000 = 2022-01-08


def test_hash_key_golden(spark):
    got = spark.range(1).select(hash_key(F.lit("k"), "salt").alias("h")).first().h
    assert got == "bf6e27961dec28bf6290de5c796f277c" == hash_key_py("k", "salt")


def test_normalize_key(spark):
    df = spark.createDataFrame([(" A@X.com ",), ("a@x.com",), ("0044 (20) 7946-0958",), ("+44 20 7946 0958",), ("acct-7",)], "k string")
    got = [r.n for r in df.select(normalize_key("k").alias("n")).collect()]
    assert got == ["a@x.com", "a@x.com", "+442079460958", "+442079460958", "acct-7"]
    h = df.select(hash_key(normalize_key("k"), "salt").alias("h")).collect()
    assert h[0].h == h[1].h and h[2].h == h[3].h


def test_empty_logs(spark):
    from telemetra.operators import reports as R

    empty = spark.createDataFrame([], LOGS)
    assert curate(empty).count() == 0
    f = R.signup_funnel(empty).first()
    assert (f.starts, f.completes, f.conv) == (0, 0, 0.0)
    assert R.curation_lag(empty, curate(empty)).first().lag_seconds is None
