"""Look-ups by one value: spans of a trace through Bloom filters, a person through a raw key."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from telemetra.functions.keys import hash_key, normalize_key, normalize_key_py, person_of_key
from telemetra.operators import reports as R
from telemetra.plans import layout
from telemetra.schemas import TRACES

from test_plans import scans_of

DAY = 86_400 * 10**9
SPANS = 400_000  # more distinct ids in a file than a dictionary holds
START = 1_704_067_200_000_000_000  # 2024-01-01


@pytest.fixture(scope="module")
def traces(spark, tmp_path_factory):
    """Spans of four days, each trace on one, its id among all others; stored with the layout and without."""
    made = spark.range(SPANS).selectExpr(
        "sha2(cast(id div 4 as string), 256) AS trace_id", "concat('s', id) AS span_id", "concat('n', id % 50) AS name",
        "'web' AS service_name", "1 AS kind", f"{START} + id div 4 % 4 * {DAY} + id AS start_time_unix_nano",
        f"{START} + id div 4 % 4 * {DAY} + id + 5 AS end_time_unix_nano", "5L AS duration_time_unix_nano", "1 AS status_code", "'{}' AS span_attributes")
    path = str(tmp_path_factory.mktemp("traces"))
    layout.write_traces(made.select(*(F.col(f.name).cast(f.dataType) for f in TRACES.fields)), path)
    plain = str(tmp_path_factory.mktemp("plain"))
    made.withColumn("event_date", F.lit(None).cast("date")).repartition(4).write.mode("overwrite").parquet(plain)
    return layout.read_traces(spark, path), spark.read.schema(layout.TRACES_STORED).parquet(plain)


def rows_scanned(spark, df):
    """Rows that left the Parquet scan (twice, where a sort samples its input), and the rows of the result."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size())), rows
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_absent_and_present_traces_skip_row_groups(spark, traces):
    stored, plain = traces
    present, absent = (spark.range(1).select(F.sha2(F.lit(x), 256)).first()[0] for x in ("77", "no such trace"))
    assert rows_scanned(spark, R.trace_journey(stored, absent)) == (0, [])
    read, rows = rows_scanned(spark, R.trace_journey(stored, present))
    assert [r.span_id for r in rows] == ["s308", "s309", "s310", "s311"]
    assert read <= SPANS / 2                                                   # one day's file, twice
    assert rows_scanned(spark, R.trace_journey(plain, absent))[0] >= SPANS    # without the filters all is read


def test_a_time_range_prunes_days_and_is_inclusive(spark, traces):
    stored, _ = traces
    trace = spark.range(1).select(F.sha2(F.lit("77"), 256)).first()[0]
    df = R.trace_journey(stored, trace, datetime(2024, 1, 2), datetime(2024, 1, 3, 12))
    scans = scans_of(df)
    assert scans and all("2024-01-02" in s["PartitionFilters"] and "2024-01-03" in s["PartitionFilters"] for s in scans)
    assert [r.span_id for r in df.collect()] == ["s308", "s309", "s310", "s311"]
    assert R.trace_journey(stored, trace, datetime(2024, 1, 3)).count() == 0
    first, at = spark.range(1).select(F.sha2(F.lit("0"), 256)).first()[0], datetime(2024, 1, 1)
    assert [r.span_id for r in R.trace_journey(stored, first, at, at).collect()] == ["s0"]


def test_one_key_is_hashed_as_a_column_is(spark):
    raw = [" User3@Example.COM ", "0049 (30) 123-4", "+49 30 1234", " plain ", "", "12a", "ÄB@x.de", "  "]
    df = spark.createDataFrame([(k,) for k in raw], "k string")
    for kind in ("auto", "email", "phone"):
        got = [tuple(r) for r in df.select(normalize_key("k", kind), hash_key(normalize_key("k", kind), "s")).collect()]
        assert got == [(normalize_key_py(k, kind), person_of_key(k, "s", kind)) for k in raw]
    with pytest.raises(ValueError):
        normalize_key_py("x", "other")
