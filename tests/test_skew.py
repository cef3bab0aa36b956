"""The one plan of each skew-safe operator, against numpy and a plain window."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from telemetra.operators.product import user_paths
from telemetra.operators.quantile import percentile_exact
from telemetra.tables import Tables

from conftest import SF_SMALL


def as_set(df):
    return sorted(tuple(r) for r in df.collect())


def test_percentile_equals_numpy(spark):
    tr = Tables(spark, SF_SMALL, land=False).traces.select("name", "duration_time_unix_nano")
    rows = tr.collect()
    for q in (0.0, 0.25, 0.95, 1.0):
        got = {r.name: r.q for r in percentile_exact(tr, ["name"], "duration_time_unix_nano", q).collect()}
        assert set(got) == {r.name for r in rows}
        for name in got:
            assert np.isclose(got[name], np.quantile([r[1] for r in rows if r.name == name], q), rtol=1e-12)
    hot = percentile_exact(tr.withColumn("g", F.lit("all")), ["g"], "duration_time_unix_nano", 0.95).first().q
    assert np.isclose(hot, np.quantile([r[1] for r in rows], 0.95), rtol=1e-12)


def test_percentile_null_group_and_values(spark):
    df = spark.createDataFrame([("a", 5), ("a", None), ("b", 1), ("b", 1), ("b", 3), (None, 7), ("c", None)], "g string, v long")
    out = percentile_exact(df, ["g"], "v", 0.5, extra=[F.count(F.lit(1)).alias("n")])
    assert out.columns == ["g", "q", "n"]
    assert {r.g: (r.q, r.n) for r in out.collect()} == {"a": (5.0, 2), "b": (1.0, 3), None: (7.0, 1), "c": (None, 1)}


def test_user_paths_equal_a_window(spark):
    ue = Tables(spark, SF_SMALL, land=False).ue
    for df in (ue, ue.withColumn("session_id", F.lit("one"))):  # the second: one session holds every event
        ev = df.where("session_id IS NOT NULL AND page IS NOT NULL")
        w = Window.partitionBy("session_id").orderBy("event_time_unix_nano", "attributes")
        want = (ev.select("page", F.lead("page").over(w).alias("next_page")).where("next_page IS NOT NULL")
                .groupBy("page", "next_page").agg(F.count(F.lit(1))))
        for width in (1, 10**9, 10**16):       # every event a slice of its own, and all in one
            assert as_set(user_paths(df, slice_ns=width)) == as_set(want)
        assert as_set(user_paths(df)) == as_set(want)


def test_percentile_of_one_hot_group_sorts_only_a_little(spark):
    # a third of the rows in one group, most values close together, some far away
    df = spark.range(60_000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('g', id % 50)) AS g",
        "if(id % 101 = 0, 1000000000000 + id, 1000 + (id * 7919) % 50021) AS v")
    rows = {}
    for r in df.collect():
        rows.setdefault(r.g, []).append(r.v)
    for q in (0.0, 0.5, 0.95, 0.99, 1.0):
        got = {r.g: r.q for r in percentile_exact(df, ["g"], "v", q).collect()}
        assert got.keys() == rows.keys()
        assert all(np.isclose(got[g], np.quantile(v, q), rtol=1e-12) for g, v in rows.items())
    exact = {r.g: r.q for r in df.groupBy("g").agg(F.expr("percentile(v, 0.95)").alias("q")).collect()}
    assert {r.g: r.q for r in percentile_exact(df, ["g"], "v", 0.95).collect()} == exact


def test_percentile_of_any_stretch_width(spark, monkeypatch):
    from telemetra.operators import quantile

    df = spark.range(5_000).selectExpr("'a' AS g", "(id * 37) % 4999 - 2000 AS v")
    for q in (0.3, 0.4, 0.95):                 # below, at and above zero
        want = np.quantile([r.v for r in df.collect()], q)
        for per in (1, 7, 256):
            monkeypatch.setattr(quantile, "PER_DOUBLING", per)
            assert np.isclose(percentile_exact(df, ["g"], "v", q).first().q, want, rtol=1e-12)


def test_stretches_are_in_the_order_of_the_values(spark):
    from telemetra.operators.quantile import _stretch

    made = [float(x) for x in (0.0, 5e-324, 1e-300, 1.0, 1 + 2**-52, 255.0, 256.0, 1e18, 1.7e308, float("inf"))]
    made = sorted([*made, *(-x for x in made)])
    got = spark.createDataFrame([(x,) for x in made], "v double").select("v", _stretch(F.col("v")).alias("s")).orderBy("v").collect()
    assert [r.s for r in got] == sorted(r.s for r in got) and len({r.s for r in got}) > 12


def test_percentile_of_floats_ignores_nan(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.4), ("a", float("nan")), ("a", -2.5), ("b", float("nan"))], "g string, v double")
    got = {r.g: r.q for r in percentile_exact(df, ["g"], "v", 0.5).collect()}
    assert got == {"a": 0.1, "b": None}


def test_no_checkpoint_in_any_percentile_plan(spark):
    tr = Tables(spark, SF_SMALL, land=False).traces
    plan = percentile_exact(tr, ["name"], "duration_time_unix_nano", 0.95)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "ExistingRDD" not in plan


def test_a_funnel_reads_each_step_once(spark):
    from telemetra.operators.product import funnel_ordered
    from tools.plan_report import final_plan

    df = funnel_ordered(Tables(spark, SF_SMALL).ue, ("page_view", "add_to_cart", "purchase", "exception"), 7, by="anonymous_id")
    df.collect()
    assert final_plan(df._jdf.queryExecution().executedPlan().toString()).count("FileScan parquet") <= 4
