"""Plan checks: no Python in any plan, pruning reaches the scan, bounded top-k."""

import re

import pytest

from telemetra.registry import QUERIES

from conftest import SF_SMALL


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans_of(df):
    """The Parquet scans of a plan, each as its properties."""
    full = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scans = [part for part in re.split(r"\n\(\d+\) ", full) if part.startswith("Scan parquet")]
    return [NO_FILTERS | {
        k: v for k, _, v in (line.partition(": ") for line in s.splitlines())} for s in scans]


NO_FILTERS = {"PartitionFilters": "", "PushedFilters": "", "ReadSchema": ""}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_udf_in_plan(spark, name):
    p = plan_of(QUERIES[name][0](spark, SF_SMALL))
    assert not any(n in p for n in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "MapInArrow"))


def test_person_read_prunes_to_one_bucket(spark):
    scans = scans_of(QUERIES["user_timeline"][0](spark, SF_SMALL))
    assert scans and all(re.search(r"person_bucket#\d+ = \d+", s["PartitionFilters"]) for s in scans)
    assert all("EqualTo(person_id" in s["PushedFilters"] for s in scans)


def test_subject_read_prunes_partition(spark):
    scans = scans_of(QUERIES["subject_recent"][0](spark, SF_SMALL))
    assert scans and all(re.search(r"subject#\d+ = errors", s["PartitionFilters"]) for s in scans)


def test_topk_is_take_ordered(spark):
    p = plan_of(QUERIES["recent_errors"][0](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p


def test_projection_pruned_at_scan(spark):
    assert [s["ReadSchema"] for s in scans_of(QUERIES["count_logs"][0](spark, SF_SMALL))] == ["struct<>"]
    assert [s["ReadSchema"] for s in scans_of(QUERIES["error_count"][0](spark, SF_SMALL))] == ["struct<severity_text:string>"]


def test_cohort_retention_needs_no_window_and_two_shuffles(spark):
    from tools.plan_report import final_plan

    df = QUERIES["cohort_retention"][0](spark, SF_SMALL)
    df.collect()  # settle the adaptive plan
    p = final_plan(plan_of(df))
    assert "Window" not in p
    assert len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)", p)) <= 2
