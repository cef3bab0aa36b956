"""Physical-plan summary of every registered read query (jobs are skipped).

usage: python tools/plan_report.py [sf_dir] > PLANS.md

Each query is executed once (so AQE has settled its final plan) and the final
plan is summarised: shuffles, broadcast / sort-merge joins, scans with the
columns they read, the partition filters and the filters pushed into Parquet.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from telemetra.plans.session import build_session  # noqa: E402
from telemetra.registry import JOBS, QUERIES  # noqa: E402


def _field(line: str, name: str) -> str:
    m = re.search(name + r": (\[[^\]]*\]|struct<\S*)", line)
    return m.group(1) if m else ""


def final_plan(plan: str) -> str:
    """The ``== Final Plan ==`` part of an adaptive plan (the initial plan is not run)."""
    if "== Final Plan ==" in plan:
        plan = plan.split("== Final Plan ==", 1)[1].split("== Initial Plan ==", 1)[0]
    return plan


def summarise(plan: str) -> dict:
    plan = final_plan(plan)
    scans = []
    for line in plan.splitlines():
        if "FileScan parquet" not in line:
            continue
        table = re.search(r"InMemoryFileIndex\([^)]*\)\[[^\]]*/([^/\],]+)[,\]]", line)
        scans.append({
            "table": table.group(1) if table else "?",
            "read": _field(line, "ReadSchema"),
            "partition_filters": _field(line, "PartitionFilters"),
            "pushed": _field(line, "PushedFilters"),
        })
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)),
        "broadcast_joins": plan.count("BroadcastHashJoin"),
        "sort_merge_joins": plan.count("SortMergeJoin"),
        "reused": plan.count("ReusedExchange"),
        "python": any(k in plan for k in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas")),
        "scans": scans,
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    # long scan fields (read schema, filters) are printed whole, not cut at 100 characters
    spark = build_session(app="telemetra-plans", extra={"spark.sql.maxMetadataStringLength": "100000"})
    print(f"# Physical plans of the registered read queries ({os.path.basename(sf_dir.rstrip('/'))}, final AQE plans)\n")
    print("Generated by `tools/plan_report.py`. `read` is the Parquet `ReadSchema` (pruned columns);")
    print("`partition` the `PartitionFilters`; `pushed` the `PushedFilters`. Jobs are not listed.\n")
    print("| query | shuffles | bcast joins | smj | reused | scans: table read / partition / pushed |")
    print("| --- | --- | --- | --- | --- | --- |")
    for name, (build, _) in QUERIES.items():
        if name in JOBS:
            continue
        df = build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        s = summarise(df._jdf.queryExecution().executedPlan().toString())
        scans = "<br>".join(
            f"{x['table']}: `{x['read']}`" + (f" / `{x['partition_filters']}`" if x["partition_filters"] not in ("", "[]") else "")
            + (f" / `{x['pushed']}`" if x["pushed"] not in ("", "[]") else "")
            for x in s["scans"]
        )
        flag = " (python!)" if s["python"] else ""
        print(f"| {name}{flag} | {s['shuffles']} | {s['broadcast_joins']} | {s['sort_merge_joins']} | {s['reused']} | {scans} |")
    spark.stop()


if __name__ == "__main__":
    main()
