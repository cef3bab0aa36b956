"""Upkeep: retention plan/preview/sweep, compaction, history expiry, sizes.

The retention *plan* is plain driver-side configuration (table, time column,
cutoff) built once and consumed by both the read-only preview and the sweep, so
"what would be deleted" and "what is deleted" cannot drift apart. The preview
and the size report are single-pass aggregates per table. The storage jobs
(sweep, compaction, expiry) live in :mod:`telemetra.plans.maintenance` because they
rewrite files.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.functions.timecols import ns_of

# The swept tables and their epoch-ns time columns.
RETENTION_TABLES = (
    ("logs", "time_unix_nano"),
    ("traces", "start_time_unix_nano"),
    ("metrics_gauge", "time_unix_nano"),
    ("metrics_sum", "time_unix_nano"),
    ("user_events", "event_time_unix_nano"),
)


def retention_plan(days: int | None, as_of: datetime,
                   tables: tuple[tuple[str, str], ...] = RETENTION_TABLES) -> list[tuple[str, str, int]]:
    """One rule per table: its name, its time column and the first nanosecond kept.

    Retention is off (no rules) unless the window is a positive number of days.
    """
    keep = timedelta(days=max(days or 0, 0))
    first_kept = ns_of(as_of - keep)
    return [(*rule, first_kept) for rule in tables if keep]


def retention_preview(tables: Mapping[str, DataFrame], plan: list[tuple[str, str, int]]) -> DataFrame | None:
    """Per existing table: rows the sweep would delete (time < cutoff) and total rows.

    NULL times never compare below the cutoff, so such rows are never swept.
    Tables absent from ``tables`` are skipped. Read-only.
    """
    parts = [
        tables[t].agg(
            F.lit(t).alias("table_name"),
            F.count_if(F.col(c) < F.lit(cutoff)).alias("expired"),
            F.count(F.lit(1)).alias("total"),
        )
        for t, c, cutoff in plan
        if t in tables
    ]
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def table_sizes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table (after upkeep, for visibility)."""
    parts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
