"""Snapshots, time travel and the change feed over row-versioned tables.

A versioned table carries ``begin_snapshot`` (commit that added the row) and
``end_snapshot`` (commit that deleted it, NULL = live); ``commits`` maps
snapshot ids to times. Reading a version is a filter, counting versions is one
aggregate pass, and the change feed is one scan whose rows are tagged by
``explode`` (a row inserted and deleted inside the range yields both changes).
Scalar inputs (the resolved snapshot, the default range) are scalar subqueries,
evaluated once by Spark, never collected by the caller.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.functions.timecols import ntz_literal

VERSION_COLS = ("begin_snapshot", "end_snapshot")


def live_at(snapshot: Column | int) -> Column:
    s = snapshot if isinstance(snapshot, Column) else F.lit(snapshot)
    return (F.col("begin_snapshot") <= s) & (F.col("end_snapshot").isNull() | (F.col("end_snapshot") > s))


def snapshots(commits: DataFrame, n: int = 10) -> DataFrame:
    return commits.orderBy(F.col("snapshot_id").desc()).limit(n).select("snapshot_id", "snapshot_time")


def resolve_snapshot(commits: DataFrame, at: datetime) -> Column:
    """Newest snapshot committed at or before ``at`` (NULL if ``at`` predates history)."""
    return commits.where(F.col("snapshot_time") <= ntz_literal(at)).select(F.max("snapshot_id")).scalar()


def as_of(table: DataFrame, snapshot: int | Column) -> DataFrame:
    """The table as it was at ``snapshot`` (version columns dropped)."""
    return table.where(live_at(snapshot)).drop(*VERSION_COLS)


def as_of_time(table: DataFrame, commits: DataFrame, at: datetime) -> DataFrame:
    return as_of(table, resolve_snapshot(commits, at))


def as_of_count(table: DataFrame, commits: DataFrame, at: datetime) -> DataFrame:
    """Rows now, rows at ``at`` and the difference, in one pass.

    If ``at`` predates the first snapshot, ``snapshot_id``/``past``/``new_since``
    are NULL and ``earliest`` tells where history starts.
    """
    s = resolve_snapshot(commits, at)
    earliest = commits.select(F.min("snapshot_time")).scalar()
    counts = table.agg(
        F.count_if(F.col("end_snapshot").isNull()).alias("now"),
        F.count_if(live_at(s)).alias("_past"),
    )
    past = F.when(s.isNotNull(), F.col("_past"))
    return counts.select(
        "now",
        past.alias("past"),
        (F.col("now") - past).alias("new_since"),
        s.alias("snapshot_id"),
        earliest.alias("earliest"),
    )


def _range(commits: DataFrame, start: int | None, end: int | None) -> tuple[Column, Column, Column]:
    lo = F.lit(start) if start is not None else commits.select(F.min("snapshot_id")).scalar()
    hi = F.lit(end) if end is not None else commits.select(F.max("snapshot_id")).scalar()
    enough = commits.select(F.count(F.lit(1))).scalar() >= 2
    return lo, hi, enough


def table_changes(table: DataFrame, commits: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Change rows in snapshots ``[start, end]`` inclusive: base columns + ``change_type``.

    Defaults are the first and last snapshot; with fewer than two snapshots the
    feed is empty.
    """
    lo, hi, enough = _range(commits, start, end)
    ins = F.when(F.col("begin_snapshot").between(lo, hi), F.lit("insert"))
    dele = F.when(F.col("end_snapshot").between(lo, hi), F.lit("delete"))
    base = [c for c in table.columns if c not in VERSION_COLS]
    return (
        table.where(enough & (F.col("begin_snapshot").between(lo, hi) | F.col("end_snapshot").between(lo, hi)))
        .select(*base, *VERSION_COLS, F.explode(F.array(ins, dele)).alias("change_type"))
        .where(F.col("change_type").isNotNull())
    )


def changes(table: DataFrame, commits: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Per ``change_type`` counts in ``[start, end]``."""
    feed = table_changes(table.select(*VERSION_COLS), commits, start, end)
    return feed.groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


def expire(table: DataFrame, horizon: int | Column) -> DataFrame:
    """Row versions still needed after expiring history up to ``horizon``.

    Versions deleted at or before the horizon are dropped; live rows and rows
    deleted later are kept (time travel to snapshots before the horizon ends).
    """
    h = horizon if isinstance(horizon, Column) else F.lit(horizon)
    return table.where(F.col("end_snapshot").isNull() | (F.col("end_snapshot") > h))
