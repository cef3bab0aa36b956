"""The telemetry tables of one data folder, derived from its ``events``.

``logs``, ``traces``, ``gauge`` and ``sums`` play the landed raw tables, ``ue``
the curated ``user_events`` table, ``logs_v`` the row-versioned log and
``commits`` its commit table. Each is built once by Spark from ``events`` and
written with its physical layout (day partitions; subject / day / person bucket
for the curated table) under the shared job folder, then read back, so every
query scans a laid-out table with partition pruning instead of re-deriving it.
With ``land=False`` they are lazy projections of ``events`` instead.
"""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from telemetra.operators.curate import curate
from telemetra.plans import fs, layout
from telemetra.schemas import USER_EVENT_COLUMNS
from telemetra.schemas import struct, L, NTZ, S, D
from telemetra.settings import DEFAULT, Settings
from telemetra.sources import fixtures

EVENTS = struct(
    ("event_id", L), ("ts", NTZ), ("user_id", L), ("event_type", S), ("value", D), ("props", S),
)


class Tables:
    LAYOUT_VERSION = "3"

    def __init__(self, spark: SparkSession, sf_dir: str, settings: Settings = DEFAULT, land: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.settings = settings
        self.land = land

    def _key(self, name: str) -> str:
        src, s = f"{self.sf_dir}/events.parquet", self.settings
        shape = [s.buckets, s.day_level] if name == "user_events" else []
        return "|".join([src, fs.stat_key(self.spark, src), repr([s.salt, s.subject_attr, *shape]), name, self.LAYOUT_VERSION])

    def path(self, name: str) -> str:
        """Where a landed table is stored."""
        return layout.landed_path(self.spark, self._key(name), name)

    def days(self, name: str, *below: str) -> list | None:
        """Partition days of a landed table, newest first (``below``: folders above the day level)."""
        return layout.partition_days(self.spark, "/".join([self.path(name), *below])) if self.land else None

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read
        if schema is not None:
            reader = reader.schema(schema)
        return reader.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events", EVENTS)

    @cached_property
    def logs_lazy(self) -> DataFrame:
        return fixtures.logs_from_events(self.events, self.settings.salt, self.settings.subject_attr)

    @cached_property
    def logs(self) -> DataFrame:
        if not self.land:
            return self.logs_lazy
        return layout.materialized(self.spark, self._key("logs"), "logs", lambda: self.logs_lazy,
                                   layout.write_raw_logs, layout.read_raw_logs)

    @cached_property
    def traces(self) -> DataFrame:
        if not self.land:
            return fixtures.traces_from_events(self.events)
        return layout.materialized(self.spark, self._key("traces"), "traces",
                                   lambda: fixtures.traces_from_events(self.events),
                                   layout.write_traces, layout.read_traces)

    @cached_property
    def gauge(self) -> DataFrame:
        if not self.land:
            return fixtures.gauge_from_events(self.events)
        return layout.materialized(self.spark, self._key("metrics_gauge"), "metrics_gauge",
                                   lambda: fixtures.gauge_from_events(self.events),
                                   layout.write_metrics, layout.read_metrics)

    @cached_property
    def sums(self) -> DataFrame:
        if not self.land:
            return fixtures.sum_from_events(self.events)
        return layout.materialized(self.spark, self._key("metrics_sum"), "metrics_sum",
                                   lambda: fixtures.sum_from_events(self.events),
                                   layout.write_metrics, layout.read_metrics)

    @cached_property
    def logs_v_lazy(self) -> DataFrame:
        return fixtures.versioned_logs(self.events, self.settings.salt, self.settings.subject_attr)

    @cached_property
    def logs_v(self) -> DataFrame:
        """The row-versioned log, stored with the raw layout (day partitions)."""
        if not self.land:
            return self.logs_v_lazy
        return layout.materialized(self.spark, self._key("logs_v"), "logs_v", lambda: self.logs_v_lazy,
                                   layout.write_raw_logs, layout.read_versioned_logs)

    @cached_property
    def commits(self) -> DataFrame:
        """The commit table, landed once: history queries read a tiny table, never
        a scan of the versioned log."""
        if not self.land:
            return fixtures.commits_from_versions(self.logs_v_lazy)
        return layout.materialized(self.spark, self._key("commits"), "commits",
                                   lambda: fixtures.commits_from_versions(self.logs_v),
                                   layout.write_commits, layout.read_commits)

    @cached_property
    def ue(self) -> DataFrame:
        if not self.land:
            return curate(self.logs, self.settings.subject_attr)
        logs, st = self.logs, self.settings

        def write(df: DataFrame, path: str) -> None:
            layout.write_curated(df, path, st.buckets, day_level=st.day_level)

        return layout.materialized(
            self.spark, self._key("user_events"), "user_events",
            lambda: curate(logs, st.subject_attr), write, layout.read_curated)

    @cached_property
    def by_day(self) -> Tables:
        """The same tables with a day level in the curated layout, and fewer buckets below it."""
        return Tables(self.spark, self.sf_dir, replace(self.settings, day_level=True, buckets=4), self.land)

    @property
    def ue_columns(self) -> DataFrame:
        """The curated table with exactly its 12 columns (layout columns dropped)."""
        return self.ue.select(*USER_EVENT_COLUMNS)

    def by_name(self) -> dict[str, tuple[DataFrame, str]]:
        """Retention-relevant tables with their epoch-ns time column."""
        return {
            "logs": (self.logs, "time_unix_nano"),
            "traces": (self.traces, "start_time_unix_nano"),
            "metrics_gauge": (self.gauge, "time_unix_nano"),
            "metrics_sum": (self.sums, "time_unix_nano"),
            "user_events": (self.ue, "event_time_unix_nano"),
        }
