"""Epoch-nanosecond and zone-less timestamp arithmetic.

All time values are UTC instants stored zone-less (``timestamp_ntz``); none of
these expressions depends on the session time zone.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

def epoch_ntz() -> Column:
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'")

NS_PER_DAY = 86_400 * 1_000_000_000


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ns_to_timestamp(ns: str | Column) -> Column:
    """Epoch-ns -> microsecond ``timestamp_ntz``, rounding (not truncating) the ns.

    The division is floating point and the result is rounded half-to-even, the
    same arithmetic as ``CAST(ns / 1000 AS BIGINT)`` in SQL engines where ``/``
    is float division.
    """
    micros = F.rint(_col(ns).cast("double") / F.lit(1000.0)).cast("long")
    return F.timestamp_add("MICROSECOND", micros, epoch_ntz())


def timestamp_to_micros(ts: str | Column) -> Column:
    """``timestamp_ntz`` -> epoch microseconds (zone independent)."""
    return F.timestamp_diff("MICROSECOND", epoch_ntz(), _col(ts))


def date_of_ns(ns: str | Column) -> Column:
    """Calendar date (UTC) of an epoch-ns instant.

    Exact: the day number is computed from a multiple of the day length, so the
    floating division is exact up to rounding and ``round`` recovers it.
    """
    c = _col(ns)
    day = F.lit(NS_PER_DAY)
    days = F.round((c - F.pmod(c, day)) / day).cast("int")
    return F.date_add(F.lit(date(1970, 1, 1)), days)


def ntz_literal(value: datetime) -> Column:
    return F.expr(f"timestamp_ntz'{value.isoformat(sep=' ')}'")


def ns_of(value: datetime) -> int:
    """Epoch-ns of a naive UTC datetime (exact, integer)."""
    delta = value - datetime(1970, 1, 1)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000_000 + delta.microseconds * 1_000
