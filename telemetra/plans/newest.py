"""First rows of a day-partitioned table without reading all of it.

"The newest ten errors" on a table of years needs the last day or two, but a plain
``orderBy().limit()`` scans every partition. :func:`first_rows` walks the partition days
in the order asked for, newest first for a newest-first list, and stops once the days
passed hold enough rows; only those are sorted. The stretch it looks at doubles with every
step, so a table of D days costs at most log2(D) + 1 small counts, and no more than twice
the days needed are read. A count stops in each task as soon as it has the rows still
missing. Days without a matching row are walked over, so the list is the same as without
the walk; a filter that matches fewer than ``n`` rows ends in a full read, as it must.

The day column has to follow the sort column: rows of a later day sort before all rows of
an earlier one (as ``event_date`` does for the event time, rounding included). Rows without
a time are in the partition without a day, sort last and are walked to last.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Days = Sequence[date | None]


def walk(rows: DataFrame, n: int, days: Days, day_col: str = "event_date") -> DataFrame:
    """The part of ``rows`` in the first of ``days`` (in the order given) that hold ``n`` rows or more."""
    have, end, width = 0, 0, 1
    while have < n and end < len(days):
        block = days[end:end + width]
        have += rows.where(in_days(block, day_col)).limit(n - have).count()
        end, width = end + len(block), 2 * width
    return rows if end == len(days) else rows.where(in_days(days[:end], day_col))


def in_days(days: Days, day_col: str) -> Column:
    """Rows of an unbroken run of partition days; a range, so the predicate stays short."""
    some = [d for d in days if d is not None]
    cond = F.col(day_col).between(F.lit(min(some)), F.lit(max(some))) if some else F.lit(False)
    return cond | F.col(day_col).isNull() if len(some) < len(days) else cond


def first_rows(rows: DataFrame, n: int, order: Sequence[Column], days: Days | None = None,
               day_col: str = "event_date") -> DataFrame:
    """``rows.orderBy(*order).limit(n)``; with ``days`` (in the order of ``order``) over the days needed alone."""
    if days is not None:
        rows = walk(rows, n, days, day_col)
    return rows.orderBy(*order).limit(n)
