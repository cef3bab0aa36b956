"""Product analytics: ordered funnels, cohort retention, page paths, daily rollups.

Design for hot keys (one person or session holding a large share of rows):

* ``funnel_ordered`` never puts a person's whole history in one window: each
  step is a join of that step's events with a one-row-per-person table of the
  previous step, then a ``min`` per person (partial aggregation). AQE splits a
  skewed join partition or broadcasts the per-person side when it is small.
* ``cohort_retention`` collects each person's set of active days (a partial
  aggregate whose state is bounded by the days the data spans, however hot the
  person), so it needs two shuffles and no window.
* ``user_paths`` pairs each event with the next one of its session; sessions are
  cut into slices of time, so a hot one is as many tasks as it lasts slices.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemetra.functions.timecols import NS_PER_DAY, date_of_ns


def funnel_ordered(ue: DataFrame, steps: Sequence[str], window_days: float = 7, by: str = "person_id",
                   time_col: str = "event_time_unix_nano") -> DataFrame:
    """Persons (or devices, ``by="anonymous_id"``) reaching each step in order.

    Step 1 is the person's first ``steps[0]`` event at ``t1``. Step k is the
    first ``steps[k-1]`` event at or after step k-1's time and no later than
    ``t1 + window`` (inclusive). Output: ``step, event, persons``.

    Every step's persons are counted and carried to the next step from one shuffle: the count
    is of a column the next step needs too, so both plans share the exchange and the events
    of a step are read once.
    """
    if not steps:
        raise ValueError("a funnel needs at least one step")
    window_ns = int(window_days * NS_PER_DAY)
    base = ue.where(F.col(by).isNotNull() & F.col("event").isin(*steps)).select(
        F.col(by).alias("_p"), F.col("event").alias("_e"), F.col(time_col).alias("_t")
    )
    reached = (
        base.where(F.col("_e") == steps[0])
        .groupBy("_p").agg(F.min("_t").alias("_t1"))
        .withColumn("_prev", F.col("_t1"))
    )
    counts = [reached.agg(F.count("_t1").alias("persons")).select(F.lit(1).alias("step"), F.lit(steps[0]).alias("event"), "persons")]
    for k, name in enumerate(steps[1:], start=2):
        cand = base.where(F.col("_e") == name).select("_p", "_t")
        reached = (
            cand.join(reached.select("_p", "_t1", "_prev"), "_p")
            .where((F.col("_t") >= F.col("_prev")) & (F.col("_t") <= F.col("_t1") + F.lit(window_ns)))
            .groupBy("_p", "_t1").agg(F.min("_t").alias("_prev"))
        )
        counts.append(reached.agg(F.count("_prev").alias("persons")).select(F.lit(k).alias("step"), F.lit(name).alias("event"), "persons"))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def cohort_retention(ue: DataFrame, by: str = "person_id", time_col: str = "event_time_unix_nano") -> DataFrame:
    """First-seen day x day offset -> number of active persons.

    ``cohort_day`` is the person's first active UTC day; a person is active at
    ``day_offset`` d when they have any event on ``cohort_day + d``.
    """
    # one row per person: the set of active days (partial aggregation; bounded by
    # the days the data spans however hot the person), then one row per active day
    per_person = (
        ue.where(F.col(by).isNotNull())
        .groupBy(F.col(by).alias("_p"))
        .agg(F.collect_set(date_of_ns(time_col)).alias("_days"))
        .select(F.array_min("_days").alias("cohort_day"), F.explode("_days").alias("_d"))
    )
    return per_person.groupBy("cohort_day", F.datediff("_d", "cohort_day").alias("day_offset")).agg(
        F.count(F.lit(1)).alias("persons"))


def active_days(ue: DataFrame, by: str = "person_id", time_col: str = "event_time_unix_nano") -> DataFrame:
    """Per person the days they were active on, as a bitmap: a state of 4 KB per person and 89 years
    (``era``), however many events or days. Bitmaps of batches are merged by :func:`merge_days`."""
    days = ue.where(F.col(by).isNotNull() & F.col(time_col).isNotNull()).select(
        F.col(by).alias("person"), F.datediff(date_of_ns(time_col), F.lit(date(1970, 1, 1))).alias("day"))
    return days.groupBy("person", F.bitmap_bucket_number("day").alias("era")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("day")).alias("days"), F.min("day").alias("first"), F.max("day").alias("last"))


def merge_days(days: DataFrame) -> DataFrame:
    """One row per person and era of the rows of :func:`active_days` of any number of batches."""
    return days.groupBy("person", "era").agg(
        F.bitmap_or_agg("days").alias("days"), F.min("first").alias("first"), F.max("last").alias("last"))


def retention_of_days(days: DataFrame) -> DataFrame:
    """:func:`cohort_retention` of merged day bitmaps."""
    # the bit of a day: position and byte as bitmap_construct_agg sets them
    bits = F.hex("days")

    def is_set(day):
        at = F.bitmap_bit_position(day).cast("int")
        byte = F.conv(F.substring(bits, F.floor(at / 8).cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1

    born = F.min("first").over(Window.partitionBy("person"))  # a row per era
    active = days.withColumn("born", born).select("born", F.explode(F.filter(F.sequence("first", "last"), is_set)).alias("day"))
    return active.groupBy(F.date_add(F.lit(date(1970, 1, 1)), F.col("born")).alias("cohort_day"),
                          (F.col("day") - F.col("born")).cast("int").alias("day_offset")).agg(F.count(F.lit(1)).alias("persons"))


SLICE_NS = 600 * 1_000_000_000


def user_paths(ue: DataFrame, session_col: str = "session_id", time_col: str = "event_time_unix_nano",
               slice_ns: int = SLICE_NS) -> DataFrame:
    """Page -> next page transition counts within sessions.

    Events without a session or page are ignored; the order inside a session is
    time, then the raw attribute text as a deterministic tie-breaker.

    A session is cut into slices of ``slice_ns`` by the clock. Inside a slice the next page is
    a window ``lead``; a slice's last event takes the first page of the session's next slice
    that has events, looked up in a table of one row per (session, slice).
    """
    at = F.col(time_col)
    ev = ue.where(F.col(session_col).isNotNull() & F.col("page").isNotNull()).select(
        F.col(session_col).alias("_s"), at.alias("_t"), F.col("attributes").alias("_k"), "page",
        (at - F.pmod(at, F.lit(slice_ns))).alias("_sl"))
    inside = Window.partitionBy("_s", "_sl").orderBy("_t", "_k")
    local = ev.select("_s", "_sl", "page", F.lead("page").over(inside).alias("next_page"))
    firsts = ev.groupBy("_s", "_sl").agg(F.min_by("page", F.struct("_t", "_k")).alias("_first"))
    carry = firsts.select("_s", "_sl", F.lead("_first").over(Window.partitionBy("_s").orderBy("_sl")).alias("_carry"))
    counts = local.where(F.col("next_page").isNotNull()).groupBy("page", "next_page").agg(F.count(F.lit(1)).alias("n"))
    last = local.where(F.col("next_page").isNull())
    met = last.join(carry, last["_s"].eqNullSafe(carry["_s"]) & last["_sl"].eqNullSafe(carry["_sl"])).where(
        F.col("_carry").isNotNull())
    across = met.groupBy("page", F.col("_carry").alias("next_page")).agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(across).groupBy("page", "next_page").agg(F.sum("n").alias("transitions"))


def rollup_daily(ue: DataFrame, with_page: bool = True) -> DataFrame:
    """Pre-aggregated UTC day x event (x page) counts for long-range dashboards."""
    keys = [date_of_ns("event_time_unix_nano").alias("event_date"), F.col("event")]
    if with_page:
        keys.append(F.col("page"))
    return ue.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"))
