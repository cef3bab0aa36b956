"""Cross-device identity: the ``(anon, uid)`` edge table and what is built on it.

``identify`` events link a device (``anonymous.id``) to a hashed person key
(``user.id``). Every operator here is skew-aware:

* edges are de-duplicated on the full ``(anon, uid)`` pair first, so a person
  with a huge number of devices is spread over many tasks, and only then counted
  per person (a partial aggregate: one row per person per map task);
* events are **pre-aggregated per device before the join** (``stitch_events``),
  so the join input is one row per device however hot a device is;
* the per-device map used by ``backfill_identity`` has exactly one row per
  device; the join's strategy (broadcast vs. sort-merge with skew splitting) is
  chosen by AQE from the measured size, under the session's broadcast bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.plans.layout import bucket_of
from telemetra.settings import DEFAULT
from telemetra.functions.attrs import parse_attrs
from telemetra.operators.curate import ANONYMOUS_ID, IDENTIFY, USER_ID


def identity_edges(logs: DataFrame) -> DataFrame:
    """``DISTINCT (anon, uid)`` over ``identify`` events (NULLs kept, as in SQL DISTINCT)."""
    a = parse_attrs("log_attributes", [ANONYMOUS_ID, USER_ID])
    return (
        logs.where(F.col("body") == IDENTIFY)
        .select(a[ANONYMOUS_ID].alias("anon"), a[USER_ID].alias("uid"))
        .distinct()
    )


def devices_per_person(logs: DataFrame) -> DataFrame:
    """Per uid: number of distinct non-NULL devices."""
    return identity_edges(logs).groupBy("uid").agg(F.count("anon").alias("devices"))


def stitch_devices(logs: DataFrame, n: int = 10) -> DataFrame:
    """Persons with the most devices: ``devices DESC, uid`` top ``n``."""
    return (
        devices_per_person(logs)
        .orderBy(F.col("devices").desc(), F.col("uid").asc_nulls_last())
        .limit(n)
    )


def stitch_multi_device(logs: DataFrame, limit: int | None = None) -> DataFrame:
    """Persons seen on more than one device, exact over all persons.

    ``limit=n`` counts only among the top-``n`` list of :func:`stitch_devices`.
    """
    per = stitch_devices(logs, limit) if limit else devices_per_person(logs)
    return per.agg(
        F.count(F.lit(1)).alias("persons"),
        F.count_if(F.col("devices") > 1).alias("multi_device"),
    )


def stitch_events(logs: DataFrame, n: int = 5) -> DataFrame:
    """Non-``identify`` events per person, summed over all the person's devices.

    A device linked to two persons counts for both; events without a device or
    on a never-identified device are not counted.
    """
    anon = parse_attrs("log_attributes", [ANONYMOUS_ID])[ANONYMOUS_ID]
    per_device = (
        logs.where(F.col("body") != IDENTIFY)
        .select(anon.alias("anon"))
        .where(F.col("anon").isNotNull())
        .groupBy("anon").agg(F.count(F.lit(1)).alias("n"))
    )
    edges = identity_edges(logs).where(F.col("anon").isNotNull())
    return (
        per_device.join(edges, "anon")
        .groupBy("uid").agg(F.sum("n").alias("events"))
        .orderBy(F.col("events").desc(), F.col("uid").asc_nulls_last())
        .limit(n)
    )


def device_owner(ue: DataFrame) -> DataFrame:
    """One row per device: the uid of its earliest ``identify`` (ties: smallest uid)."""
    ident = ue.where((F.col("event") == IDENTIFY) & F.col("anonymous_id").isNotNull() & F.col("user_id").isNotNull())
    return ident.groupBy(F.col("anonymous_id").alias("_anon")).agg(
        F.min_by("user_id", F.struct("event_time_unix_nano", "user_id")).alias("_owner")
    )


def backfill_identity(ue: DataFrame, buckets: int = DEFAULT.buckets) -> DataFrame:
    """Curated rows with a device's later-known ``user_id`` filled in.

    ``user_id`` becomes the row's own user id, else the owner of its device;
    ``person_id`` is recomputed from it, and with it ``person_bucket`` where the frame
    has one (``buckets``: the count the table was written with), so that a read by
    person finds the rows under their new id. Rows are never dropped or duplicated
    (left join to a one-row-per-device table). Rows without a device cannot
    match and bypass the join, so NULL keys never pile up in one join task.
    """
    owner = device_owner(ue)
    keyed = ue.where(F.col("anonymous_id").isNotNull())
    joined = keyed.join(owner, keyed["anonymous_id"] == owner["_anon"], "left")
    user_id = F.coalesce(F.col("user_id"), F.col("_owner"))
    person = F.coalesce(user_id, F.col("anonymous_id"))
    cols = [
        user_id.alias("user_id") if c == "user_id"
        else person.alias("person_id") if c == "person_id"
        else bucket_of(person, buckets).cast(ue.schema[c].dataType).alias(c) if c == "person_bucket"
        else F.col(c)
        for c in ue.columns
    ]
    return joined.select(*cols).unionByName(ue.where(F.col("anonymous_id").isNull()))


def client_backend_journey(logs: DataFrame, traces: DataFrame, device: str | None = None) -> DataFrame:
    """Client log events and backend spans of the same device in one timeline.

    Spans carry the client's ``anonymous.id`` (propagated baggage). ``device``
    restricts to one device; without it the whole unified timeline is returned.
    """
    la = parse_attrs("log_attributes", [ANONYMOUS_ID])[ANONYMOUS_ID]
    sa = parse_attrs("span_attributes", [ANONYMOUS_ID])[ANONYMOUS_ID]
    client = logs.select(
        la.alias("anonymous_id"),
        F.col("time_unix_nano"),
        F.lit("client").alias("source"),
        F.col("body").alias("name"),
        F.col("service_name"),
        F.lit(None).cast("string").alias("trace_id"),
        F.col("severity_text").alias("status"),
    )
    backend = traces.select(
        sa.alias("anonymous_id"),
        F.col("start_time_unix_nano").alias("time_unix_nano"),
        F.lit("backend").alias("source"),
        F.col("name"),
        F.col("service_name"),
        F.col("trace_id"),
        F.when(F.col("status_code") == 2, F.lit("ERROR")).otherwise(F.lit("OK")).alias("status"),
    )
    out = client.unionByName(backend)
    if device is not None:
        out = out.where(F.col("anonymous_id") == device)
    return out


def with_person(rows: DataFrame, owner: DataFrame, known: Column | None = None) -> DataFrame:
    """``rows`` plus ``person_id``: the ``known`` person, else the owner of the row's ``anonymous_id``, else
    that device itself. Rows without a device bypass the join with ``owner`` (one row per device)."""
    known = F.lit(None).cast("string") if known is None else known
    held = rows.where(F.col("anonymous_id").isNotNull())
    owned = held.join(owner, held["anonymous_id"] == owner["_anon"], "left").withColumn(
        "person_id", F.coalesce(known, F.col("_owner"), F.col("anonymous_id"))).drop("_anon", "_owner")
    return owned.unionByName(rows.where(F.col("anonymous_id").isNull()).withColumn("person_id", known))


def person_journey(logs: DataFrame, traces: DataFrame, person_id: str | None = None) -> DataFrame:
    """Client events and backend spans of persons in one timeline, joined by two links.

    A trace belongs to the person of the earliest client event that names it (``logs.trace_id``, ties:
    smallest person). A span whose trace no client event names falls back to the device it carries.
    Devices are resolved to their owner on both sides (:func:`device_owner`: a later sign-in counts for
    earlier events). One row per event and span; ``person_id`` is NULL where neither link leads to
    anyone. With ``person_id`` only that person's rows, in time order.
    """
    a = parse_attrs("log_attributes", [ANONYMOUS_ID, USER_ID])
    events = logs.select(
        a[ANONYMOUS_ID].alias("anonymous_id"), a[USER_ID].alias("user_id"), "time_unix_nano", F.lit("client").alias("source"),
        F.col("body").alias("name"), "service_name", "trace_id", "span_id", F.col("severity_text").alias("status"))
    owner = device_owner(events.select("anonymous_id", "user_id", F.col("name").alias("event"),
                                       F.col("time_unix_nano").alias("event_time_unix_nano")))
    client = with_person(events, owner, F.col("user_id")).drop("user_id")
    named = client.where(F.col("trace_id").isNotNull() & F.col("person_id").isNotNull())
    link = named.groupBy(F.col("trace_id").alias("_trace")).agg(
        F.min_by("person_id", F.struct("time_unix_nano", "person_id")).alias("_person"))
    spans = traces.select(
        parse_attrs("span_attributes", [ANONYMOUS_ID])[ANONYMOUS_ID].alias("anonymous_id"),
        F.col("start_time_unix_nano").alias("time_unix_nano"), F.lit("backend").alias("source"), "name", "service_name",
        "trace_id", "span_id", F.when(F.col("status_code") == 2, F.lit("ERROR")).otherwise(F.lit("OK")).alias("status"))
    linked = spans.join(link, spans["trace_id"] == link["_trace"], "left").drop("_trace")
    backend = with_person(linked, owner, F.col("_person")).drop("_person")
    out = client.unionByName(backend)
    if person_id is None:
        return out
    return out.where(F.col("person_id") == person_id).orderBy(
        F.asc_nulls_last("time_unix_nano"), "source", F.asc_nulls_last("span_id"), "name")
