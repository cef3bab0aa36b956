"""Column expressions shared by the operators (all JVM-side built-ins)."""

from telemetra.functions.attrs import attr, parse_attrs
from telemetra.functions.keys import hash_key, normalize_key
from telemetra.functions.timecols import date_of_ns, epoch_ntz, ns_to_timestamp, timestamp_to_micros

__all__ = [
    "attr",
    "date_of_ns",
    "epoch_ntz",
    "hash_key",
    "normalize_key",
    "ns_to_timestamp",
    "parse_attrs",
    "timestamp_to_micros",
]
