"""Attribute JSON access.

Attribute keys contain literal dots (``user.id``), so a dotted JSON path would
look for nested objects. Two forms are offered:

* :func:`parse_attrs` parses the JSON text **once** into a narrow struct holding
  only the requested keys (``from_json``). Use it whenever a query reads two or
  more keys; Catalyst additionally prunes unused struct fields.
* :func:`attr` reads a single key with a bracketed path.

Both return JSON strings as text, numbers and objects as their JSON text and
JSON ``null`` as SQL NULL.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def attrs_schema(keys: Iterable[str]) -> T.StructType:
    seen: list[str] = []
    for k in keys:
        if k not in seen:
            seen.append(k)
    return T.StructType([T.StructField(k, T.StringType(), True) for k in seen])


def parse_attrs(json_col: str | Column, keys: Iterable[str]) -> Column:
    """One parse of the attribute JSON into ``struct<key: string, ...>``."""
    return F.from_json(_col(json_col), attrs_schema(keys))


def attr(json_col: str | Column, key: str) -> Column:
    """A single attribute value by its literal key."""
    escaped = key.replace("\\", "\\\\").replace("'", "\\'")
    return F.get_json_object(_col(json_col), f"$['{escaped}']")
