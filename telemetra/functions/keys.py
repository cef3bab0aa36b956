"""Pseudonymous person keys: normalise a raw key, then salt and hash it."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_key(raw: str | Column, salt: str) -> Column:
    """First 32 hex chars of ``sha256(salt || raw)``."""
    return F.substring(F.sha2(F.concat(F.lit(salt), _col(raw)), 256), 1, 32)


def hash_key_py(raw: str, salt: str) -> str:
    """Driver-side form of :func:`hash_key` for turning one lookup key into a literal."""
    return hashlib.sha256((salt + raw).encode()).hexdigest()[:32]


def normalize_key_py(raw: str, kind: str = "auto") -> str:
    """Driver-side form of :func:`normalize_key`, for one key."""
    c = raw.strip(" ")
    if kind == "email" or (kind == "auto" and "@" in c):
        return c.lower()
    if kind == "phone" or (kind == "auto" and re.fullmatch(r"[+0-9 ().-]+", c) and re.search("[0-9]", c)):
        return "+" + re.sub("[^0-9]", "", re.sub("^00", "", c))
    if kind != "auto":
        raise ValueError(f"unknown key kind {kind!r}")
    return c


def person_of_key(raw: str, salt: str, kind: str = "auto") -> str:
    """The stored person id of a raw user key: normalised, salted and hashed as at ingest."""
    return hash_key_py(normalize_key_py(raw, kind), salt)


def normalize_key(raw: str | Column, kind: str = "auto") -> Column:
    """Canonical form of a raw key before hashing.

    * ``email``: trimmed and lower-cased.
    * ``phone``: E.164-like: ``+`` followed by the digits only; a leading
      international ``00`` prefix is dropped.
    * ``auto``: email rule when the key contains ``@``, phone rule when it is made
      only of digits, spaces and ``+-().``, otherwise trimmed.
    """
    c = F.trim(_col(raw))
    email = F.lower(c)
    phone = F.concat(F.lit("+"), F.regexp_replace(F.regexp_replace(c, r"^00", ""), r"[^0-9]", ""))
    if kind == "email":
        return email
    if kind == "phone":
        return phone
    if kind != "auto":
        raise ValueError(f"unknown key kind {kind!r}")
    return (
        F.when(c.contains("@"), email)
        .when(c.rlike(r"^[+0-9 ().-]+$") & c.rlike(r"[0-9]"), phone)
        .otherwise(c)
    )
