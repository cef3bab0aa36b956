"""Parameters every operator takes explicitly (no process environment, no ``now()``)."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

# The five curated subjects; the first four are the ones an
# explicit override may choose, anything else becomes "other".
SUBJECTS = ("errors", "activities", "ai_usage", "traceability", "other")
KNOWN_SUBJECTS = ("errors", "activities", "ai_usage", "traceability")


@dataclass(frozen=True)
class Settings:
    # salt prepended to a raw user key before hashing (identity)
    salt: str = "salt"
    # attribute that, when present, overrides the derived subject
    subject_attr: str = "app.subject"
    # resource attributes promoted to ``resource_attr_<name>`` columns at ingest
    promote_resource_attrs: tuple[str, ...] = ("deployment.environment",)
    # curated layout: number of person_id hash buckets
    buckets: int = 16
    # curated layout: a directory level per day (see layout.write_curated for when)
    day_level: bool = False
    # reference clock for "last N days" windows (the reference uses now())
    as_of: datetime = field(default_factory=lambda: datetime(2024, 1, 31))
    # rows per top-N lists
    timeline_cap: int = 500
    subject_recent_cap: int = 20

    @property
    def as_of_ns(self) -> int:
        return int((self.as_of - datetime(1970, 1, 1)).total_seconds()) * 1_000_000_000


DEFAULT = Settings()
