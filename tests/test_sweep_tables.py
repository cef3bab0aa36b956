"""The registered sweeps cover every table of the retention plan."""

from conftest import SF_SMALL

from telemetra import registry
from telemetra.operators.upkeep import RETENTION_TABLES


def test_sweeps_cover_the_plan(spark):
    run = registry.queries()
    preview = {r.table_name: (r.expired, r.total) for r in run["retention_preview"](spark, SF_SMALL).collect()}
    swept = {r.table_name: (r.deleted, r.deleted + r.remaining)
             for name in ("retention_sweep", "retention_sweep_signals") for r in run[name](spark, SF_SMALL).collect()}
    assert swept == preview and {t for t, _ in RETENTION_TABLES} == set(swept)
    assert any(n for n, _ in swept.values())
