"""telemetra: product-telemetry analytics as plain Spark DataFrame jobs.

Layers (each a set of pure ``DataFrame -> DataFrame`` functions unless noted):

* ``sources``    OTLP JSON payloads -> flat ``logs`` / ``traces`` / metric tables,
                 fixture adapters over the driver's ``events`` table, Parquet reads.
* ``functions``  column expressions: attribute parsing, epoch-ns time, key hashing.
* ``operators``  curation, reports, identity stitching, product analytics
                 (funnels, retention, paths), history (time travel, change feed)
                 and upkeep (retention, compaction, expiry).
* ``plans``      session settings, physical layout writers and pruning read helpers.
* ``streaming``  continuous ingest and incremental curation (Structured Streaming).
"""

from telemetra.settings import Settings

__all__ = ["Settings"]
