"""Upkeep of the tables the streams write: what may be compacted, and the retention sweep.

A streamed table is the union of ``hot`` (published micro-batches, which a downstream
stream may still have to read, and whose folders tell a replay what is published) and
``cold`` (compacted rows). Two rules keep upkeep from losing or repeating rows:

* a batch of a table leaves ``hot`` only once it is *settled*: a later batch of the same
  stream is published, so its own offsets are committed and it can't be replayed;
* a batch of the raw table leaves ``hot`` only once it is *curated*: every file with rows in
  it is in the read list of a settled curated batch.

The sweep rewrites ``cold`` alone: a rewritten file in ``hot`` would look new to the stream.
It compacts what may leave ``hot`` first, so that expired rows it can't delete yet are those
of the newest batches, and says how many there are; the next run gets them.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetra.plans import fs
from telemetra.plans.maintenance import compact, compact_batches, day_prune, delete_where
from telemetra.streaming.curation import CONSUMED, consumed_root, read_table
from telemetra.streaming.sinks import COLD, HOT


def _published(spark: SparkSession, root: str) -> list[str]:
    return sorted(n for n, is_dir, _ in fs.list_dir(spark, f"{root.rstrip('/')}/{HOT}")
                  if is_dir and n.startswith("batch=") and fs.exists(spark, f"{root.rstrip('/')}/{HOT}/{n}/_SUCCESS"))


def settled_batches(spark: SparkSession, root: str) -> set[str]:
    """Published batches of a table but the newest of each stream."""
    newest: dict[str, str] = {}
    names = _published(spark, root)
    for n in names:  # batch=<stream>-<20 digits>, so names of a stream sort by number
        newest[n.rsplit("-", 1)[0]] = n
    return set(names) - set(newest.values())


def curated_batches(spark: SparkSession, raw_root: str, ue_root: str) -> set[str]:
    """Published batches of the raw table whose rows are all in settled batches of the curated table."""
    hot, read = f"{raw_root.rstrip('/')}/{HOT}", f"{consumed_root(ue_root)}/{HOT}"
    names = _published(spark, raw_root)
    done = [n.split("=", 1)[1] for n in settled_batches(spark, consumed_root(ue_root))]
    if not names or not done:
        return set()
    files = spark.read.schema(T.StructType([T.StructField("batch", T.StringType())])).parquet(hot).select(
        "batch", F.col("_metadata.file_path").alias("file")).distinct()
    seen = spark.read.schema(CONSUMED).parquet(read).where(F.col("batch").isin(done)).select("file")
    # one row per raw batch with rows that are still to be curated
    waiting = {f"batch={r[0]}" for r in files.join(seen, "file", "left_anti").select("batch").distinct().collect()}
    return {n for n in names if n not in waiting}


def compact_streamed(spark: SparkSession, root: str, schema: T.StructType, partition_cols: Sequence[str],
                     sort_cols: Sequence[str] = (), names: Collection[str] | None = None) -> int:
    """M4: moves hot batches (default: the settled ones) into ``cold`` and merges small files there."""
    moved = compact_batches(spark, root, schema, partition_cols, sort_cols,
                            settled_batches(spark, root) if names is None else names)
    if moved:
        compact(spark, f"{root.rstrip('/')}/{COLD}", schema, partition_cols, sort_cols)
    return moved


def sweep_streamed(spark: SparkSession, tables: dict[str, tuple], plan: list[tuple[str, str, int]]) -> DataFrame:
    """M3: ``table_name, deleted, waiting, remaining`` of each streamed table of the plan.

    ``tables[name] = (root, schema, partition_cols, sort_cols, names)``; ``names`` are the hot batches that
    may be compacted (None: the settled ones). ``waiting``: expired rows still in ``hot``.
    """
    rows = []
    for name, time_col, cutoff in plan:
        if name not in tables:
            continue
        root, schema, parts, sort, names = tables[name]
        compact_streamed(spark, root, schema, parts, sort, names)
        old, cold = F.col(time_col) < F.lit(cutoff), f"{root.rstrip('/')}/{COLD}"
        deleted = delete_where(spark, cold, schema, parts, old, sort, day_prune(parts, cutoff)) if fs.exists(spark, cold) else 0
        left = read_table(spark, root, schema).agg(F.count_if(old).alias("waiting"), F.count(F.lit(1)).alias("remaining"))
        rows.append(left.select(F.lit(name).alias("table_name"), F.lit(deleted).cast("long").alias("deleted"), "waiting", "remaining"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
