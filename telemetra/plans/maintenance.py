"""Storage upkeep jobs: retention sweep (M3), compaction (M4), history expiry (M5).

All three are partition-level rewrites of a Hive-style partitioned Parquet
table and share one publish step (as does :func:`replace_partitions`, which
derived tables such as the daily rollup use to refresh single partitions):

1. find the affected leaf partitions (file listing for compaction; a
   distinct-partition aggregate for row predicates — its size is the number of
   partitions, never the number of rows);
2. one Spark job reads only those partitions, keeps the surviving rows and
   writes them, each partition into its wanted number of sorted files, to a
   staging folder;
3. the staged row count is checked against the expected count;
4. each affected partition folder is swapped for its staged version (or
   dropped when nothing survives); untouched partitions are never rewritten.

A Parquet folder has no atomic multi-directory swap: between the removal of an
old partition folder and the rename of its replacement a reader can miss that
partition for a moment. A table format with transactional commits removes that
window; these jobs keep the gap to two renames per partition.

Every publish step is journaled before its first rename (see :func:`_publish`),
and every job first rolls forward an unfinished publish of its table
(:func:`recover`): a driver lost in the middle of a swap leaves neither a
missing partition nor duplicated rows behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetra.functions.timecols import NS_PER_DAY
from telemetra.plans import fs
from telemetra.plans.layout import MAX_RECORDS_PER_FILE

_EPOCH_ORDINAL = date(1970, 1, 1).toordinal()

TARGET_FILE_BYTES = 512 * 1024 * 1024


# Folder name Spark gives a NULL partition value.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def _part_path(root: str, cols: Sequence[str], values: Sequence) -> str:
    return root.rstrip("/") + "/" + "/".join(f"{c}={NULL_PARTITION if v is None else v}" for c, v in zip(cols, values))


def _data_files(spark: SparkSession, root: str, depth: int) -> DataFrame:
    """``(dir, file, bytes)`` of the Parquet files ``depth`` partition levels below ``root``.

    A distributed listing: the ``binaryFile`` source lists names and sizes only
    (no content is read when ``content`` is not selected) and, past a few
    folders, lists in parallel on the executors. Folders starting with ``_`` or
    ``.`` (staging, trash) are skipped like in any Spark file listing.
    """
    base = fs.qualified(spark, root)
    rel = F.substring(F.col("path"), len(base) + 2, 1 << 30)
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
        .load(root)
        .where(F.col("path").startswith(base + "/"))
        .select(F.regexp_replace(rel, "/[^/]*$", "").alias("dir"), F.regexp_extract(rel, "[^/]*$", 0).alias("file"),
                F.col("length").alias("bytes"))
        .where(F.size(F.split("dir", "/")) == depth)
    )


def _partition_stats(spark: SparkSession, root: str, depth: int) -> dict[str, tuple[int, int]]:
    """``{partition rel path: (data files, bytes)}``; one row per partition reaches the driver."""
    if not fs.exists(spark, root):
        return {}
    rows = _data_files(spark, root, depth).groupBy("dir").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")).collect()
    return {r["dir"]: (int(r["files"]), int(r["bytes"])) for r in rows if all("=" in x for x in r["dir"].split("/"))}


# --- publish journal ---------------------------------------------------------------

_JOURNAL_SCHEMA = "seq int, op string, src string, dst string"


def _new_publish(root: str) -> str:
    return f"{root.rstrip('/')}/_publish-{uuid.uuid4().hex[:8]}"


def _publish(spark: SparkSession, pub: str, steps: list[tuple[str, str, str]], cleanup: Sequence[str] = ()) -> None:
    """Run ``steps`` ``[(op, src, dst)]`` (``mkdirs`` / ``move`` / ``delete``) as one journaled publish.

    The steps are written to ``<pub>/_journal`` (``pub`` from :func:`_new_publish`,
    one small JSON file) before anything is renamed. Deleting the journal is the commit point;
    only then are ``cleanup`` paths and the publish folder removed. If the
    driver is lost before that, :func:`recover` replays the journal; every step
    is idempotent in replay (a move runs only while its source exists and its
    target does not), so the table rolls forward to the same end state.
    """
    rows = [(i, op, a, b) for i, (op, a, b) in enumerate(steps)]
    rows += [(len(rows) + j, "cleanup", c, "") for j, c in enumerate(cleanup)]
    spark.createDataFrame(rows, _JOURNAL_SCHEMA).coalesce(1).write.json(f"{pub}/_journal")
    _replay(spark, pub, rows, check=False)


def _replay(spark: SparkSession, pub: str, rows: Sequence, check: bool) -> None:
    rows = sorted(tuple(r) for r in rows)
    for _, op, a, b in rows:
        if op == "mkdirs":
            fs.mkdirs(spark, a)
        elif op == "move":
            if check and (not fs.exists(spark, a) or fs.exists(spark, b)):
                continue  # done before the interruption
            if not fs.move(spark, a, b):
                raise RuntimeError(f"could not move {a} -> {b}; the next upkeep run resumes from {pub}")
        elif op == "delete":
            fs.delete(spark, a)
    fs.delete(spark, f"{pub}/_journal")  # commit point
    for _, op, a, _b in rows:
        if op == "cleanup":
            fs.delete(spark, a)
    fs.delete(spark, pub)


def recover(spark: SparkSession, root: str) -> int:
    """Roll forward unfinished publishes of the table at ``root``; drop leftover staging.

    Publish folders with a complete journal are replayed; those whose journal
    was never completed had not renamed anything and are removed, as are
    ``_staging-*`` folders (one job owns a table's upkeep, so none is live).
    Returns the number of publishes rolled forward.
    """
    root = root.rstrip("/")
    done = 0
    for pub in fs.glob(spark, f"{root}/_publish-*"):
        if fs.exists(spark, f"{pub}/_journal/_SUCCESS"):
            rows = spark.read.schema(_JOURNAL_SCHEMA).json(f"{pub}/_journal").collect()
            _replay(spark, pub, rows, check=True)
            done += 1
        else:
            fs.delete(spark, pub)
    for leftover in fs.glob(spark, f"{root}/_staging-*"):
        fs.delete(spark, leftover)
    return done


def _swap(spark: SparkSession, root: str, staging: str, rel_paths: Sequence[str], depth: int,
          existing: set[str] | None = None) -> None:
    """Replace each partition folder ``rel`` by its staged version (or drop it when none was staged).

    Two renames per partition: the old folder moves aside into the publish
    folder, the staged one into its place (its parent folder still exists).
    ``existing`` names the partitions present now (default: all of
    ``rel_paths``); a new partition only gets its staged folder moved in.
    """
    root = root.rstrip("/")
    staged = set(_partition_stats(spark, staging, depth))
    pub = _new_publish(root)
    aside = f"{pub}/aside"
    steps: list[tuple[str, str, str]] = [("mkdirs", aside, "")]
    for i, rel in enumerate(rel_paths):
        if existing is None or rel in existing:
            steps.append(("move", f"{root}/{rel}", f"{aside}/{i}"))
        elif rel in staged and "/" in rel:
            steps.append(("mkdirs", f"{root}/{rel.rsplit('/', 1)[0]}", ""))
        if rel in staged:
            steps.append(("move", f"{staging}/{rel}", f"{root}/{rel}"))
    _publish(spark, pub, steps, cleanup=[staging])


def replace_partitions(spark: SparkSession, root: str, fresh: DataFrame, partition_cols: Sequence[str],
                       rel_paths: Sequence[str], sort_cols: Sequence[str] = ()) -> int:
    """Publish ``fresh`` as the whole new content of partitions ``rel_paths``.

    ``fresh`` must hold rows of those partitions only. It is written sorted to a
    staging folder, its row count checked, then swapped in (journaled); listed
    partitions without fresh rows are removed, all others are untouched.
    Returns the number of rows published.
    """
    root = root.rstrip("/")
    if not fs.exists(spark, root):
        fs.mkdirs(spark, root)
    recover(spark, root)
    staging = f"{root}/_staging-{uuid.uuid4().hex[:8]}"
    expected = fresh.count()
    if expected:
        keys = [*partition_cols, *sort_cols]
        (
            fresh.repartitionByRange(*keys).sortWithinPartitions(*keys)
            .write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
            .partitionBy(*partition_cols).parquet(staging)
        )
        written = spark.read.parquet(staging).count()
        if written != expected:
            fs.delete(spark, staging)
            raise RuntimeError(f"staged {written} rows, expected {expected}; table left unchanged")
    # folder existence, not data files: an empty folder must be moved aside too, or the
    # rename would nest the staged folder inside it
    existing = {rel for rel in rel_paths if fs.exists(spark, f"{root}/{rel}")}
    _swap(spark, root, staging, list(rel_paths), len(partition_cols), existing=existing)
    return expected


def _want_table(spark: SparkSession, schema: T.StructType, partition_cols: Sequence[str],
                want: dict[str, int]) -> DataFrame:
    """One row per rewritten partition: typed partition values + wanted file count."""
    def value(kv: str) -> str | None:
        v = kv.split("=", 1)[1]
        return None if v == NULL_PARTITION else v

    rows = [[value(kv) for kv in rel.split("/")] + [n] for rel, n in want.items()]
    cols = [f"_v{i}" for i in range(len(partition_cols))]
    raw = spark.createDataFrame(rows, T.StructType(
        [T.StructField(c, T.StringType()) for c in cols] + [T.StructField("_want", T.IntegerType())]))
    types = {f.name: f.dataType for f in schema.fields}
    return raw.select(*[F.col(c).cast(types[p]).alias(c) for c, p in zip(cols, partition_cols)], "_want")


def rewrite_partitions(spark: SparkSession, root: str, schema: T.StructType, partition_cols: Sequence[str],
                       keep: Column | None, want: dict[str, int], sort_cols: Sequence[str] = (),
                       drop: Sequence[str] = (), update: dict[str, Column] | None = None) -> int:
    """Rewrite partitions ``want = {rel_path: files}`` keeping rows matching ``keep``; remove ``drop``.

    ``update`` replaces non-partition columns of the kept rows (``{name: expression}``).

    Each row gets a file slot ``pmod(hash(sort key), files)`` of its partition;
    hash-partitioning on (partition, slot) gives every partition exactly its
    wanted number of files, spread over as many tasks, each file sorted. The
    per-partition table has one row per rewritten partition (metadata-sized) and
    is broadcast. Returns the number of rows written.
    """
    if not want and not drop:
        return 0
    staging = f"{root.rstrip('/')}/_staging-{uuid.uuid4().hex[:8]}"
    if not want:
        _swap(spark, root, staging, list(drop), len(partition_cols))
        return 0
    paths = [f"{root.rstrip('/')}/{r}" for r in want]
    df = spark.read.schema(schema).option("basePath", root).parquet(*paths)
    kept = df if keep is None else df.where(keep)
    for name, expr in (update or {}).items():
        kept = kept.withColumn(name, expr)
    expected = kept.count()
    if expected:
        slot_key = [F.col(c) for c in (sort_cols or [c for c in schema.fieldNames() if c not in partition_cols])]
        wt = F.broadcast(_want_table(spark, schema, partition_cols, want))
        on = [kept[c].eqNullSafe(wt[f"_v{i}"]) for i, c in enumerate(partition_cols)]
        slotted = kept.join(wt, on).withColumn("_slot", F.pmod(F.hash(*slot_key), F.col("_want")))
        slotted = slotted.drop("_want", *[f"_v{i}" for i in range(len(partition_cols))])
        (
            slotted.repartition(sum(want.values()), *partition_cols, "_slot")
            .sortWithinPartitions(*partition_cols, "_slot", *sort_cols)
            .drop("_slot")
            .write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
            .partitionBy(*partition_cols).parquet(staging)
        )
        written = spark.read.schema(schema).parquet(staging).count()
        if written != expected:
            fs.delete(spark, staging)
            raise RuntimeError(f"staged {written} rows, expected {expected}; table left unchanged")
    _swap(spark, root, staging, [*want, *drop], len(partition_cols))
    return expected


def _touched(df: DataFrame, partition_cols: Sequence[str], cond: Column, prune: Column | None = None) -> list[dict]:
    """Partitions with rows matching ``cond`` and, for those only, how many rows survive.

    With ``prune`` (a predicate on partition columns implied by ``cond``, e.g.
    ``event_date <= cutoff day`` for ``time < cutoff``) this is one aggregate
    over the pruned partitions. Without it, the first aggregate filters with
    ``cond`` (pushed into the Parquet scan, so row groups outside the range are
    skipped) and the second reads only the touched partitions (partition
    filter). Results have one row per partition.
    """
    keep = ~cond | cond.isNull()
    if prune is not None:
        rows = (
            df.where(prune).groupBy(*partition_cols)
            .agg(F.count_if(cond).alias("hit"), F.count_if(keep).alias("survive"))
            .where(F.col("hit") > 0)
            .collect()
        )
        return [r.asDict() for r in rows]
    hits = [r.asDict() for r in df.where(cond).groupBy(*partition_cols).agg(F.count(F.lit(1)).alias("hit")).collect()]
    if not hits:
        return []
    # one flat IN over a key made only of partition columns: evaluated as a
    # partition filter at file listing, so only touched partitions are read
    key = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit(NULL_PARTITION)) for c in partition_cols])
    in_touched = key.isin(["/".join(NULL_PARTITION if r[c] is None else str(r[c]) for c in partition_cols)
                           for r in hits])
    surv = {tuple(r[c] for c in partition_cols): r["survive"]
            for r in df.where(in_touched & keep).groupBy(*partition_cols).agg(F.count(F.lit(1)).alias("survive")).collect()}
    for r in hits:
        r["survive"] = surv.get(tuple(r[c] for c in partition_cols), 0)
    return hits


def delete_where(spark: SparkSession, root: str, schema: T.StructType, partition_cols: Sequence[str],
                 cond: Column, sort_cols: Sequence[str] = (), prune: Column | None = None) -> int:
    """Delete rows matching ``cond``: drop fully-matching partitions, rewrite partial ones.

    ``prune`` optionally restricts the search to partitions that can hold
    matching rows (see :func:`_touched`). Returns the number of deleted rows.
    Rows where ``cond`` is NULL are kept.
    """
    recover(spark, root)
    df = spark.read.schema(schema).parquet(root)
    touched = _touched(df, partition_cols, cond, prune)
    if not touched:
        return 0
    deleted = sum(r["hit"] for r in touched)
    rel = {id(r): _part_path("", partition_cols, [r[c] for c in partition_cols]).lstrip("/") for r in touched}
    drop = [rel[id(r)] for r in touched if r["survive"] == 0]
    partial = [rel[id(r)] for r in touched if r["survive"] > 0]
    want: dict[str, int] = {}
    if partial:
        sizes = _partition_stats(spark, root, len(partition_cols))
        want = {p: _files_for(sizes.get(p, (0, 0))[1], TARGET_FILE_BYTES) for p in partial}
    rewrite_partitions(spark, root, schema, partition_cols, ~cond | cond.isNull(), want, sort_cols, drop=drop)
    return deleted


def _files_for(size: int, target_bytes: int) -> int:
    return max(1, -(-size // target_bytes))


def day_prune(partition_cols: Sequence[str], cutoff_ns: int) -> Column | None:
    """``event_date <= day of (cutoff + 1 µs)`` when the table is day-partitioned.

    Rows with ``time < cutoff`` can only sit in days up to the cutoff day; the
    extra microsecond covers a curated ``event_date`` taken from the rounded
    microsecond time. A superset is safe: the exact condition decides.
    """
    if "event_date" not in partition_cols:
        return None
    return F.col("event_date") <= F.lit(date.fromordinal(_EPOCH_ORDINAL + (cutoff_ns + 1_000) // NS_PER_DAY))


def retention_sweep(spark: SparkSession, tables: dict[str, tuple[str, T.StructType, Sequence[str], Sequence[str]]],
                    plan: list[tuple[str, str, int]]) -> dict[str, int]:
    """M3: delete rows older than the cutoff from each existing table of the plan.

    ``tables[name] = (root, schema, partition_cols, sort_cols)``. Tables absent
    from ``tables`` or from storage are skipped; NULL times are never swept.
    Whole day partitions below the cutoff are dropped without reading data
    files beyond the touched-partition aggregate; the cutoff day is rewritten.
    """
    def sweep(name: str, time_col: str, first_kept: int) -> int:
        root, schema, parts, sort = tables[name]
        old = F.col(time_col) < F.lit(first_kept)
        return delete_where(spark, root, schema, parts, old, sort, day_prune(parts, first_kept))

    stored = {rule[0]: rule for rule in plan if rule[0] in tables and fs.exists(spark, tables[rule[0]][0])}
    counts = {name: sweep(*rule) for name, rule in stored.items()}
    return {name: n for name, n in counts.items() if n}


def compact(spark: SparkSession, root: str, schema: T.StructType, partition_cols: Sequence[str],
            sort_cols: Sequence[str] = (), target_bytes: int = TARGET_FILE_BYTES, min_files: int = 2) -> dict[str, int]:
    """M4: merge small files within each fragmented partition, clustered and sorted.

    A partition is fragmented when it has at least ``min_files`` files and could
    be stored in fewer files of ``target_bytes``. Returns counts of partitions
    and files before/after. The row multiset is unchanged (checked).
    """
    recover(spark, root)
    depth = len(partition_cols)
    frag = []
    for rel, (files, size) in sorted(_partition_stats(spark, root, depth).items()):
        want = _files_for(size, target_bytes)
        if files >= min_files and want < files:
            frag.append((rel, files, want))
    if not frag:
        return {"partitions": 0, "files_before": 0, "files_after": 0}
    rewrite_partitions(spark, root, schema, partition_cols, None, {r: w for r, _, w in frag}, sort_cols)
    now = _partition_stats(spark, root, depth)
    after = sum(now.get(r, (0, 0))[0] for r, _, _ in frag)
    return {"partitions": len(frag), "files_before": sum(n for _, n, _ in frag), "files_after": after}


def retention_sweep_versioned(spark: SparkSession, root: str, schema: T.StructType, partition_cols: Sequence[str],
                              time_col: str, cutoff: int, commits_root: str, commit_time: datetime,
                              sort_cols: Sequence[str] = ()) -> tuple[int, int]:
    """M3 on a row-versioned table: a logical delete in a new commit.

    Live rows older than ``cutoff`` get ``end_snapshot`` = the new commit: the
    change feed shows them as deletes and time travel to earlier snapshots still
    sees them; :func:`expire_history` purges them physically later. The commit
    row is published first, so an interrupted run leaves at most an empty
    commit and a rerun ends the rows in a later one. Only partitions holding
    such rows are rewritten. Returns ``(commit id, rows ended)``; no commit is
    added when nothing is due.
    """
    from telemetra.plans.layout import COMMITS_STORED

    recover(spark, root)
    cond = F.col("end_snapshot").isNull() & (F.col(time_col) < F.lit(cutoff))
    df = spark.read.schema(schema).parquet(root)
    touched = _touched(df, partition_cols, cond, day_prune(partition_cols, cutoff))
    commits = spark.read.schema(COMMITS_STORED).parquet(commits_root)
    last = commits.agg(F.max("snapshot_id")).first()[0] or 0
    if not touched:
        return last, 0
    commit_id = last + 1
    new_commit = spark.createDataFrame([(commit_id, commit_time)], COMMITS_STORED)
    replace_table(spark, commits_root, commits.unionByName(new_commit))
    rels = [_part_path("", partition_cols, [r[c] for c in partition_cols]).lstrip("/") for r in touched]
    sizes = _partition_stats(spark, root, len(partition_cols))
    want = {p: _files_for(sizes.get(p, (0, 0))[1], TARGET_FILE_BYTES) for p in rels}
    ended = F.when(cond, F.lit(commit_id).cast("long")).otherwise(F.col("end_snapshot"))
    rewrite_partitions(spark, root, schema, partition_cols, None, want, sort_cols, update={"end_snapshot": ended})
    return commit_id, sum(r["hit"] for r in touched)


def expire_history(spark: SparkSession, root: str, schema: T.StructType, partition_cols: Sequence[str],
                   horizon_snapshot: int, sort_cols: Sequence[str] = (), commits_root: str | None = None) -> int:
    """M5: physically remove row versions deleted at or before ``horizon_snapshot``.

    Time travel to snapshots before the horizon is no longer possible afterwards.
    With ``commits_root`` the commit table is trimmed to snapshots at or after
    the horizon (the horizon's own state is intact), so a read at an earlier
    time reports that it predates history instead of returning a partly purged
    state. Returns the number of purged row versions.
    """
    cond = F.col("end_snapshot").isNotNull() & (F.col("end_snapshot") <= F.lit(horizon_snapshot))
    purged = delete_where(spark, root, schema, partition_cols, cond, sort_cols)
    if commits_root is not None:
        from telemetra.plans.layout import COMMITS_STORED
        kept = spark.read.schema(COMMITS_STORED).parquet(commits_root).where(F.col("snapshot_id") >= horizon_snapshot)
        replace_table(spark, commits_root, kept)
    return purged


def replace_table(spark: SparkSession, root: str, df: DataFrame) -> int:
    """Replace all data files of a small unpartitioned table (one file, journaled publish).

    For metadata-sized tables only (the commit table): ``df`` is written as one
    file to a staging folder, counted, then the old files move aside and the new
    one moves in. ``df`` may read ``root`` itself: it is fully written before
    anything moves. Returns the number of rows.
    """
    root = root.rstrip("/")
    recover(spark, root)
    staging = f"{root}/_staging-{uuid.uuid4().hex[:8]}"
    n = df.count()
    df.coalesce(1).write.mode("overwrite").parquet(staging)
    if spark.read.parquet(staging).count() != n:
        fs.delete(spark, staging)
        raise RuntimeError("staged table does not match; table left unchanged")
    pub = _new_publish(root)
    aside = f"{pub}/aside"
    steps: list[tuple[str, str, str]] = [("mkdirs", aside, "")]
    steps += [("move", f"{root}/{f}", f"{aside}/{f}") for f, is_dir, _ in fs.list_dir(spark, root)
              if not is_dir and f.endswith(".parquet")]
    steps += [("move", f"{staging}/{f}", f"{root}/{f}") for f, is_dir, _ in fs.list_dir(spark, staging)
              if not is_dir and f.endswith(".parquet")]
    _publish(spark, pub, steps, cleanup=[staging])
    return n


def compact_batches(spark: SparkSession, root: str, schema: T.StructType, partition_cols: Sequence[str],
                    sort_cols: Sequence[str] = (), names: Collection[str] | None = None) -> int:
    """Move published hot micro-batches (``<root>/hot/batch=*``; only ``names`` if given) into ``<root>/cold``.

    The cold part is never watched by a stream, so compacting there cannot make
    old rows look new to a downstream consumer. Batches are merged into the cold
    layout and deleted from hot only after the staged copy is verified.
    Returns the number of rows moved.
    """
    recover(spark, root)
    hot = f"{root.rstrip('/')}/hot"
    cold = f"{root.rstrip('/')}/cold"
    names = sorted(n for n, is_dir, _ in fs.list_dir(spark, hot)
                   if is_dir and n.startswith("batch=") and (names is None or n in names))
    names = [n for n in names if fs.exists(spark, f"{hot}/{n}/_SUCCESS")]
    if not names:
        return 0
    df = spark.read.schema(schema).option("basePath", hot).parquet(*[f"{hot}/{n}" for n in names])
    df = df.select(*schema.fieldNames())
    expected = df.count()
    staging = f"{root.rstrip('/')}/_staging-cold-{uuid.uuid4().hex[:8]}"
    (
        # a partition is one file unless it is large, when it spreads over tasks; ranges would read all rows twice
        df.hint("rebalance", *partition_cols).sortWithinPartitions(*partition_cols, *sort_cols)
        .write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .partitionBy(*partition_cols).parquet(staging)
    )
    if spark.read.schema(schema).parquet(staging).count() != expected:
        fs.delete(spark, staging)
        raise RuntimeError("staged cold copy does not match; hot batches left in place")
    # publish (journaled): move each staged file into the cold partition folders,
    # then drop the batches; one row per staged file reaches the driver, since
    # each file is one rename there
    staged = _data_files(spark, staging, len(partition_cols)).select("dir", "file").collect()
    steps: list[tuple[str, str, str]] = [("mkdirs", f"{cold}/{d}", "") for d in sorted({r["dir"] for r in staged})]
    steps += [("move", f"{staging}/{r['dir']}/{r['file']}", f"{cold}/{r['dir']}/{uuid.uuid4().hex[:8]}-{r['file']}")
              for r in staged]
    steps += [("delete", f"{hot}/{n}", "") for n in names]
    _publish(spark, _new_publish(root), steps, cleanup=[staging])
    return expected
