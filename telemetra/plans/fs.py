"""Small file-system helpers over the Hadoop FileSystem of the session.

Works for any URI the cluster's Hadoop configuration can reach (local, HDFS,
object stores); used only for publish steps (exists / rename / delete / list).
"""

from __future__ import annotations

import hashlib
from urllib.parse import urlsplit

from pyspark.sql import SparkSession


_HANDLES: dict[tuple, tuple] = {}


def _fs(spark: SparkSession, path: str):
    """``(FileSystem, Path(path), jvm)``; the FileSystem and Path class are cached per
    context and scheme/authority, so a call costs one round trip for the Path."""
    sc = spark.sparkContext
    u = urlsplit(path)
    key = (id(sc), u.scheme, u.netloc)
    h = _HANDLES.get(key)
    if h is None or h[2] is not sc:
        path_cls = sc._jvm.org.apache.hadoop.fs.Path
        h = _HANDLES[key] = (path_cls(path).getFileSystem(sc._jsc.hadoopConfiguration()), path_cls, sc)
    return h[0], h[1](path), sc._jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return bool(fs.exists(p))


def delete(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return bool(fs.delete(p, True))


def rename(spark: SparkSession, src: str, dst: str) -> bool:
    fs, p, jvm = _fs(spark, src)
    q = jvm.org.apache.hadoop.fs.Path(dst)
    parent = q.getParent()
    if parent is not None and not fs.exists(parent):
        fs.mkdirs(parent)
    return bool(fs.rename(p, q))


def mkdirs(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return bool(fs.mkdirs(p))


def list_dir(spark: SparkSession, path: str) -> list[tuple[str, bool, int]]:
    """``[(name, is_dir, length)]`` of the direct children; empty if absent."""
    fs, p, _ = _fs(spark, path)
    if not fs.exists(p):
        return []
    return [(s.getPath().getName(), bool(s.isDirectory()), int(s.getLen())) for s in fs.listStatus(p)]


def glob(spark: SparkSession, pattern: str) -> list[str]:
    """Full paths matching a glob pattern (one listing call, only matches come back)."""
    fs, p, _ = _fs(spark, pattern)
    found = fs.globStatus(p)
    return [] if found is None else [str(s.getPath().toString()) for s in found]


def qualified(spark: SparkSession, path: str) -> str:
    """Fully qualified form of ``path`` (scheme and authority), as file listings report it."""
    fs, p, _ = _fs(spark, path)
    return str(fs.makeQualified(p).toString()).rstrip("/")


def move(spark: SparkSession, src: str, dst: str) -> bool:
    """Rename when the destination's parent is known to exist (no extra checks)."""
    fs, p, _ = _fs(spark, src)
    return bool(fs.rename(p, _fs(spark, dst)[1]))


def stat_key(spark: SparkSession, path: str) -> str:
    """What a file, or the files of a folder, look like from outside (names, lengths, times): a cheap
    change detector for derived tables."""
    fs, p, _ = _fs(spark, path)
    s = fs.getFileStatus(p)
    if not s.isDirectory():
        return f"{s.getLen()}-{s.getModificationTime()}"
    files = sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p))
    return hashlib.sha1(repr(files).encode()).hexdigest()


def total_bytes(spark: SparkSession, path: str) -> int:
    """Bytes under a path (one namenode/object-store summary call)."""
    fs, p, _ = _fs(spark, path)
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0
