"""Where jobs may write intermediate and state data.

On a cluster every job-owned path (streaming checkpoints, staging for rewrites,
materialised intermediates) lives under the shared folder the cluster names in
``spark.checkpoint.dir``. It is read from the session; a local-mode session
without one (tests, laptops) gets a private temporary folder, a cluster session
without one is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_FALLBACK: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    conf = sc.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if path:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(path)  # DataFrame.checkpoint() writes under the same shared folder
        return path.rstrip("/")
    path = sc.getCheckpointDir()
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for job state on a cluster")
    key = id(spark.sparkContext)
    if key not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[key] = tempfile.mkdtemp(prefix="telemetra-")
        spark.sparkContext.setCheckpointDir(_LOCAL_FALLBACK[key])
    return _LOCAL_FALLBACK[key]


def job_path(spark: SparkSession, *parts: str, unique: bool = False) -> str:
    """A path under the shared folder; ``unique=True`` appends a fresh id."""
    segs = [shared_dir(spark), *parts]
    if unique:
        segs.append(uuid.uuid4().hex)
    return "/".join(s.strip("/") if i else s for i, s in enumerate(segs))
