"""Spark session helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
from contextlib import contextmanager
from typing import Iterator

from pyspark.sql import SparkSession


def session_config(master: str, shuffle_partitions: int | None = None) -> dict[str, str]:
    """Settings of ``build_session``.  Sizes (shuffle partitions, driver
    memory) are set for local masters only; a cluster's own settings hold
    unless the caller names a number of shuffle partitions."""
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    local = _is_local(master)
    if local:
        conf["spark.driver.memory"] = "8g"
    if shuffle_partitions or local:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    return conf


def _is_local(master: str) -> bool:
    """One machine in one JVM (``local``, ``local[n]``), not ``local-cluster``."""
    return master == "local" or master.startswith("local[")


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None,
                  app_name: str = "tarmac") -> SparkSession:
    """A session tuned for these plans: AQE with skew-join splitting and
    partition coalescing on, UI off."""
    spark = (SparkSession.builder.master(master).appName(app_name)
             .config(map=session_config(master, shuffle_partitions)).getOrCreate())
    if _is_local(master):
        # One machine: list partition folders on the driver instead of a
        # Spark job with one task per folder.
        spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.threshold", "100000")
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is used
    as is.  Only a local-mode session without one (tests) gets a fresh
    temporary folder; on a cluster a missing setting is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a Spark Connect session has no SparkContext
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            return configured
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if _is_local(sc.master):
        folder = tempfile.mkdtemp(prefix="tarmac-ckpt-")
        sc.setCheckpointDir(folder)
        return sc.getCheckpointDir()
    raise RuntimeError(
        "spark.checkpoint.dir is not set; point it at a shared folder "
        "(HDFS/S3/ABFS) before running ranking plans on a cluster")


# What AQE may join into one task inside ``small_tasks``: flight tables compress
# well, so that its default of 64 MB is millions of rows to sort or to hash.
TASK_BYTES = 24 << 20


@contextmanager
def small_tasks(spark: SparkSession, size: int = TASK_BYTES) -> Iterator[None]:
    """Join shuffle partitions to at most ``size`` stored bytes inside the block, so
    that a task's rows fit its memory.  A smaller setting of the session stays."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name, None)
    if before is not None and spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) <= size:
        yield
        return
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


# Scratch tables that this process made and nobody has deleted yet.
_OWNED: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint directory for a written table.  The
    innermost ``scratch_scope`` deletes it; outside of one it lives until the
    application ends, as lazily evaluated results may still read it."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if not _OWNED:
        atexit.register(_delete_owned)
    path = f"{base}/tarmac-{name}-{os.urandom(6).hex()}"
    _OWNED.append(path)
    return path


def result_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint directory for a result that its
    caller owns (no scratch table)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{os.urandom(6).hex()}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete, on leaving the block, the scratch tables made inside it.  For
    work that is complete by then, such as a written result."""
    before = len(_OWNED)
    try:
        yield
    finally:
        mine = _OWNED[before:]
        del _OWNED[before:]
        _delete(spark, mine)


def _delete(spark: SparkSession, paths: list[str]) -> int:
    """Remove folders through their Hadoop FileSystem (HDFS, S3, ABFS, local)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed


def _delete_owned() -> None:
    """At the end of the application: what is left of this process's tables."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    try:
        _delete(spark, _OWNED)
    except Exception:  # the JVM may be gone already
        pass


def delete_scratch(spark: SparkSession, *paths: str) -> int:
    """Delete scratch tables that a job has read for the last time."""
    for p in paths:
        if p in _OWNED:
            _OWNED.remove(p)
    return _delete(spark, list(paths))


def clear_scratch(spark: SparkSession) -> int:
    """Delete this process's scratch tables (sorted tables of the ranking and
    similar).  Call it when the DataFrames built on them are no longer needed.
    Returns the number of tables removed."""
    mine = list(_OWNED)
    _OWNED.clear()
    return _delete(spark, mine)
