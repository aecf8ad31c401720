"""Tables that a session derives from source files once and reads many times.

A derived table lies in the checkpoint folder and lives until the application
ends (or ``session.clear_scratch``).  It is found again by the state of its
source files, so a changed file means a new table, never a stale one.
"""

from __future__ import annotations

import hashlib
from typing import Callable, Iterable

from pyspark.sql import SparkSession

from tarmac.session import scratch_path

_KNOWN: dict[tuple[str, str, str], str] = {}


def fingerprint(spark: SparkSession, paths: Iterable[str]) -> str:
    """Digest of path, length and modification time of every file at ``paths``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        files = at.getFileSystem(conf).listFiles(at, True)
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def derived(spark: SparkSession, name: str, sources: Iterable[str], build: Callable[[str], None]) -> str:
    """Path of the table ``name`` derived from ``sources``; ``build(path)`` makes
    it unless this application has it already."""
    key = (spark.sparkContext.applicationId, name, fingerprint(spark, sources))
    if key not in _KNOWN or not _exists(spark, _KNOWN[key]):
        path = scratch_path(spark, name)
        build(path)
        _KNOWN[key] = path
    return _KNOWN[key]
