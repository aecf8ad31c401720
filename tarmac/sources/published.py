"""Partitioned tables that change in one step.

Spark replaces partition folders of a plain table one by one, so a reader, or a
crash, in between sees some new and some old ones.  A *published* table keeps
its folders immutable and says in a manifest which of them make up a version:

    <path>/data/write=<id>/<by>=<value>/part-*.parquet      what a write staged
    <path>/_versions/000000000007.json                      folders of version 7

* ``stage`` writes rows to folders of a new write; no reader sees them.
* ``publish`` makes the next manifest, which takes the staged partitions, loses
  the removed ones and keeps all others, and renames it into place.  That rename
  is the only step that readers can notice.  It never replaces a file, so of two
  writers of the same next version one wins; the other tries again on top of it
  if it touches other partitions and fails with ``PublishConflict`` if not.
* ``read`` lists the folders of one version, and of some partitions only if they
  are named; a reader that has begun keeps its version.
* ``vacuum`` deletes old manifests and the folders that no manifest names.

A write may carry a batch number of a stream: publishing a batch again, as a
restarted stream does, changes nothing.

The rename must be atomic and fail on an existing target, as in HDFS, ABFS with
a hierarchical name space and local file systems.  The manifest has one line per
partition, so ``by`` should be a date or a bucket number, not an id.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import re
import time
from dataclasses import dataclass, field
from typing import Any, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NULL = "__HIVE_DEFAULT_PARTITION__"
_VERSION = re.compile(r"(\d{12})\.json")
_WRITE = "write"
DAY_SECONDS = 24 * 3600


class PublishConflict(RuntimeError):
    """Another writer has changed the same partitions since the rows were staged."""


@dataclass(frozen=True)
class Staged:
    """Rows written but not visible: their write, folders and the version that
    was current when they were written."""
    write: str
    partitions: tuple[str, ...]
    base: "Manifest"


@dataclass(frozen=True)
class Manifest:
    """Version number, partition folder -> write, stream -> last batch, notes."""
    version: int = 0
    partitions: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    notes: dict[str, Any] = field(default_factory=dict)


class PublishedTable:
    """A Parquet table at ``path`` with the columns of ``schema``, partitioned by
    the date or integer column ``by``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, by: str):
        if not isinstance(schema[by].dataType, (T.DateType, T.IntegerType, T.LongType)):
            raise ValueError(f"{by} must be a date or an integer")
        self.spark, self.path, self.schema, self.by = spark, path.rstrip("/"), schema, by

    # --- files

    def _at(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _fs(self):
        return self._at().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        fs, at = self._fs(), self._at(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def folder(self, value: Any) -> str:
        """Folder name of a partition value."""
        if isinstance(value, dt.date):
            value = value.isoformat()
        return f"{self.by}={_NULL if value is None else value}"

    # --- versions

    def versions(self) -> list[int]:
        return [int(m.group(1)) for n in self._names("_versions") if (m := _VERSION.fullmatch(n))]

    def manifest(self, version: int | None = None) -> Manifest:
        """A version's manifest (default: the newest; version 0 is the empty table)."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return Manifest()
        jvm = self.spark.sparkContext._jvm
        stream = self._fs().open(self._at("_versions", f"{version:012d}.json"))
        try:
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def exists(self) -> bool:
        return bool(self.versions())

    def _put(self, manifest: Manifest) -> bool:
        """Write a manifest and rename it into place; False if its version exists."""
        sc = self.spark.sparkContext
        jvm, fs = sc._jvm, self._fs()
        draft = self._at("_versions", f".{manifest.version:012d}-{os.urandom(6).hex()}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest.__dict__, sort_keys=True).encode()))
        finally:
            out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
        no_overwrite = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(fs.makeQualified(draft), fs.makeQualified(
                self._at("_versions", f"{manifest.version:012d}.json")), no_overwrite)
            return True
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(draft, False)
            return False

    # --- writing

    def stage(self, df: DataFrame) -> Staged:
        """Write the rows to new folders that no version names yet."""
        base = self.manifest()
        write = f"{int(time.time() * 1000):013d}-{os.urandom(4).hex()}"
        (df.select([f.name for f in self.schema.fields]).write.mode("errorifexists").partitionBy(self.by)
         .parquet(f"{self.path}/data/{_WRITE}={write}"))
        names = self._names("data", f"{_WRITE}={write}")
        return Staged(write, tuple(n for n in names if n.startswith(f"{self.by}=")), base)

    def publish(self, staged: Staged | None = None, remove: Iterable[Any] = (), replace_all: bool = False,
                batch: tuple[str, int] | None = None, notes: dict[str, Any] | None = None) -> Manifest:
        """Make the staged partitions, less the removed ones, the next version;
        with ``replace_all`` nothing else stays.  Returns the manifest that holds
        (a batch that was published before: the current one)."""
        new = {p: staged.write for p in staged.partitions} if staged else {}
        gone = {self.folder(v) for v in remove} - set(new)
        while True:
            now = self.manifest()
            if batch and now.batches.get(batch[0], -1) >= batch[1]:
                return now
            if staged:
                touched = set(new) | gone if not replace_all else set(now.partitions) | set(staged.base.partitions)
                if any(now.partitions.get(p) != staged.base.partitions.get(p) for p in touched):
                    raise PublishConflict(f"{self.path}: version {now.version} changed the same partitions "
                                          f"since version {staged.base.version}")
            kept = {} if replace_all else {p: w for p, w in now.partitions.items() if p not in gone}
            made = Manifest(now.version + 1, {**kept, **new},
                            {**now.batches, **dict([batch])} if batch else now.batches,
                            {k: v for k, v in {**now.notes, **(notes or {})}.items() if v is not None})
            if self._put(made):
                return made

    def write(self, df: DataFrame, **how) -> Manifest:
        return self.publish(self.stage(df), **how)

    # --- reading

    def read(self, values: Iterable[Any] | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version, of the named partitions only if given: no other
        folder is listed or opened."""
        parts = self.manifest(version).partitions
        if values is not None:
            wanted = {self.folder(v) for v in values}
            parts = {p: w for p, w in parts.items() if p in wanted}
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        data = f"{self.path}/data"
        return (self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(_WRITE, T.StringType())]))
                .option("basePath", data).parquet(*[f"{data}/{_WRITE}={w}/{p}" for p, w in sorted(parts.items())])
                .select([F.col(f.name) for f in self.schema.fields]))

    # --- housekeeping

    def vacuum(self, keep: int = 2, older_than_seconds: float = DAY_SECONDS) -> int:
        """Drop all but the newest ``keep`` versions, and folders that none of
        them names and that are old enough not to be a write in progress.
        Returns the number of folders removed."""
        fs, versions, keep = self._fs(), self.versions(), max(1, keep)
        for v in versions[:-keep]:
            fs.delete(self._at("_versions", f"{v:012d}.json"), False)
        named = {(w, p) for v in versions[-keep:] for p, w in self.manifest(v).partitions.items()}
        limit, removed = (time.time() - older_than_seconds) * 1000, 0
        for name in self._names("data"):
            write = name.partition("=")[2]
            if fs.getFileStatus(self._at("data", name)).getModificationTime() > limit:
                continue
            mine = [p for p in self._names("data", name) if p.startswith(f"{self.by}=")]
            for p in mine:
                if (write, p) not in named:
                    removed += fs.delete(self._at("data", name, p), True)
            if not any((write, p) in named for p in mine):
                fs.delete(self._at("data", name), True)
        return removed
