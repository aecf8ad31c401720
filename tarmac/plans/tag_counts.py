"""Bag tags with their counts, maintained batch by batch.

The cleaning drops every bag of a tag that occurs more than once, on whatever
dates.  Counting the tags of all bags for that costs a scan of the whole bag
history on every daily run.  This table keeps one row per tag instead:

    bucket, tag, n (bags with the tag), day (the date of the only bag, if n = 1)

published (``sources.published``) in buckets by the hash of the tag.

* ``merge`` adds the bags of a batch: it reads and replaces the buckets of its
  tags alone, and returns the dates on which a bag is no longer its tag's only
  one.  Those dates lose a bag although nothing was delivered for them, so a
  daily run ranks them again; without them the stored ranking would drift from
  a full run.
* ``repeated`` gives the tags of some bags that occur more than once, from the
  buckets of these tags alone.
* ``rebuild`` counts a whole bag table, to begin with or after a correction
  (bags are only ever added by ``merge``).

A batch carries its number in a stream: merging it again changes nothing and
returns the same dates, so a run that failed after the merge can be repeated.

Bags without a tag are never counted (the cleaning keeps them).  A tag held by a
large share of the bags is counted before it is shuffled.  The number of buckets
is fixed when the table is made: about the number of tags over the tags that one
task should hold.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.plans.cleaning import TAG
from tarmac.sources.published import Manifest, PublishedTable

DATE = "scheduled_departure_date_local"
BUCKETS = 256
SCHEMA = T.StructType([T.StructField("tag", T.StringType()), T.StructField("n", T.LongType()),
                       T.StructField("day", T.DateType()), T.StructField("bucket", T.IntegerType())])


class TagCounts:
    """Tag counts stored at ``path`` in ``buckets`` buckets (a stored table keeps
    the number it was made with)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark = spark
        self.store = PublishedTable(spark, path, SCHEMA, "bucket")
        self._buckets = buckets

    def _number(self, manifest: Manifest) -> int:
        return manifest.notes.get("buckets", self._buckets)

    def _counted(self, bags: DataFrame, buckets: int) -> DataFrame:
        """tag, n, day, bucket of the tags of ``bags``."""
        tag = F.col(TAG)
        return (bags.filter(tag.isNotNull()).groupBy(tag.alias("tag"))
                .agg(F.count(F.lit(1)).alias("n"), F.max(DATE).alias("day"))
                .select("tag", "n", F.when(F.col("n") == 1, F.col("day")).alias("day"),
                        F.pmod(F.xxhash64("tag"), F.lit(buckets)).cast("int").alias("bucket")))

    def _bucket_numbers(self, tags: DataFrame, tag_col: str, buckets: int) -> list[int]:
        """Buckets of some tags: at most as many as the table has."""
        at = F.pmod(F.xxhash64(tag_col), F.lit(buckets)).cast("int").alias("bucket")
        return sorted(r["bucket"] for r in tags.filter(F.col(tag_col).isNotNull()).select(at).distinct().collect())

    def rebuild(self, bags: DataFrame, batch: tuple[str, int] | None = None) -> Manifest:
        """Count a whole bag table."""
        rows = self._counted(bags, self._buckets).repartition("bucket")
        return self.store.write(rows, replace_all=True, batch=batch, notes={"buckets": self._buckets})

    def merge(self, bags: DataFrame, batch: tuple[str, int] | None = None) -> list[dt.date | None]:
        """Add the bags of a batch.  Returns the dates of bags that were their
        tag's only one before and are not any more (at most the days of the
        calendar come to the driver)."""
        now = self.store.manifest()
        if batch and now.batches.get(batch[0], -1) >= batch[1]:
            return _days(now.notes.get(f"touched {batch[0]} {batch[1]}", []))
        buckets = self._number(now)
        new = self._counted(bags.select(TAG, DATE), buckets)
        old = self.store.read(self._bucket_numbers(bags, TAG, buckets), now.version)
        # shuffled by bucket once: for the sums, and to write a bucket in one piece
        both = (old.select("tag", "n", "day", "bucket", F.lit(True).alias("old"))
                .unionByName(new.withColumn("old", F.lit(False))).repartition("bucket"))
        before = F.max(F.when(F.col("old"), F.col("n")))
        merged = both.groupBy("bucket", "tag").agg(
            F.sum("n").alias("n"), F.max("day").alias("day"), before.alias("before"),
            F.max(F.when(F.col("old"), F.col("day"))).alias("was"))
        grown = merged.filter((F.col("before") == 1) & (F.col("n") > 1)).select("was").distinct()
        days = [r["was"] for r in grown.collect()]
        staged = self.store.stage(merged.select(
            "tag", "n", F.when(F.col("n") == 1, F.col("day")).alias("day"), "bucket"))
        notes = {"buckets": buckets}
        if batch:
            notes[f"touched {batch[0]} {batch[1]}"] = [d and d.isoformat() for d in days]
            # the note of the batch before the last one is not needed any more
            notes[f"touched {batch[0]} {batch[1] - 2}"] = None
        self.store.publish(staged, batch=batch, notes=notes)
        return days

    def repeated(self, tags: DataFrame, tag_col: str = TAG) -> DataFrame:
        """The tags (column ``tag_col``) that occur more than once, of those in
        ``tags``; only their buckets are read."""
        now = self.store.manifest()
        held = self.store.read(self._bucket_numbers(tags, tag_col, self._number(now)), now.version)
        wanted = tags.filter(F.col(tag_col).isNotNull()).select(F.col(tag_col).alias("tag")).distinct()
        return (held.filter(F.col("n") > 1).join(wanted, "tag", "left_semi")
                .select(F.col("tag").alias(tag_col)))


def _days(noted: list[str | None] | None) -> list[dt.date | None]:
    return [d and dt.date.fromisoformat(d) for d in noted or []]
