"""ROW_NUMBER / COUNT(*) per group that does not put a group in one task.

``ROW_NUMBER() OVER (PARTITION BY g ORDER BY o)`` as a Spark window shuffles
by ``g`` and sorts each group inside one task; a group holding a third of
the rows (one busy departure day) becomes one huge task.  This operator
ranks through a global sort instead:

1. ``orderBy(g, o, t)`` — a range-partitioned sort.  The range bounds are
   sampled over the sort keys, so a hot group is spread over many
   partitions.  ``t`` is a hash of (source partition, row): rows equal on
   ``(g, o)`` are interchangeable, so ``t`` never changes the result, but
   it lets the range partitioner split a group of identical copies (equal
   keys can only share a partition within one source partition).
2. ``monotonically_increasing_id`` after the sort gives each row
   ``partition << 33 | position``; the sorted frame is written once as a
   Parquet table in the session's reliable checkpoint folder
   (``spark.checkpoint.dir``) and read back, which cuts the lineage: a lost
   executor re-reads files instead of recomputing positions.
3. One row per (partition, group) — at most ``partitions + groups`` rows —
   holds the first position in the partition, the rows of the group in
   earlier partitions and the group size.  It reads two narrow columns.
4. Rank = position - first position + 1 + rows before, joined back on
   (partition, group); AQE broadcasts the segments if they turn out small.

With ``in_order`` the rows come out in the order of the sort: the partition of
a row is known, so they are dealt back to it by its number and sorted by
position there, without sampling the table for range bounds again.

Without it, row order is not defined.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarmac.session import scratch_path

_POS, _PART, _SEG, _FIRST, _N, _BEFORE, _SIZE, _TIE = (
    "_pos", "_part", "_seg", "_first", "_n", "_before", "_size", "_tie")


def rank_within_groups(df: DataFrame, by: Sequence[str], order: Sequence[Column],
                       rank_col: str = "rank", size_col: str | None = None,
                       in_order: bool = False) -> DataFrame:
    """Add ``rank_col`` = ROW_NUMBER() OVER (PARTITION BY by ORDER BY order)
    and, if given, ``size_col`` = COUNT(*) OVER (PARTITION BY by), both long.

    ``order`` must be a total order for a deterministic result (add tie
    breakers).  NULL group values form their own group.
    """
    spark = df.sparkSession
    by = list(by)
    keys = [F.col(c).asc_nulls_last() for c in by] + list(order) + [F.col(_TIE)]

    path = scratch_path(spark, "ranked")
    tie = F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in df.columns])
    (df.withColumn(_TIE, tie).orderBy(*keys).drop(_TIE)
     .withColumn(_POS, F.monotonically_increasing_id())
     .withColumn(_PART, F.shiftrightunsigned(F.col(_POS), 33))
     .write.mode("errorifexists").parquet(path))
    ordered = spark.read.parquet(path)

    gcols = [f"_g{i}" for i in range(len(by))]
    seg = (ordered.groupBy(F.col(_PART), *[F.col(c).alias(g) for c, g in zip(by, gcols)])
           .agg(F.min(_POS).alias(_FIRST), F.count(F.lit(1)).alias(_N)))
    earlier = Window.partitionBy(*gcols).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.select(
        F.col(_PART).alias(_SEG), *gcols, _FIRST,
        F.coalesce(F.sum(_N).over(earlier), F.lit(0)).alias(_BEFORE),
        F.sum(_N).over(Window.partitionBy(*gcols)).alias(_SIZE))

    cond = [ordered[_PART] == seg[_SEG]] + [ordered[c].eqNullSafe(seg[g])
                                             for c, g in zip(by, gcols)]
    joined = ordered.join(seg, on=cond, how="inner")
    out_cols = [F.col(c) for c in df.columns]
    out_cols.append((F.col(_POS) - F.col(_FIRST) + F.lit(1) + F.col(_BEFORE)).alias(rank_col))
    if size_col:
        out_cols.append(F.col(_SIZE).alias(size_col))
    if not in_order:
        return joined.select(*out_cols)
    out = joined.select(*out_cols, _POS, F.col(_PART).cast("int").alias(_PART))
    return out.repartitionById(_sort_partitions(spark), F.col(_PART)).sortWithinPartitions(_POS).drop(_POS, _PART)


def spread_sort(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` sorted by ``order``.  A hash of (source partition, row) as the last
    key lets the range partitioner split identical copies, whose order is free."""
    tie = F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in df.columns])
    return df.withColumn(_TIE, tie).orderBy(*order, F.col(_TIE)).drop(_TIE)


def _sort_partitions(spark: SparkSession) -> int:
    """The most partitions that a global sort of this session has."""
    first = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(first or 0))
