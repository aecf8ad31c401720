"""Deduplication.

Both forms are hash aggregations with a map-side partial step, so a key that
holds a large share of the rows is collapsed before the shuffle instead of
landing whole in one sort task (which a ROW_NUMBER window would do).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.operators.skew import join_unique


def drop_all_duplicates(df: DataFrame, key: str) -> DataFrame:
    """Remove *every* row whose ``key`` occurs more than once.

    Rows with a NULL key stay (``NULL IN (...)`` is never true).  A partial +
    final count reads the key column only; the removal is an anti join that
    AQE can split, so a tag holding a large share of the rows, or many rows
    without a tag, are spread over many tasks.
    """
    repeated = (df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
                .filter(F.col("_rows") > 1).select(key))
    return join_unique(df, repeated, [key], how="left_anti").select(*df.columns)


def keep_first(df: DataFrame, keys: Sequence[str], desc_col: str, asc_col: str) -> DataFrame:
    """One row per ``keys``: the ``(desc_col, asc_col)`` values of the row that
    sorts first by ``desc_col DESC NULLS LAST, asc_col ASC NULLS LAST``.

    Both columns are 32-bit integers.  For rows where both are set,
    ``d * 2^32 + (2^31 - 1 - a)`` orders exactly like ``(d desc, a asc)`` and
    fits in a signed 64-bit long, so the survivor is found by plain
    ``max``/``min`` aggregates (fixed-width buffers: a hash aggregation with a
    map-side partial step, no sort):

    * ``max(d)`` is the survivor's ``d`` (NULL only if every ``d`` is NULL);
    * if the best packed key has that ``d``, its ``a`` is the survivor's ``a``;
      otherwise every row with the top ``d`` has a NULL ``a``;
    * if every ``d`` is NULL, the survivor's ``a`` is ``min(a)``.
    """
    d, a = F.col(desc_col).cast("long"), F.col(asc_col).cast("long")
    low = F.lit(2 ** 31 - 1)
    packed = F.when(d.isNotNull() & a.isNotNull(), F.shiftleft(d, 32) + (low - a))
    g = df.groupBy(*keys).agg(F.max(d).alias("_d"), F.max(packed).alias("_p"),
                              F.min(a).alias("_amin"))
    top_d, best = F.col("_d"), F.col("_p")
    best_a = low - best.bitwiseAND(F.lit(0xFFFFFFFF))
    chosen_a = (F.when(top_d.isNull(), F.col("_amin"))
                .when(F.shiftright(best, 32) == top_d, best_a))
    src = dict(df.dtypes)
    return g.select(*keys, top_d.cast(src[desc_col]).alias(desc_col),
                    chosen_a.cast(src[asc_col]).alias(asc_col))
