"""Counting the rows of a many-to-many join without building it.

``COUNT(*)`` of ``L JOIN R ON k`` grouped by ``G`` equals ``SUM(nL)`` over
``(L counted by k) JOIN R`` grouped by ``G`` when ``G`` is drawn from ``k``
and R's columns.  Counting one side by the join key first makes it unique per
key, so the join emits at most one row per R row: linear work, where the
direct join is quadratic in the size of a hot key.  A hot key of R is split by
AQE (``operators.skew.join_unique``) unless the caller knows that R has few
rows per key.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.operators.skew import join_unique


def count_join_rows(left: DataFrame, right: DataFrame, on: Sequence[str],
                    by: Sequence[str], name: str,
                    right_by: Sequence[str] = (), few_per_key: bool = False) -> DataFrame:
    """``SELECT by, COUNT(*) AS name FROM left JOIN right USING (on) GROUP BY by``.

    ``by`` must be drawn from ``on`` and ``right_by`` (columns of ``right``).
    NULL join keys never match, as in SQL.  ``few_per_key``: ``right`` holds
    few rows per key (its rows are unique in ``on`` and ``right_by``), so a
    plain join on the counts' partitioning is enough.
    """
    on = list(on)
    counted = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_nl"))
    r = right.select(*on, *[c for c in right_by if c not in on])
    joined = r.join(counted, on) if few_per_key else join_unique(r, counted, on, how="inner")
    return (joined
            .groupBy(*by).agg(F.sum("_nl").alias(name)))
