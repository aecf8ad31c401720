"""Joining a large table to a one-row-per-key table when keys may be hot.

AQE splits a skewed partition of a sort-merge join only when both join inputs
are fresh shuffles.  A one-row-per-key side is usually an aggregate that
already sits on the join's hash partitioning, so a plain join reuses that
partitioning and AQE leaves a hot key of the large side in a single task
(measured in SKEW.md).  ``join_unique`` adds a bit of the key's hash as one more
join key (a whole hash would not compress in the shuffle).  The aggregate's partitioning does not cover it, so both inputs are
shuffled afresh and AQE splits any partition that turns out large, a hot key
or the NULL keys of an outer join alike, by the actual sizes of the run.  The
large side is read and shuffled once; the price is a second shuffle of the
per-key side, which has one row per key.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FRESH = "_fresh"


def join_unique(big: DataFrame, per_key: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """``big JOIN per_key USING (on)`` for ``how`` in inner / left / left_anti,
    where ``per_key`` has at most one row per non-NULL key.  Output columns
    are those of the plain using-join, in the same order."""
    if how not in ("inner", "left", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    on = list(on)
    bit = F.pmod(F.hash(*on), F.lit(2)).cast("byte")
    return (big.withColumn(_FRESH, bit)
            .join(per_key.withColumn(_FRESH, bit), on=[*on, _FRESH], how=how).drop(_FRESH))


def join_stored(big: DataFrame, per_key: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """``join_unique`` for inputs that lie bucketed on (part of) ``on`` and hold no
    hot key (``sources.bucketed``): a plain join, which reads bucket by bucket
    without a shuffle."""
    return big.join(per_key, on=list(on), how=how)
