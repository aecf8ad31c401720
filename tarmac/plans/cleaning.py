"""Cleaning steps that run before every analysis query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.operators.dedupe import drop_all_duplicates


TAG = "bag_tag_unique_number"


def clean_bags(bags: DataFrame, *columns: str) -> DataFrame:
    """Delete every row of a bag tag that occurs more than once (no copy is
    kept); rows with a NULL tag stay.  With ``columns`` only those are read
    (besides the tag) and returned."""
    if not columns:
        return drop_all_duplicates(bags, TAG)
    return drop_all_duplicates(bags.select(*dict.fromkeys([*columns, TAG])), TAG).select(*columns)


def clean_flights(flights: DataFrame) -> DataFrame:
    """Delete flights whose scheduled ground time is <= 0.  A DELETE keeps
    rows where the predicate is NULL, so a NULL ground time stays."""
    g = F.col("scheduled_ground_time_minutes")
    return flights.filter((g > 0) | g.isNull())
