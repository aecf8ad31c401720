"""Attaching a scalar (one-row) aggregate to every row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Cross join with a global aggregate (no GROUP BY), which always has
    exactly one row, so broadcasting it is bounded by construction."""
    return df.crossJoin(F.broadcast(one_row))
