"""Relational building blocks composed from DataFrame operations."""

from tarmac.operators.dedupe import drop_all_duplicates, keep_first
from tarmac.operators.fanout import count_join_rows
from tarmac.operators.ranking import rank_within_groups
from tarmac.operators.scalar import attach_scalar
from tarmac.operators.skew import join_unique

__all__ = ["attach_scalar", "count_join_rows", "drop_all_duplicates", "keep_first",
           "rank_within_groups", "join_unique"]
