"""Incremental (daily) ranking over a stream of new flight rows."""

from tarmac.streaming.daily import rank_dates, restrict_to_dates, start_daily_ranking

__all__ = ["rank_dates", "restrict_to_dates", "start_daily_ranking"]
