"""Column helpers."""

from tarmac.functions.columns import (count_where, departure_bank, haul_category,
                                      hours_between, int_div, minmax_score, minutes_between,
                                      padded_day_name, pct, pct_round2, ratio, round6,
                                      tercile_label, weighted_sum)

__all__ = ["count_where", "departure_bank", "haul_category", "hours_between", "int_div",
           "minmax_score", "minutes_between", "padded_day_name", "pct", "pct_round2",
           "ratio", "round6", "tercile_label", "weighted_sum"]
