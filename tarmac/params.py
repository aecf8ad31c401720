"""Scoring parameters and the fixed values the queries must reproduce.

Fixed values (must equal the reference for the same results):
  normalisation presets      ground 1.0 .. 33327, transfer ratio 0.0 .. 134.0,
                             service requests 1 .. 27 (step 2) or 0 .. 27
                             (steps 3 and 4), load factor 0.06 .. 1.02
  score weights              service requests 0.3, ground time 0.3,
                             transfer ratio 0.2, load factor 0.2
  bag types (scoring)        transfer: 'Transfer', 'Hot Transfer'; origin: 'Origin'
  bag types (exploration)    step 1 counts 'Transfer', 'Hot ransfer' against
                             'origin' and divides 'transfer', 'hot transfer';
                             step 2 counts 'Transfer' against 'Checked'
  service-request groups     'High SSR' at >= 5 requests, else 'Low SSR'
  fleet rarity               'Rare' below 5 percent of flights, else 'Common'
  haul classes               'Short Haul' < 2 h, 'Medium Haul' 2..5 h, else 'Long Haul'
  departure banks            'Early Morning' < 7, 'Morning' 7..12,
                             'Afternoon' 13..18, else 'Evening/Night'
  daily classes              'Difficult' rank <= n div 3, 'Medium' rank <= 2n div 3,
                             else 'Easy'
  destination classes        'Difficult' mean >= 0.5, 'Medium' mean >= 0.3, else 'Easy'
  majority test              share of 'Difficult' flights > 0.5
"""

from __future__ import annotations

from dataclasses import dataclass, replace

FLIGHT_KEY = ("flight_number", "scheduled_departure_date_local")
BOOKING_KEY = ("flight_number", "scheduled_departure_date_local", "record_locator")
REMARK_KEY = ("record_locator", "flight_number")

TRANSFER_TYPES = ("Transfer", "Hot Transfer")
ORIGIN_TYPE = "Origin"

EDA_RATIO_COUNTED_TRANSFER = ("Transfer", "Hot ransfer")
EDA_RATIO_ORIGIN = "origin"
EDA_RATIO_DIVIDED_TRANSFER = ("transfer", "hot transfer")
EDA_AVG_TRANSFER = "Transfer"
EDA_AVG_CHECKED = "Checked"

HIGH_SSR_AT = 5
RARE_BELOW_PCT = 5
DESTINATION_DIFFICULT_AT = 0.5
DESTINATION_MEDIUM_AT = 0.3
MAJORITY_SHARE = 0.5


@dataclass(frozen=True)
class ScoreParams:
    """Min/max bounds of the four normalised features plus the weights.

    ``min_ssr``/``max_ssr`` are integers: the service-request score is an
    integer division in the scored plans (0 below ``max_ssr`` requests).
    """

    min_ground: float = 1.0
    max_ground: int = 33327
    min_tr: float = 0.0
    max_tr: float = 134.0
    min_ssr: int = 0
    max_ssr: int = 27
    min_lf: float = 0.06
    max_lf: float = 1.02
    w_ssr: float = 0.3
    w_ground: float = 0.3
    w_transfer: float = 0.2
    w_load: float = 0.2

    def with_bounds(self, **bounds) -> "ScoreParams":
        return replace(self, **bounds)


# Step 2 (normalisation only) starts service requests at 1; steps 3 and 4 at 0.
NORMALIZE_PRESET = ScoreParams(min_ssr=1)
SCORE_PRESET = ScoreParams()
