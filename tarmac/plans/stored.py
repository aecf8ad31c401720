"""Per-flight queries on the co-partitioned store (``sources.bucketed``).

Every function takes both halves of a store.  The cold half is aggregated and
joined bucket by bucket; the hot half goes through the plans that split hot keys.
A flight key lies in one half only, so the result per key is their union.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac import params as P
from tarmac.functions.columns import ratio
from tarmac.operators.skew import join_stored, join_unique
from tarmac.plans import eda, features
from tarmac.sources.bucketed import StoredTables

KEY = list(P.FLIGHT_KEY)
Store = tuple[StoredTables, StoredTables]


def per_key(store: Store, plan: Callable[[StoredTables, Callable], DataFrame]) -> DataFrame:
    """``plan(tables, join)`` on both halves."""
    cold, hot = store
    return plan(cold, join_stored).unionByName(plan(hot, join_unique))


def pax_per_flight(store: Store) -> DataFrame:
    return per_key(store, lambda t, join: eda.pax_per_flight(t.bookings))


def load_factor(store: Store) -> DataFrame:
    return per_key(store, lambda t, join: eda.load_factor(t.flights, t.bookings, join))


def load_vs_delay(store: Store) -> DataFrame:
    return per_key(store, lambda t, join: eda.load_vs_delay(t.flights, t.bookings, join))


def transfer_to_checked_ratio(store: Store) -> DataFrame:
    return per_key(store, lambda t, join: features.transfer_to_checked_ratio(t.bags))


def bags_per_pax(store: Store) -> DataFrame:
    rows = per_key(store, lambda t, join: features.bags_per_pax_rows(t.bags, t.bookings))
    return features.highest_first(rows, "bags_per_pax")


def lap_children_ratio(store: Store) -> DataFrame:
    return features.highest_first(per_key(store, lambda t, join: features.lap_children_rows(t.bookings)),
                                  "lap_children_ratio")


def matched_remarks(t: StoredTables, join: Callable) -> DataFrame:
    """Booking rows with the number of their remarks, from the tables in buckets
    by record locator and flight number."""
    counted = t.remarks.groupBy(*P.REMARK_KEY).agg(F.count(F.lit(1)).alias("_n"))
    return join(t.locators.select(*P.BOOKING_KEY), counted, P.REMARK_KEY, how="inner").select(*KEY, "_n")


def ssr_per_flight(store: Store) -> DataFrame:
    return (per_key(store, matched_remarks).groupBy(*KEY)
            .agg(F.sum("_n").alias("num_special_service_requests")))


def ssr_per_pax(store: Store) -> DataFrame:
    ssr = ssr_per_flight(store)
    return per_key(store, lambda t, join: ssr.join(eda.pax_per_flight(t.bookings, name="total_pax"), KEY)).select(
        *KEY, "num_special_service_requests", "total_pax",
        ratio("num_special_service_requests", "total_pax").alias("ssr_per_pax"))
