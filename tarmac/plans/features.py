"""Feature families: ground time, bags, children, haul, fleet, service
requests, departure time.  Inputs are the cleaned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac import params as P
from tarmac.functions.columns import (count_where, departure_bank, haul_category, hours_between,
                                      padded_day_name, pct, ratio)
from tarmac.operators.scalar import attach_scalar
from tarmac.plans.eda import pax_per_flight, ssr_per_flight, tie_breakers

KEY = list(P.FLIGHT_KEY)
STATIONS = ["scheduled_departure_station_code", "scheduled_arrival_station_code"]


def ground_time_margin(flights: DataFrame) -> DataFrame:
    """Scheduled ground time minus minimum turn time."""
    return flights.select(
        *KEY, *STATIONS, "scheduled_ground_time_minutes", "minimum_turn_minutes",
        (F.col("scheduled_ground_time_minutes") - F.col("minimum_turn_minutes"))
        .alias("ground_time_margin"))


def bags_per_pax(bags: DataFrame, bookings: DataFrame) -> DataFrame:
    """``bags_per_pax_rows``, highest first."""
    return highest_first(bags_per_pax_rows(bags, bookings), "bags_per_pax")


def highest_first(df: DataFrame, name: str) -> DataFrame:
    return df.orderBy(F.col(name).desc_nulls_first(), *tie_breakers())


def bags_per_pax_rows(bags: DataFrame, bookings: DataFrame) -> DataFrame:
    """Bags per passenger as the source computes it: over the join of bag rows
    with booking rows of the same flight key, so ``total_bags`` is multiplied
    by the bookings of the flight and ``total_pax`` by its bags.

    Built by eager aggregation: per flight key, bags give ``nb`` rows and
    ``nt`` non-NULL tags, bookings give ``np`` rows and ``sp`` passengers; the
    join has ``COUNT(tag) = nt*np`` and ``SUM(total_pax) = nb*sp``.  Linear
    instead of quadratic in the rows of a flight.
    """
    b = bags.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_nb"),
                               F.count("bag_tag_unique_number").alias("_nt"))
    p = bookings.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_np"),
                                   F.sum("total_pax").alias("_sp"))
    j = b.join(p, on=KEY, how="inner")
    total_bags = (F.col("_nt") * F.col("_np")).alias("total_bags")
    total_pax = (F.col("_nb") * F.col("_sp")).alias("total_pax")
    return (j.select(*KEY, total_bags, total_pax)
            .withColumn("bags_per_pax", ratio("total_bags", "total_pax")))


def transfer_to_checked_ratio(bags: DataFrame) -> DataFrame:
    """Transfer + hot-transfer bags over origin bags per flight key."""
    bt = F.col("bag_type")
    transfer = count_where(bt.isin(*P.TRANSFER_TYPES))
    checked = count_where(bt == P.ORIGIN_TYPE)
    return bags.groupBy(*KEY).agg(transfer.alias("transfer_bags"),
                                  checked.alias("checked_bags"),
                                  ratio(transfer, checked).alias("transfer_to_checked_ratio"))


def lap_children_ratio(bookings: DataFrame) -> DataFrame:
    """``lap_children_rows``, highest first."""
    return highest_first(lap_children_rows(bookings), "lap_children_ratio")


def lap_children_rows(bookings: DataFrame) -> DataFrame:
    """Lap children over passengers per flight key."""
    return (bookings.groupBy(*KEY)
            .agg(F.sum("lap_child_count").alias("lap_children"),
                 F.sum("total_pax").alias("total_passengers"))
            .withColumn("lap_children_ratio", ratio("lap_children", "total_passengers")))


def haul(flights: DataFrame) -> DataFrame:
    """Scheduled block hours and the short/medium/long class."""
    hours = hours_between("scheduled_departure_datetime_local", "scheduled_arrival_datetime_local")
    return flights.select(*KEY, *STATIONS, hours.alias("scheduled_haul_hours"),
                          haul_category(hours).alias("haul_category"))


def fleet_rarity(flights: DataFrame, rare_below: float = P.RARE_BELOW_PCT) -> DataFrame:
    """Share of flights per (fleet type, carrier) and a rare/common flag.

    The total is a one-row aggregate attached by a size-1 broadcast, not a
    window over the whole table (which would move every row to one task).
    """
    counts = flights.groupBy("fleet_type", "carrier").agg(F.count(F.lit(1)).alias("n_flights"))
    total = counts.agg(F.sum("n_flights").alias("total_flights"))
    share = pct("n_flights", "total_flights")
    return (attach_scalar(counts, total)
            .select("fleet_type", "carrier", "n_flights", "total_flights",
                    share.alias("pct_of_flights"),
                    F.when(share < rare_below, "Rare").otherwise("Common").alias("rarity_flag"))
            .orderBy(F.col("pct_of_flights").asc_nulls_last(), F.col("carrier").asc_nulls_last(),
                     F.col("fleet_type").asc_nulls_last()))


def ssr_per_pax(remarks: DataFrame, bookings: DataFrame) -> DataFrame:
    """Service requests per passenger per flight key (both from all bookings)."""
    ssr = ssr_per_flight(remarks, bookings)
    pax = pax_per_flight(bookings, name="total_pax")
    return (ssr.join(pax, on=KEY, how="inner")
            .select(*KEY, "num_special_service_requests", "total_pax",
                    ratio("num_special_service_requests", "total_pax").alias("ssr_per_pax")))


def temporal_features(flights: DataFrame) -> DataFrame:
    """Departure hour, departure bank and padded weekday name."""
    hour = F.hour("scheduled_departure_datetime_local")
    return flights.select(*KEY, hour.alias("departure_hour"),
                          departure_bank(hour).alias("departure_bank"),
                          padded_day_name("scheduled_departure_date_local").alias("day_of_week"))
