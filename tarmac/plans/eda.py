"""Exploratory queries: departure delay, turnaround, bags, load, service
requests.  Inputs are the cleaned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac import params as P
from tarmac.functions.columns import count_where, mean_minutes, micros_between, minutes_between, pct, ratio
from tarmac.operators.fanout import count_join_rows
from tarmac.operators.ranking import spread_sort
from tarmac.operators.skew import join_unique

KEY = list(P.FLIGHT_KEY)
SCHED_DEP = "scheduled_departure_datetime_local"
ACTUAL_DEP = "actual_departure_datetime_local"


def departure_delay_col():
    return minutes_between(SCHED_DEP, ACTUAL_DEP)


def _late():
    return F.col(ACTUAL_DEP) > F.col(SCHED_DEP)


def tie_breakers(cols=KEY):
    """Extra sort keys after the query's own: any order of ties is valid, and
    distinct trailing keys let the range partitioner of a global sort split a
    value shared by many rows instead of sending them all to one task."""
    return [F.col(c).asc_nulls_last() for c in cols]


def departure_delay(flights: DataFrame) -> DataFrame:
    """Signed departure delay in minutes per flight, by scheduled departure."""
    return (flights.select(*KEY, SCHED_DEP, ACTUAL_DEP,
                           departure_delay_col().alias("departure_delay_mins"))
            .transform(spread_sort, F.col(SCHED_DEP).asc_nulls_last(), *tie_breakers())
            .drop("scheduled_departure_date_local"))


def avg_positive_delay(flights: DataFrame) -> DataFrame:
    """Mean delay over flights that left after their scheduled time."""
    return (flights.filter(_late())
            .agg(mean_minutes(micros_between(SCHED_DEP, ACTUAL_DEP)).alias("avg_departure_delay_mins")))


def pct_late_departures(flights: DataFrame) -> DataFrame:
    """Percent of late flights among flights with positive ground time; a
    NULL actual time counts as not late but stays in the denominator."""
    return (flights.filter(F.col("scheduled_ground_time_minutes") > 0)
            .agg(pct(count_where(_late()), F.count(F.lit(1))).alias("pct_late_departures")))


def _tight(flights: DataFrame) -> DataFrame:
    return flights.filter(F.col("scheduled_ground_time_minutes") <= F.col("minimum_turn_minutes"))


def tight_turnaround_flights(flights: DataFrame) -> DataFrame:
    """Flights scheduled at or below their minimum turn time."""
    return _tight(flights).select(*KEY, "scheduled_ground_time_minutes", "minimum_turn_minutes")


def tight_turnaround_count(flights: DataFrame) -> DataFrame:
    return _tight(flights).agg(F.count(F.lit(1)).alias("num_flights_with_tight_turnaround"))


def bag_ratio_eda(bags: DataFrame,
                  counted_transfer=P.EDA_RATIO_COUNTED_TRANSFER,
                  origin: str = P.EDA_RATIO_ORIGIN,
                  divided_transfer=P.EDA_RATIO_DIVIDED_TRANSFER) -> DataFrame:
    """Transfer/origin bag counts and ratio per flight with the exploration's
    own bag-type literals (they differ from the scoring literals)."""
    bt = F.col("bag_type")
    return bags.groupBy(*KEY).agg(
        count_where(bt.isin(*counted_transfer)).alias("transfer_bags"),
        count_where(bt == origin).alias("origin_bags"),
        ratio(count_where(bt.isin(*divided_transfer)), count_where(bt == origin))
        .alias("transfer_to_origin_ratio"))


def avg_bag_ratio(bags: DataFrame, transfer: str = P.EDA_AVG_TRANSFER,
                  checked: str = P.EDA_AVG_CHECKED) -> DataFrame:
    """Mean over flights of the transfer/checked ratio, NULL ratios excluded.

    The ratios of flights with equal checked bags share a divisor, so they are
    summed as integers; one decimal quotient per divisor is left to add, which is
    the same in any order, unlike a sum of doubles."""
    bt = F.col("bag_type")
    per_flight = bags.groupBy(*KEY).agg(count_where(bt == transfer).alias("_t"),
                                        count_where(bt == checked).alias("_c")).filter(F.col("_c") != 0)
    by_divisor = per_flight.groupBy("_c").agg(F.sum("_t").alias("_t"), F.count(F.lit(1)).alias("_n"))
    part = F.col("_t").cast("decimal(20,0)") / F.col("_c").cast("decimal(12,0)")
    return by_divisor.agg((F.sum(part).cast("double") / F.nullif(F.sum("_n"), F.lit(0)))
                          .alias("avg_transfer_to_checked_ratio"))


def pax_per_flight(bookings: DataFrame, name: str = "total_passengers") -> DataFrame:
    """Passengers per flight key over all booking rows."""
    return bookings.groupBy(*KEY).agg(F.sum("total_pax").alias(name))


def _with_load(flights: DataFrame, bookings: DataFrame, join) -> DataFrame:
    f = flights.select(*KEY, "total_seats", SCHED_DEP, ACTUAL_DEP)
    return (join(f, pax_per_flight(bookings), KEY, how="inner")
            .withColumn("load_factor", ratio("total_passengers", "total_seats")))


def load_factor(flights: DataFrame, bookings: DataFrame, join=join_unique) -> DataFrame:
    """Passengers / seats per flight (flights without bookings drop out)."""
    return _with_load(flights, bookings, join).select(*KEY, "total_seats", "total_passengers",
                                                      "load_factor")


def load_vs_delay(flights: DataFrame, bookings: DataFrame, join=join_unique) -> DataFrame:
    """Load factor next to departure delay per flight."""
    return _with_load(flights, bookings, join).select(
        *KEY, "load_factor", departure_delay_col().alias("departure_delay_mins"))


def ssr_per_flight(remarks: DataFrame, bookings: DataFrame) -> DataFrame:
    """Remark rows matched to booking rows per flight key (each booking copy
    counts), computed as a sum of per-key count products."""
    return count_join_rows(remarks, bookings, on=P.REMARK_KEY, by=KEY,
                           right_by=["scheduled_departure_date_local"],
                           name="num_special_service_requests")


def ssr_load_delay(flights: DataFrame, bookings: DataFrame, remarks: DataFrame,
                   with_passengers: bool = True, micros: bool = False) -> DataFrame:
    """Late flights with passengers and service requests (0 when none).

    The late filter touches only flights, so it runs before the joins.  The
    passenger aggregate has one row per flight key, so a left join with it
    never changes the rows; callers that do not read ``total_passengers``
    pass ``with_passengers=False`` and skip that aggregation.  With ``micros``
    the delay comes as whole microseconds.
    """
    f = flights.filter(_late()).select(*KEY, "total_seats", SCHED_DEP, ACTUAL_DEP)
    per_key = ssr_per_flight(remarks, bookings)
    if with_passengers:
        per_key = pax_per_flight(bookings).join(per_key, on=KEY, how="full")
    j = join_unique(f, per_key, KEY, how="left")
    cols = [*KEY, "total_seats"]
    if with_passengers:
        cols.append(F.coalesce("total_passengers", F.lit(0)).alias("total_passengers"))
    cols += [F.coalesce("num_special_service_requests", F.lit(0))
             .alias("num_special_service_requests"),
             micros_between(SCHED_DEP, ACTUAL_DEP).alias("departure_delay_micros") if micros
             else departure_delay_col().alias("departure_delay_mins")]
    return j.select(*cols)


def delay_by_ssr_group(flights: DataFrame, bookings: DataFrame, remarks: DataFrame,
                       high_at: int = P.HIGH_SSR_AT) -> DataFrame:
    """Mean delay of late flights with >= ``high_at`` requests vs the rest."""
    t = ssr_load_delay(flights, bookings, remarks, with_passengers=False, micros=True)
    group = (F.when(F.col("num_special_service_requests") >= high_at, "High SSR")
             .otherwise("Low SSR"))
    return t.groupBy(group.alias("ssr_group")).agg(
        mean_minutes("departure_delay_micros").alias("avg_departure_delay_mins"))
