"""Difficulty scoring: normalisation ranges, normalised features, weighted
score, daily rank and class, and the stored ranking.

Plan shape (one job per query, all built-in operators):

* bags      -> partial+final aggregate by flight key (transfer ratio)
* bookings  -> keep-one hash aggregate by (flight key, locator)
            -> left join with remarks pre-counted by (locator, flight)
            -> one aggregate by flight key: service requests and
               seat-occupying passengers together (bookings read once)
* flights   -> the two per-key aggregates (full outer join, co-partitioned)
               attach to flight rows in one left join whose hot keys AQE
               splits (``operators.skew.join_unique``)
* ranking   -> skew-safe ROW_NUMBER per departure date
               (``tarmac.operators.ranking``)
"""

from __future__ import annotations

import datetime as dt
from typing import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tarmac import params as P
from tarmac.functions.columns import (count_where, int_div, minmax_score, ratio,
                                      tercile_label, weighted_sum)
from tarmac.operators.dedupe import keep_first
from tarmac.operators.fanout import count_join_rows
from tarmac.operators.ranking import rank_within_groups, spread_sort
from tarmac.operators.skew import join_unique
from tarmac.sources.published import Manifest, PublishedTable
from tarmac.sources.schemas import FLIGHT_DIFFICULTY
from tarmac.sources.tables import FlightTables

KEY = list(P.FLIGHT_KEY)
DATE = "scheduled_departure_date_local"
SCORE_COLS = ["ground_time_score", "transfer_score", "ssr_score", "load_factor_score"]


# ---------------------------------------------------------------- features

def transfer_ratio_by_flight(bags: DataFrame) -> DataFrame:
    """(Transfer + Hot Transfer) / NULLIF(Origin, 0) per flight key."""
    bt = F.col("bag_type")
    return bags.groupBy(*KEY).agg(
        ratio(count_where(bt.isin(*P.TRANSFER_TYPES)), count_where(bt == P.ORIGIN_TYPE))
        .alias("transfer_to_checked_ratio"))


def dedupe_bookings(bookings: DataFrame) -> DataFrame:
    """One booking per (flight key, record locator).  The source keeps an
    arbitrary copy; here the copy with most passengers, then fewest lap
    children (NULLs last), so every run and engine keeps the same values."""
    return keep_first(bookings, keys=P.BOOKING_KEY, desc_col="total_pax",
                      asc_col="lap_child_count")


def ssr_counts(remarks: DataFrame, deduped: DataFrame) -> DataFrame:
    """Remarks matched to deduplicated bookings, counted per flight key."""
    return count_join_rows(remarks, deduped, on=P.REMARK_KEY, by=KEY, right_by=[DATE],
                           name="num_special_service_requests", few_per_key=True)


def passenger_loads(deduped: DataFrame) -> DataFrame:
    """Seat-occupying passengers (passengers minus lap children) per flight key."""
    return deduped.groupBy(*KEY).agg(
        F.sum(F.col("total_pax") - F.col("lap_child_count")).alias("seat_occupying_passengers"))


def booking_features(remarks: DataFrame, bookings: DataFrame) -> DataFrame:
    """Service requests and seat-occupying passengers per flight key from one
    pass over the deduplicated bookings.

    Remarks are counted by (locator, flight) (one row per key), left-joined
    to the deduplicated bookings, and one aggregation per flight key sums
    both: ``SUM(n_remarks)`` equals the remark/booking join count of
    ``ssr_counts`` (NULL when no remark matches, like a missing key there)
    and ``SUM(total_pax - lap_child_count)`` equals ``passenger_loads``.
    Bookings are read and deduplicated once for both features.  A (locator,
    flight) key has at most one deduplicated booking per departure date, so
    no key of this join can be hot and a plain join is enough.
    """
    counted = remarks.groupBy(*P.REMARK_KEY).agg(F.count(F.lit(1)).alias("_nr"))
    j = dedupe_bookings(bookings).join(counted, list(P.REMARK_KEY), "left")
    return j.groupBy(*KEY).agg(
        F.sum("_nr").alias("num_special_service_requests"),
        F.sum(F.col("total_pax") - F.col("lap_child_count")).alias("seat_occupying_passengers"))


def _flight_inputs(t: FlightTables) -> DataFrame:
    """Flight rows with their key's bag ratio, service requests and loads.

    The two per-key aggregates meet first (both one row per key and
    partitioned on it, so no extra shuffle), then attach to the flight rows
    in one left join that AQE can split."""
    f = t.flights.select(*KEY, "scheduled_ground_time_minutes", "total_seats")
    per_key = transfer_ratio_by_flight(t.bags_of(*KEY, "bag_type")).join(
        booking_features(t.remarks, t.bookings), on=KEY, how="full")
    return join_unique(f, per_key, KEY, how="left")


def _scores(p: P.ScoreParams) -> list:
    ssr_width = p.max_ssr - p.min_ssr
    ssr = (int_div(F.coalesce("num_special_service_requests", F.lit(0)) - F.lit(p.min_ssr),
                   F.lit(ssr_width))
           if ssr_width != 0 else F.lit(None).cast("long"))
    load = ratio(F.coalesce("seat_occupying_passengers", F.lit(0)), "total_seats")
    return [
        minmax_score("scheduled_ground_time_minutes", p.min_ground, p.max_ground, invert=True)
        .alias("ground_time_score"),
        minmax_score(F.coalesce("transfer_to_checked_ratio", F.lit(0.0)), p.min_tr, p.max_tr)
        .alias("transfer_score"),
        ssr.cast("long").alias("ssr_score"),
        minmax_score(load, p.min_lf, p.max_lf).alias("load_factor_score"),
    ]


def normalized_features(t: FlightTables, p: P.ScoreParams = P.NORMALIZE_PRESET) -> DataFrame:
    """The four normalised features per flight row (unclamped).  The
    service-request score is an integer division, as in the source."""
    return normalized_from(_flight_inputs(t), p)


def normalized_from(inputs: DataFrame, p: P.ScoreParams) -> DataFrame:
    """The normalised features of flight rows that carry their key's bag ratio,
    service requests and loads."""
    return inputs.select(*KEY, *_scores(p))


def difficulty_score_col(p: P.ScoreParams):
    return weighted_sum([(p.w_ssr, "ssr_score"), (p.w_ground, "ground_time_score"),
                         (p.w_transfer, "transfer_score"), (p.w_load, "load_factor_score")])


def difficulty_scores(t: FlightTables, p: P.ScoreParams = P.SCORE_PRESET,
                      sort: bool = True) -> DataFrame:
    """Normalised features plus the weighted score, highest first."""
    return scores_from(_flight_inputs(t), p, sort)


def scores_from(inputs: DataFrame, p: P.ScoreParams, sort: bool = True) -> DataFrame:
    df = normalized_from(inputs, p).withColumn("difficulty_score", difficulty_score_col(p))
    if not sort:
        return df
    return spread_sort(df, F.col("difficulty_score").desc_nulls_first(),
                       *[F.col(c).asc_nulls_last() for c in KEY])


def rank_order():
    """Score descending with NULL first (as the source dialect sorts), then
    tie-breakers that make the order total."""
    return [F.col("difficulty_score").desc_nulls_first(),
            F.col("flight_number").asc_nulls_last(),
            *[F.col(c).desc_nulls_first() for c in SCORE_COLS]]


def daily_ranking(t: FlightTables, p: P.ScoreParams = P.SCORE_PRESET,
                  sort: bool = True) -> DataFrame:
    """Rank per departure date by score and label the top, middle and bottom
    third (integer thirds of the day's flight count).  With ``sort`` the
    output is ordered by date and rank (skip it when storing the result)."""
    return ranking_from(_flight_inputs(t), p, sort)


def ranking_from(inputs: DataFrame, p: P.ScoreParams, sort: bool = True) -> DataFrame:
    scored = scores_from(inputs, p, sort=False)
    ranked = rank_within_groups(scored, by=[DATE], order=rank_order(),
                                rank_col="daily_rank", size_col="total_flights", in_order=sort)
    return ranked.select(
        *KEY, "difficulty_score", *SCORE_COLS, "daily_rank",
        tercile_label("daily_rank", "total_flights").alias("difficulty_category"))


# ------------------------------------------------------------------ ranges

def range_ground_time(flights: DataFrame) -> DataFrame:
    g = F.col("scheduled_ground_time_minutes")
    return flights.filter(g > 0).agg(F.min(g).alias("min_ground"), F.max(g).alias("max_ground"))


def range_transfer_ratio(bags: DataFrame) -> DataFrame:
    r = transfer_ratio_by_flight(bags).filter(F.col("transfer_to_checked_ratio").isNotNull())
    return r.agg(F.min("transfer_to_checked_ratio").alias("min_tr"),
                 F.max("transfer_to_checked_ratio").alias("max_tr"))


def range_ssr(t: FlightTables) -> DataFrame:
    """Range of service requests per flight over deduplicated bookings (only
    flights with at least one request appear, so the minimum is >= 1)."""
    deduped = t.bookings.select(*P.BOOKING_KEY).distinct()
    s = ssr_counts(t.remarks, deduped)
    return s.agg(F.min("num_special_service_requests").alias("min_ssr"),
                 F.max("num_special_service_requests").alias("max_ssr"))


def range_load_factor(t: FlightTables) -> DataFrame:
    loads = passenger_loads(dedupe_bookings(t.bookings))
    lf = (join_unique(t.flights.select(*KEY, "total_seats"), loads, KEY, how="inner")
          .select(ratio("seat_occupying_passengers", "total_seats").alias("load_factor")))
    return lf.agg(F.min("load_factor").alias("min_lf"), F.max("load_factor").alias("max_lf"))


def params_from_data(t: FlightTables, base: P.ScoreParams = P.SCORE_PRESET,
                     keep_min_ssr: bool = True) -> P.ScoreParams:
    """Fill the bounds from the data (the source's workflow: compute ranges, then
    use them as constants) in one action: the scoring plan runs once, and the
    four ranges are observed where their rows pass by.  The bag ratio and the
    service requests are observed per flight key, before the flights join."""
    seen = {name: Observation(f"range_{name}") for name in ("keys", "flights", "loads")}
    g, tr = F.col("scheduled_ground_time_minutes"), F.col("transfer_to_checked_ratio")
    ssr = F.col("num_special_service_requests")
    flights = t.flights.select(*KEY, "scheduled_ground_time_minutes", "total_seats").observe(
        seen["flights"], F.min(F.when(g > 0, g)).alias("min_ground"), F.max(F.when(g > 0, g)).alias("max_ground"))
    per_key = transfer_ratio_by_flight(t.bags_of(*KEY, "bag_type")).join(
        booking_features(t.remarks, t.bookings), on=KEY, how="full").observe(
        seen["keys"], F.min(tr).alias("min_tr"), F.max(tr).alias("max_tr"),
        F.min(ssr).alias("min_ssr"), F.max(ssr).alias("max_ssr"))
    load = ratio("seat_occupying_passengers", "total_seats").alias("load_factor")
    loads = join_unique(flights, per_key, KEY, how="left").select(load).observe(
        seen["loads"], F.min("load_factor").alias("min_lf"), F.max("load_factor").alias("max_lf"))
    loads.write.format("noop").mode("overwrite").save()
    # a part of the plan that Spark drops, as one of its tables is empty, observes nothing
    instead = {"flights": lambda: [range_ground_time(t.flights)],
               "keys": lambda: [range_transfer_ratio(t.bags_of(*KEY, "bag_type")), range_ssr(t)],
               "loads": lambda: [range_load_factor(t)]}
    found = {}
    for name, o in seen.items():
        try:
            found |= o.get
        except Py4JJavaError:
            for rows in instead[name]():
                found |= rows.first().asDict()
    return bounded(base, found, keep_min_ssr)


def bounded(base: P.ScoreParams, found: dict, keep_min_ssr: bool = True) -> P.ScoreParams:
    """``base`` with the found bounds (those without data stay as they are)."""
    kinds = dict(min_ground=float, max_ground=int, min_tr=float, max_tr=float, min_ssr=int, max_ssr=int,
                 min_lf=float, max_lf=float)
    if keep_min_ssr:
        del kinds["min_ssr"]
    return base.with_bounds(**{k: as_(found[k]) for k, as_ in kinds.items() if found.get(k) is not None})


# -------------------------------------------------------------------- sink

def flight_difficulty_store(spark: SparkSession, path: str) -> PublishedTable:
    return PublishedTable(spark, path, FLIGHT_DIFFICULTY, DATE)


def write_flight_difficulty(ranked: DataFrame, path: str, dates: Iterable[dt.date | None] = (),
                            batch: tuple[str, int] | None = None) -> Manifest:
    """Store the ranking as ``flight_difficulty``, partitioned by departure date.

    The ranking's sorted table already holds every date in one contiguous run,
    so its rows are staged as they come, without another shuffle: a file of
    that table is part of one or a few dates, and a busy date is spread over
    the tasks that read its files.  Only a table of few files with many dates
    (a small backfill) is dealt over the cores by date, since the cost is then
    in making the folders.  One rename then publishes the dates present, so a
    daily run replaces its own days and leaves the others, and readers see all
    of them change at once.  ``dates`` are replaced too: one without a row goes.
    ``batch`` (stream, number) is published once.
    """
    cores = ranked.sparkSession.sparkContext.defaultParallelism
    if len(ranked.inputFiles()) < cores:
        tasks = min(cores, ranked.select(DATE).distinct().count())
        if tasks > 1:
            ranked = ranked.repartitionByRange(tasks, F.col(DATE).asc_nulls_first(), F.col("daily_rank"))
    store = flight_difficulty_store(ranked.sparkSession, path)
    return store.publish(store.stage(ranked), remove=dates, batch=batch)


def read_flight_difficulty(spark: SparkSession, path: str, dates: Iterable[dt.date | None] | None = None) -> DataFrame:
    """The newest published ranking, or only some dates of it."""
    return flight_difficulty_store(spark, path).read(dates)


__all__ = ["daily_ranking", "dedupe_bookings", "difficulty_scores", "flight_difficulty_store", "normalized_features", "normalized_from", "ranking_from", "scores_from",
           "bounded",
           "params_from_data", "passenger_loads", "range_ground_time", "range_load_factor",
           "range_ssr", "range_transfer_ratio", "read_flight_difficulty",
           "ssr_counts", "transfer_ratio_by_flight", "write_flight_difficulty", "booking_features"]
