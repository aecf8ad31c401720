"""Stored per-flight facts: what the scoring queries share, computed once.

Normalised features, scores, daily ranking, its stored form, the destination
roll-ups and the ranges all need the same aggregates per flight key: bag counts
by type, service requests and seat-occupying passengers.  Computing them reads
and shuffles bags, bookings and remarks, which are far larger than the flights.
``FlightFacts`` stores them next to the flight rows:

* one row per cleaned flight row, with its key's aggregates (NULL where the key
  has none);
* one row per flight key that has aggregates but no flight row (``is_flight``
  false): the ranges of the bag ratio and of the service requests are over all
  keys.

The table is published (``sources.published``) in parts of ``days_per_part``
departure dates.  ``refresh`` computes the aggregates of some dates again, from
the rows of these dates alone, and replaces them in one step; other dates of the
same part are carried over.

The queries here take the facts and are otherwise those of ``plans.scoring`` and
``plans.insights``: no join with bags, bookings or remarks is left in them.
"""

from __future__ import annotations

import datetime as dt
from typing import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac import params as P
from tarmac.functions.columns import count_where, ratio
from tarmac.operators.skew import join_unique
from tarmac.plans import insights, scoring
from tarmac.session import scratch_path, scratch_scope, small_tasks
from tarmac.sources.published import Manifest, PublishedTable
from tarmac.sources.tables import FlightTables

KEY = list(P.FLIGHT_KEY)
DATE = "scheduled_departure_date_local"
STATION = "scheduled_arrival_station_code"
_FLIGHT = [*KEY, STATION, "scheduled_ground_time_minutes", "total_seats"]
_MEASURES = ["transfer_bags", "origin_bags", "num_special_service_requests", "seat_occupying_passengers"]

SCHEMA = T.StructType([
    T.StructField("flight_number", T.StringType()), T.StructField(DATE, T.DateType()),
    T.StructField(STATION, T.StringType()), T.StructField("scheduled_ground_time_minutes", T.IntegerType()),
    T.StructField("total_seats", T.IntegerType()), T.StructField("is_flight", T.BooleanType()),
    *[T.StructField(m, T.LongType()) for m in _MEASURES], T.StructField("part", T.IntegerType())])


def bag_counts(bags: DataFrame) -> DataFrame:
    """Transfer (with hot transfer) and origin bags per flight key."""
    bt = F.col("bag_type")
    return bags.groupBy(*KEY).agg(count_where(bt.isin(*P.TRANSFER_TYPES)).alias("transfer_bags"),
                                  count_where(bt == P.ORIGIN_TYPE).alias("origin_bags"))


def per_key(t: FlightTables) -> DataFrame:
    """The measures per flight key, one row for every key with any."""
    return bag_counts(t.bags_of(*KEY, "bag_type")).join(
        scoring.booking_features(t.remarks, t.bookings), on=KEY, how="full")


def compute(t: FlightTables) -> DataFrame:
    """The facts of cleaned tables (without ``part``).  The measures are written
    once, as the flight rows and the keys without a flight both read them."""
    spark = t.flights.sparkSession
    path = scratch_path(spark, "measures")
    measured = per_key(t)
    measured.write.mode("errorifexists").parquet(path)
    measured = spark.read.schema(measured.schema).parquet(path)
    flights = t.flights.select(*_FLIGHT)
    with_flight = join_unique(flights, measured, KEY, how="left").withColumn("is_flight", F.lit(True))
    without = (join_unique(measured, flights.select(*KEY).distinct(), KEY, how="left_anti")
               .withColumn("is_flight", F.lit(False)))
    return with_flight.unionByName(without, allowMissingColumns=True).select(*_FLIGHT, "is_flight", *_MEASURES)


class FlightFacts:
    """Facts stored at ``path`` (a stored table keeps the days per part that it
    was made with)."""

    def __init__(self, spark: SparkSession, path: str, days_per_part: int = 1):
        self.spark, self._days = spark, days_per_part
        self.store = PublishedTable(spark, path, SCHEMA, "part")

    # --- storing

    def _part(self, days: int, date: Column) -> Column:
        return F.floor(F.unix_date(date) / F.lit(days)).cast("int")

    def _with_part(self, rows: DataFrame, days: int) -> DataFrame:
        # AQE cuts the rows of a busy part into several files and joins small ones
        return rows.withColumn("part", self._part(days, F.col(DATE))).hint("rebalance", F.col("part"))

    def build(self, t: FlightTables) -> Manifest:
        """Facts of whole cleaned tables; replaces all that is stored."""
        with scratch_scope(self.spark), small_tasks(self.spark):
            return self.store.write(self._with_part(compute(t), self._days), replace_all=True,
                                    notes={"days_per_part": self._days})

    def refresh(self, t: FlightTables, dates: Iterable[dt.date | None],
                batch: tuple[str, int] | None = None) -> Manifest:
        """Replace the facts of some departure dates by those of ``t``, the
        cleaned tables restricted to them (``streaming.daily.restrict_to_dates``)."""
        now, dates = self.store.manifest(), list(dates)
        days = now.notes.get("days_per_part", self._days)
        epoch = dt.date(1970, 1, 1)
        parts = {None if d is None else (d - epoch).days // days for d in dates}
        known = [d for d in dates if d is not None]
        changed = F.col(DATE).isin(known) if known else F.lit(False)
        if len(known) < len(dates):
            changed = changed | F.col(DATE).isNull()
        with scratch_scope(self.spark), small_tasks(self.spark):
            rows = self._with_part(compute(t), days)
            if days > 1 and now.version:
                kept = self.store.read([p for p in parts if p is not None], now.version)
                rows = kept.filter(~F.coalesce(changed, F.lit(False))).unionByName(rows)
            return self.store.write(rows, remove=parts, batch=batch, notes={"days_per_part": days})

    # --- reading

    def read(self, dates: Iterable[dt.date | None] | None = None) -> DataFrame:
        """All facts, or those of some departure dates (only their parts are read)."""
        if dates is None:
            return self.store.read()
        dates = list(dates)
        now = self.store.manifest()
        days = now.notes.get("days_per_part", self._days)
        epoch = dt.date(1970, 1, 1)
        rows = self.store.read({None if d is None else (d - epoch).days // days for d in dates}, now.version)
        known = [d for d in dates if d is not None]
        mine = F.col(DATE).isin(known) if known else F.lit(False)
        return rows.filter(mine | F.col(DATE).isNull()) if len(known) < len(dates) else rows.filter(mine)

    def inputs(self, dates: Iterable[dt.date | None] | None = None) -> DataFrame:
        """What ``scoring.normalized_from`` needs per flight row, with the
        destination."""
        return (self.read(dates).filter("is_flight")
                .select(*_FLIGHT, _bag_ratio().alias("transfer_to_checked_ratio"),
                        "num_special_service_requests", "seat_occupying_passengers"))


def _bag_ratio() -> Column:
    return ratio("transfer_bags", "origin_bags")


# ----------------------------------------------------------------- queries

def normalized_features(facts: FlightFacts, p: P.ScoreParams = P.NORMALIZE_PRESET) -> DataFrame:
    return scoring.normalized_from(facts.inputs(), p)


def difficulty_scores(facts: FlightFacts, p: P.ScoreParams = P.SCORE_PRESET, sort: bool = True) -> DataFrame:
    return scoring.scores_from(facts.inputs(), p, sort)


def daily_ranking(facts: FlightFacts, p: P.ScoreParams = P.SCORE_PRESET, sort: bool = True,
                  dates: Iterable[dt.date | None] | None = None) -> DataFrame:
    return scoring.ranking_from(facts.inputs(dates), p, sort)


def hard_destinations_above_avg(facts: FlightFacts, p: P.ScoreParams = P.SCORE_PRESET) -> DataFrame:
    return insights.hard_destinations_above_avg(facts.inputs(), difficulty_scores(facts, p, sort=False))


def hard_destinations_majority(facts: FlightFacts, p: P.ScoreParams = P.SCORE_PRESET) -> DataFrame:
    return insights.hard_destinations_majority(facts.inputs(), daily_ranking(facts, p, sort=False))


def ranges(facts: FlightFacts) -> DataFrame:
    """All bounds in one row and one pass (names as in the four range queries)."""
    g, flight = F.col("scheduled_ground_time_minutes"), F.col("is_flight")
    measure = {"ground": F.when(flight & (g > 0), g), "tr": _bag_ratio(), "ssr": F.col("num_special_service_requests"),
               "lf": F.when(flight, ratio("seat_occupying_passengers", "total_seats"))}
    return facts.read().agg(*[f(c).alias(f"{n}_{name}") for name, c in measure.items()
                              for n, f in (("min", F.min), ("max", F.max))])


def range_of(facts: FlightFacts, name: str) -> DataFrame:
    """One of the ranges: ``ground``, ``tr``, ``ssr`` or ``lf``."""
    return ranges(facts).select(f"min_{name}", f"max_{name}")


def params_from_facts(facts: FlightFacts, base: P.ScoreParams = P.SCORE_PRESET, keep_min_ssr: bool = True) -> P.ScoreParams:
    """``scoring.params_from_data`` from the stored facts: one narrow scan."""
    return scoring.bounded(base, ranges(facts).first().asDict(), keep_min_ssr)
