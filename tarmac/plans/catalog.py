"""Registry of every implemented query as ``(spark, sf_dir) -> DataFrame``.

Each entry derives the flight tables from ``sf_dir`` (the whole tables, no
sampling), applies the two cleaning steps the analysis runs on, evaluates the
query and rounds DOUBLE outputs to 6 decimals for the cross-engine check.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac import params as P
from tarmac.functions.columns import round6
from tarmac.plans import eda, facts, features, insights, scoring, stored
from tarmac.plans.cleaning import TAG
from tarmac.plans.facts import FlightFacts
from tarmac.session import result_path, scratch_scope
from tarmac.sources.bucketed import read_bucketed, write_bucketed
from tarmac.sources.derived import derived
from tarmac.sources.standin import source_files, standin_tables
from tarmac.sources.tables import FlightTables

QueryFn = Callable[[SparkSession, str], DataFrame]


def check_view(df: DataFrame) -> DataFrame:
    """Round every DOUBLE column to 6 decimals (same rule as the SQL check)."""
    return df.select([round6(f.name).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                      else F.col(f.name) for f in df.schema.fields])


def tables(spark: SparkSession, sf_dir: str) -> FlightTables:
    return standin_tables(spark, sf_dir).cleaned()


def _bag_types(t: FlightTables) -> DataFrame:
    """The bag columns that the ratio queries use."""
    return t.bags_of(*P.FLIGHT_KEY, "bag_type")


def _stored_ranking(spark: SparkSession, ranked: Callable[[], DataFrame]) -> DataFrame:
    path = result_path(spark, "flight_difficulty")
    with scratch_scope(spark):          # the ranking's sorted table goes once the result is stored
        scoring.write_flight_difficulty(ranked(), path)
    return scoring.read_flight_difficulty(spark, path)


def _flight_difficulty_table(spark: SparkSession, t: FlightTables) -> DataFrame:
    return _stored_ranking(spark, lambda: scoring.daily_ranking(t, sort=False))


def flight_facts(spark: SparkSession, sf_dir: str) -> FlightFacts:
    """The facts of ``sf_dir``, stored when a query of this application first
    needs them.  Its dates hold few rows each, hence parts of many days."""
    def build(path: str) -> None:
        FlightFacts(spark, path, days_per_part=400).build(tables(spark, sf_dir))

    return FlightFacts(spark, derived(spark, "facts", source_files(sf_dir), build))


_PLANS: dict[str, Callable[[SparkSession, FlightTables], DataFrame]] = {
    # cleaning
    "clean_flights": lambda s, t: t.flights,
    "clean_bags": lambda s, t: t.bags,
    "bag_ratio_eda_canonical": lambda s, t: eda.bag_ratio_eda(
        _bag_types(t), P.TRANSFER_TYPES, P.ORIGIN_TYPE, P.TRANSFER_TYPES),
    "avg_bag_ratio_canonical": lambda s, t: eda.avg_bag_ratio(
        _bag_types(t), P.EDA_AVG_TRANSFER, P.ORIGIN_TYPE),
    # exploration
    "departure_delay": lambda s, t: eda.departure_delay(t.flights),
    "avg_positive_delay": lambda s, t: eda.avg_positive_delay(t.flights),
    "pct_late_departures": lambda s, t: eda.pct_late_departures(t.flights),
    "tight_turnaround_flights": lambda s, t: eda.tight_turnaround_flights(t.flights),
    "tight_turnaround_count": lambda s, t: eda.tight_turnaround_count(t.flights),
    "bag_ratio_eda": lambda s, t: eda.bag_ratio_eda(_bag_types(t)),
    "avg_bag_ratio": lambda s, t: eda.avg_bag_ratio(_bag_types(t)),
    "pax_per_flight": lambda s, t: eda.pax_per_flight(t.bookings),
    "load_factor": lambda s, t: eda.load_factor(t.flights, t.bookings),
    "load_vs_delay": lambda s, t: eda.load_vs_delay(t.flights, t.bookings),
    "ssr_per_flight": lambda s, t: eda.ssr_per_flight(t.remarks, t.bookings),
    "ssr_load_delay": lambda s, t: eda.ssr_load_delay(t.flights, t.bookings, t.remarks),
    "delay_by_ssr_group": lambda s, t: eda.delay_by_ssr_group(t.flights, t.bookings, t.remarks),
    # features
    "ground_time_margin": lambda s, t: features.ground_time_margin(t.flights),
    "bags_per_pax": lambda s, t: features.bags_per_pax(
        t.bags_of(*P.FLIGHT_KEY, TAG), t.bookings),
    "transfer_to_checked_ratio": lambda s, t: features.transfer_to_checked_ratio(_bag_types(t)),
    "lap_children_ratio": lambda s, t: features.lap_children_ratio(t.bookings),
    "haul_category": lambda s, t: features.haul(t.flights),
    "fleet_rarity": lambda s, t: features.fleet_rarity(t.flights),
    "ssr_per_pax": lambda s, t: features.ssr_per_pax(t.remarks, t.bookings),
    "temporal_features": lambda s, t: features.temporal_features(t.flights),
    # normalisation ranges
    "range_ground_time": lambda s, t: scoring.range_ground_time(t.flights),
    "range_transfer_ratio": lambda s, t: scoring.range_transfer_ratio(_bag_types(t)),
    "range_ssr": lambda s, t: scoring.range_ssr(t),
    "range_load_factor": lambda s, t: scoring.range_load_factor(t),
    # score, rank, store
    "normalized_features": lambda s, t: scoring.normalized_features(t, P.NORMALIZE_PRESET),
    "difficulty_score": lambda s, t: scoring.difficulty_scores(t, P.SCORE_PRESET),
    "daily_ranking": lambda s, t: scoring.daily_ranking(t, P.SCORE_PRESET),
    "daily_ranking_ssr10": lambda s, t: scoring.daily_ranking(
        t, P.SCORE_PRESET.with_bounds(max_ssr=10)),
    "flight_difficulty_table": _flight_difficulty_table,
    # destination roll-ups
    "hard_destinations_above_avg": lambda s, t: insights.hard_destinations_above_avg(
        t.flights, scoring.difficulty_scores(t, P.SCORE_PRESET, sort=False)),
    "hard_destinations_majority": lambda s, t: insights.hard_destinations_majority(
        t.flights, scoring.daily_ranking(t, P.SCORE_PRESET, sort=False)),
}

# the same over the stored facts, which the registered queries use
_FACT_PLANS: dict[str, Callable[[SparkSession, FlightFacts], DataFrame]] = {
    "range_transfer_ratio": lambda s, f: facts.range_of(f, "tr"),
    "range_ssr": lambda s, f: facts.range_of(f, "ssr"),
    "range_load_factor": lambda s, f: facts.range_of(f, "lf"),
    # score, rank, store
    "normalized_features": lambda s, f: facts.normalized_features(f, P.NORMALIZE_PRESET),
    "difficulty_score": lambda s, f: facts.difficulty_scores(f, P.SCORE_PRESET),
    "daily_ranking": lambda s, f: facts.daily_ranking(f, P.SCORE_PRESET),
    "daily_ranking_ssr10": lambda s, f: facts.daily_ranking(f, P.SCORE_PRESET.with_bounds(max_ssr=10)),
    "flight_difficulty_table": lambda s, f: _stored_ranking(s, lambda: facts.daily_ranking(f, sort=False)),
    # destination roll-ups
    "hard_destinations_above_avg": lambda s, f: facts.hard_destinations_above_avg(f),
    "hard_destinations_majority": lambda s, f: facts.hard_destinations_majority(f),
}

# queries of the co-partitioned store
_STORED_PLANS: dict[str, Callable[[stored.Store], DataFrame]] = {
    "load_factor_stored": stored.load_factor,
    "bags_per_pax_stored": stored.bags_per_pax,
    "ssr_per_pax_stored": stored.ssr_per_pax,
}

FACT_QUERIES, STORED_QUERIES = tuple(_FACT_PLANS), tuple(_STORED_PLANS)


def flight_store(spark: SparkSession, sf_dir: str) -> stored.Store:
    """The cleaned tables of ``sf_dir`` in buckets, stored when a query of this
    application first needs them."""
    path = derived(spark, "bucketed", source_files(sf_dir),
                   lambda path: write_bucketed(tables(spark, sf_dir), path, buckets=8))
    return read_bucketed(spark, path)


def _registered(name: str) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if name in _STORED_PLANS:
            return check_view(_STORED_PLANS[name](flight_store(spark, sf_dir)))
        if name in _FACT_PLANS:
            return check_view(_FACT_PLANS[name](spark, flight_facts(spark, sf_dir)))
        return check_view(_PLANS[name](spark, tables(spark, sf_dir)))

    run.__name__ = name
    return run


def queries() -> dict[str, QueryFn]:
    return {name: _registered(name) for name in (*_PLANS, *_STORED_PLANS)}
