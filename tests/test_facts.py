"""Stored per-flight facts give what the plans over the raw tables give."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from minidata import MON, SUN, mini_tables
from tarmac import params as P
from tarmac.plans import facts, insights, scoring
from tarmac.plans.catalog import flight_facts, queries, tables
from tarmac.plans.facts import FlightFacts
from tarmac.sources.derived import derived
from tarmac.streaming.daily import restrict_to_dates

DATE = "scheduled_departure_date_local"
SF = "/root/testdata/sf0.001"


def held(df):
    names = sorted(df.columns)
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(names).collect()), key=repr)


@pytest.fixture(scope="module")
def raw(spark):
    return mini_tables(spark)


@pytest.fixture
def stored(spark, raw, tmp_path):
    f = FlightFacts(spark, str(tmp_path / "facts"))
    f.build(raw.cleaned())
    return f


def check_queries(f, t, presets=(P.SCORE_PRESET,)):
    flights = t.flights
    for p in presets:
        assert held(facts.normalized_features(f, p)) == held(scoring.normalized_features(t, p))
        assert held(facts.difficulty_scores(f, p)) == held(scoring.difficulty_scores(t, p))
        assert held(facts.daily_ranking(f, p)) == held(scoring.daily_ranking(t, p))
        scored, ranked = scoring.difficulty_scores(t, p, sort=False), scoring.daily_ranking(t, p, sort=False)
        assert held(facts.hard_destinations_above_avg(f, p)) == held(insights.hard_destinations_above_avg(flights, scored))
        assert held(facts.hard_destinations_majority(f, p)) == held(insights.hard_destinations_majority(flights, ranked))
    check_ranges(f, t)


def check_ranking(f, t):
    """The ranking needs every feature; the ranges also keys without a flight."""
    assert held(facts.daily_ranking(f)) == held(scoring.daily_ranking(t))
    check_ranges(f, t)


def check_ranges(f, t):
    flights = t.flights
    assert held(facts.range_of(f, "tr")) == held(scoring.range_transfer_ratio(t.bags))
    assert held(facts.range_of(f, "ssr")) == held(scoring.range_ssr(t))
    assert held(facts.range_of(f, "lf")) == held(scoring.range_load_factor(t))
    assert held(facts.range_of(f, "ground")) == held(scoring.range_ground_time(flights))


def test_queries_on_the_mini_tables(raw, stored):
    check_queries(stored, raw.cleaned(), (P.NORMALIZE_PRESET, P.SCORE_PRESET.with_bounds(max_ssr=2)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_queries_on_the_stand_in_tables(spark):
    check_queries(flight_facts(spark, SF), tables(spark, SF))


def test_keys_without_a_flight_count_in_the_ranges(spark, raw, tmp_path):
    no_flights = raw.replace(flights=lambda: raw.flights.limit(0)).cleaned()
    f = FlightFacts(spark, str(tmp_path / "f"))
    f.build(no_flights)
    assert f.inputs().count() == 0 and f.read().count() > 0
    check_queries(f, no_flights)


def test_null_keys(spark, raw, tmp_path):
    def blank(df):
        return df.unionByName(df.limit(3).withColumn("flight_number", F.lit(None).cast("string"))
                              ).unionByName(df.limit(2).withColumn(DATE, F.lit(None).cast("date")))
    t = raw.replace(flights=lambda: blank(raw.flights), bags=lambda: blank(raw.bags).withColumn(
        "bag_tag_unique_number", F.monotonically_increasing_id().cast("string")),
        bookings=lambda: blank(raw.bookings)).cleaned()
    for days in (30,):
        f = FlightFacts(spark, str(tmp_path / f"f{days}"), days_per_part=days)
        f.build(t)
        check_ranking(f, t)


@pytest.mark.parametrize("days", [1, 1000])
def test_refresh_of_one_date(spark, raw, tmp_path, days):
    """New rows of Monday arrive; its refresh equals facts of all tables."""
    f = FlightFacts(spark, str(tmp_path / "f"), days_per_part=days)
    f.build(raw.cleaned())
    before = f.store.manifest()
    late = raw.flights.filter(F.col(DATE) == MON).limit(1).withColumn("flight_number", F.lit("999"))
    pax = raw.bookings.filter(F.col(DATE) == MON).limit(1).withColumn("flight_number", F.lit("999"))
    lost = raw.bags.filter((F.col(DATE) != MON) | (F.col("bag_type") != "Transfer"))
    t = raw.replace(flights=lambda: raw.flights.unionByName(late), bookings=lambda: raw.bookings.unionByName(pax),
                    bags=lambda: lost)
    assert held(facts.daily_ranking(f)) != held(scoring.daily_ranking(t.cleaned()))
    f.refresh(restrict_to_dates(t, [MON]), [MON])
    check_ranking(f, t.cleaned())
    assert [r[0] for r in f.read([SUN]).select(DATE).distinct().collect()] == [SUN]
    if days == 1:                       # Sunday's folder is the same one
        now = f.store.manifest()
        sunday = f.store.folder((SUN - dt.date(1970, 1, 1)).days)
        assert now.partitions[sunday] == before.partitions[sunday]
        assert all(f"part={(SUN - dt.date(1970, 1, 1)).days}/" in x for x in f.read([SUN]).inputFiles())


def test_refresh_of_an_emptied_date_and_of_rows_without_one(spark, raw, tmp_path):
    f = FlightFacts(spark, str(tmp_path / "f"), days_per_part=7)
    blank = raw.flights.limit(2).withColumn(DATE, F.lit(None).cast("date"))
    t = raw.replace(flights=lambda: raw.flights.unionByName(blank))
    f.build(t.cleaned())
    gone = raw.replace(flights=lambda: raw.flights.filter(F.col(DATE) != SUN),
                       bags=lambda: raw.bags.filter(F.col(DATE) != SUN),
                       bookings=lambda: raw.bookings.filter(F.col(DATE) != SUN))
    f.refresh(restrict_to_dates(gone, [SUN, None]), [SUN, None])
    check_ranking(f, gone.cleaned())


def test_bounds_in_one_pass(raw, stored, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter
    t, actions = raw.cleaned(), []
    save = DataFrameWriter.save
    monkeypatch.setattr(DataFrameWriter, "save", lambda self, *a, **k: (actions.append(1), save(self, *a, **k)))
    for name in ("collect", "first", "count", "take", "toPandas"):
        monkeypatch.setattr(f"pyspark.sql.classic.dataframe.DataFrame.{name}",
                            lambda self, *a, **k: pytest.fail("another action"))
    got = scoring.params_from_data(t, keep_min_ssr=False)
    assert len(actions) == 1
    monkeypatch.undo()
    want = {}
    for r in (scoring.range_ground_time(t.flights), scoring.range_transfer_ratio(t.bags), scoring.range_ssr(t),
              scoring.range_load_factor(t)):
        want |= r.first().asDict()
    assert got == scoring.bounded(P.SCORE_PRESET, want, keep_min_ssr=False) == facts.params_from_facts(
        stored, keep_min_ssr=False)


def test_bounds_without_data(raw):
    for empty in (dict(flights=lambda: raw.flights.limit(0)), dict(bags=lambda: raw.bags.limit(0)),
                  dict(bookings=lambda: raw.bookings.limit(0), remarks=lambda: raw.remarks.limit(0))):
        t = raw.replace(**empty).cleaned()
        want = {}
        for r in (scoring.range_ground_time(t.flights), scoring.range_transfer_ratio(t.bags), scoring.range_ssr(t),
                  scoring.range_load_factor(t)):
            want |= r.first().asDict()
        assert scoring.params_from_data(t, keep_min_ssr=False) == scoring.bounded(P.SCORE_PRESET, want, False)


def test_derived_table_follows_its_sources(spark, tmp_path):
    source, built = tmp_path / "s.txt", []
    source.write_text("a")

    def build(path):
        built.append(path)
        spark.range(1).write.parquet(path)

    first = derived(spark, "probe", [str(source)], build)
    assert derived(spark, "probe", [str(source)], build) == first and len(built) == 1
    source.write_text("abc")
    assert derived(spark, "probe", [str(source)], build) != first and len(built) == 2
    from tarmac.session import clear_scratch
    clear_scratch(spark)
    derived(spark, "probe", [str(source)], build)
    assert len(built) == 3


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_registered_queries_read_the_facts_alone(spark):
    for name in ("normalized_features", "difficulty_score", "daily_ranking", "range_ssr", "range_transfer_ratio",
                 "range_load_factor", "hard_destinations_above_avg", "hard_destinations_majority"):
        files = queries()[name](spark, SF).inputFiles()
        assert files and not any("lineitem" in f or "orders" in f for f in files)
