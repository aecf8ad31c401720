"""Rankings changed for some flights equal rankings made anew."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from minidata import MON, SUN, mini_tables
from tarmac.plans import facts, scoring
from tarmac.plans.facts import FlightFacts
from tarmac.plans.rerank import DATE, KEY, SCORES, rank_flights, rerank
from tarmac.streaming.daily import restrict_to_dates
from test_golden import RANK_COLS, rows

DAYS = [dt.date(2024, 1, 1), dt.date(2024, 1, 2), None]
DDL = ("flight_number string, scheduled_departure_date_local date, difficulty_score double, ground_time_score double, "
       "transfer_score double, ssr_score long, load_factor_score double")


def ranked_by_hand(data):
    """Rank the rows of each date in plain Python."""
    out = []
    desc = lambda v: (v is not None, -(v or 0))
    for d in {r[1] for r in data}:
        day = sorted((r for r in data if r[1] == d), key=lambda r: (
            desc(r[2]), r[0] is None, r[0] or "", *map(desc, r[3:])))
        n = len(day)
        out += [(*r, i, "Difficult" if i <= n // 3 else "Medium" if i <= 2 * n // 3 else "Easy")
                for i, r in enumerate(day, 1)]
    return sorted(out, key=repr)


def row(rng, number):
    score = lambda: rng.choice([None, 0.0, 0.25, 0.5, rng.random()])
    return (number, rng.choice(DAYS), score(), score(), score(), rng.choice([None, 0, 1]), score())


@pytest.mark.parametrize("seed", range(4))
def test_random_changes(spark, seed):
    """Rows leave, enter and change; ties, NULL scores, numbers and dates."""
    rng = random.Random(seed)
    held = [row(rng, rng.choice([None, *[f"F{i}" for i in range(25)]])) for _ in range(120)]
    keys = {(r[0], r[1]) for r in rng.sample(held, 6)} | {("NEW", DAYS[0]), ("GONE", DAYS[1])}
    fresh = [(*k, *row(rng, "")[2:]) for k in sorted(keys, key=str) for _ in range(rng.randint(0, 3)) if k[0] != "GONE"]
    left = [r for r in held if (r[0], r[1]) not in keys]
    ranked = spark.createDataFrame([r for r in ranked_by_hand(held)], DDL + ", daily_rank long, difficulty_category string")
    got = rerank(ranked.repartition(3), spark.createDataFrame(sorted(keys, key=str), DDL.split(", difficulty")[0]),
                 spark.createDataFrame(fresh, DDL))
    assert got.columns == [*KEY, *SCORES, "daily_rank", "difficulty_category"]
    assert sorted(map(tuple, got.collect()), key=repr) == ranked_by_hand(left + fresh)


def test_no_sort_or_shuffle_of_a_date(spark, tmp_path):
    """The stored rows are only scanned, filtered and joined with broadcasts."""
    rng = random.Random(5)
    path = str(tmp_path / "r")
    spark.createDataFrame(ranked_by_hand([row(rng, f"F{i}") for i in range(50)]),
                          DDL + ", daily_rank long, difficulty_category string").write.parquet(path)
    got = rerank(spark.read.parquet(path), spark.createDataFrame([("F1", DAYS[0])], DDL.split(", difficulty")[0]),
                 spark.createDataFrame([row(rng, "F1")], DDL))
    got.collect()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan
    physical = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" not in physical and "rangepartitioning" not in physical


def test_late_flight_equals_the_batch(spark, tmp_path):
    raw, out = mini_tables(spark), str(tmp_path / "out")
    f = FlightFacts(spark, str(tmp_path / "facts"))
    f.build(raw.cleaned())
    scoring.write_flight_difficulty(facts.daily_ranking(f, sort=False), out)
    late = raw.flights.filter(F.col(DATE) == MON).limit(1).withColumn("flight_number", F.lit("999"))
    t = raw.replace(flights=lambda: raw.flights.filter("flight_number <> '201'").unionByName(late))
    f.refresh(restrict_to_dates(t, [MON]), [MON])
    keys = spark.createDataFrame([("999", MON), ("201", MON)], "flight_number string, scheduled_departure_date_local date")
    want = rows(scoring.daily_ranking(t.cleaned(), sort=False), *RANK_COLS)
    before = rows(scoring.read_flight_difficulty(spark, out), *RANK_COLS)
    assert before != want
    manifest = rank_flights(f, keys, out, batch=("late", 1))
    assert rows(scoring.read_flight_difficulty(spark, out), *RANK_COLS) == want
    # a repeated batch changes nothing; many changes rank the dates anew, with the same rows
    assert rank_flights(f, keys, out, batch=("late", 1)).version == manifest.version
    rank_flights(f, keys, out, max_changed=0)
    assert rows(scoring.read_flight_difficulty(spark, out), *RANK_COLS) == want


def test_a_date_that_loses_its_last_flight(spark, tmp_path):
    raw, out = mini_tables(spark), str(tmp_path / "out")
    f = FlightFacts(spark, str(tmp_path / "facts"))
    f.build(raw.cleaned())
    scoring.write_flight_difficulty(facts.daily_ranking(f, sort=False), out)
    gone = raw.replace(flights=lambda: raw.flights.filter(F.col(DATE) != SUN))
    f.refresh(restrict_to_dates(gone, [SUN]), [SUN])
    rank_flights(f, raw.flights.filter(F.col(DATE) == SUN), out)
    assert rows(scoring.read_flight_difficulty(spark, out), *RANK_COLS) == rows(
        scoring.daily_ranking(gone.cleaned(), sort=False), *RANK_COLS)
    assert rank_flights(f, raw.flights.limit(0), out) is None
