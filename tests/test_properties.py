"""Algebraic properties, and hot-key data against direct (fan-out) plans."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarmac.plans import catalog, eda, features, insights, scoring
from hotdata import hot_tables

SF = "/root/testdata/sf0.001"
KEY = ["flight_number", "scheduled_departure_date_local"]
DATE = "scheduled_departure_date_local"


@pytest.fixture(scope="module")
def standin(spark):
    if not os.path.isdir(SF):
        pytest.skip("test data not present")
    return catalog.tables(spark, SF)


def test_count_matches_list(standin):
    n = eda.tight_turnaround_count(standin.flights).first()[0]
    assert n == eda.tight_turnaround_flights(standin.flights).count()


def test_rank_is_permutation_and_thirds(standin):
    r = scoring.daily_ranking(standin, sort=False)
    per_day = r.groupBy(DATE).agg(
        F.count(F.lit(1)).alias("n"), F.min("daily_rank").alias("lo"),
        F.max("daily_rank").alias("hi"), F.countDistinct("daily_rank").alias("d"),
        F.sum(F.when(F.col("difficulty_category") == "Difficult", 1).otherwise(0)).alias("hard"))
    bad = per_day.filter((F.col("lo") != 1) | (F.col("hi") != F.col("n")) |
                         (F.col("d") != F.col("n")) |
                         (F.col("hard") != F.expr("n div 3")))
    assert bad.count() == 0


def test_rank_follows_score(standin):
    r = scoring.daily_ranking(standin, sort=False)
    w = Window.partitionBy(DATE).orderBy("daily_rank")
    prev = r.withColumn("prev", F.lag("difficulty_score").over(w))
    # descending with NULL first: a non-NULL score never precedes a NULL one
    bad = prev.filter((F.col("prev").isNotNull() & F.col("difficulty_score").isNotNull() &
                       (F.col("prev") < F.col("difficulty_score"))) |
                      (F.col("prev").isNotNull() & F.col("difficulty_score").isNull()))
    assert bad.count() == 0


def test_ranking_scores_equal_score_query(standin):
    a = scoring.daily_ranking(standin, sort=False).select(*KEY, "difficulty_score")
    b = scoring.difficulty_scores(standin, sort=False).select(*KEY, "difficulty_score")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


# --------------------------------------------------------------- hot keys

@pytest.fixture(scope="module")
def hot(spark):
    return hot_tables(spark)


@pytest.fixture(autouse=True, scope="module")
def split_hot_keys(spark):
    """AQE splits any partition of a kilobyte, so the skewed joins of the plans
    run split on this small data."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_hot_bags_per_pax_equals_direct_join(hot):
    direct = (hot.bags.alias("b").join(hot.bookings.alias("p"), KEY)
              .groupBy(*KEY).agg(F.count("bag_tag_unique_number").alias("total_bags"),
                                 F.sum("total_pax").alias("total_pax")))
    eager = features.bags_per_pax(hot.bags, hot.bookings).select(*KEY, "total_bags", "total_pax")
    assert _same(eager, direct)


def test_hot_ssr_per_flight_equals_direct_join(hot):
    direct = (hot.remarks.join(hot.bookings, ["record_locator", "flight_number"])
              .groupBy(*KEY).agg(F.count(F.lit(1)).alias("num_special_service_requests")))
    assert _same(eda.ssr_per_flight(hot.remarks, hot.bookings), direct)


def test_hot_rank_equals_window(hot):
    scored = scoring.difficulty_scores(hot, sort=False)
    w = Window.partitionBy(DATE).orderBy(*scoring.rank_order())
    want = scored.select(*KEY, "difficulty_score",
                         F.row_number().over(w).cast("long").alias("daily_rank"))
    got = scoring.daily_ranking(hot, sort=False).select(*KEY, "difficulty_score", "daily_rank")
    assert _same(got, want)


def test_hot_destination_rollup_equals_direct_join(hot):
    scored = scoring.difficulty_scores(hot, sort=False)
    j = hot.flights.join(scored, KEY)
    direct = (j.groupBy(F.col("scheduled_arrival_station_code").alias("destination"))
              .agg(F.count(F.lit(1)).alias("flight_count"),
                   F.avg("difficulty_score").alias("avg_difficulty_score")))
    overall = scored.agg(F.avg("difficulty_score")).first()[0]
    direct = direct.filter(F.col("avg_difficulty_score") > overall)
    got = insights.hard_destinations_above_avg(hot.flights, scored)
    r = lambda df: sorted((x.destination, x.flight_count, round(x.avg_difficulty_score, 9))
                          for x in df.collect())
    assert r(got) == r(direct) and len(r(got)) > 0
