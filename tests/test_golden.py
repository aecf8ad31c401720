"""Every query on the hand-worked mini data set (expected values worked out
by hand from the source-dialect semantics)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from minidata import MON, SUN, mini_tables
from tarmac import params as P
from tarmac.plans import eda, features, insights, scoring


def _r(v):
    return round(v, 6) if isinstance(v, float) else v


def rows(df, *cols, ordered=False):
    out = [tuple(_r(x) for x in r) for r in df.select(*cols).collect()]
    return out if ordered else sorted(out, key=repr)


@pytest.fixture(scope="module")
def t(spark):
    return mini_tables(spark).cleaned()


@pytest.fixture(scope="module")
def raw(spark):
    return mini_tables(spark)


def test_clean_bags_drops_every_copy_keeps_null_tags(t):
    tags = sorted(rows(t.bags, "bag_tag_unique_number"), key=repr)
    assert len(tags) == 8
    assert ("B7",) not in tags
    assert tags.count((None,)) == 2


def test_clean_flights_keeps_null_ground_time(t):
    assert rows(t.flights, "flight_number", "scheduled_departure_date_local") == sorted(
        [("101", SUN), ("102", SUN), ("103", SUN), ("104", SUN), ("101", MON)], key=repr)


def test_departure_delay_signed_subsecond_sorted(t):
    got = rows(eda.departure_delay(t.flights), "flight_number",
               "departure_delay_mins", ordered=True)
    assert got == [("101", 120.0), ("102", -10.0), ("104", 0.5), ("103", None), ("101", 0.0)]


def test_avg_positive_delay(t):
    assert rows(eda.avg_positive_delay(t.flights), "avg_departure_delay_mins") == [(60.25,)]


def test_pct_late_null_actual_in_denominator(t):
    assert rows(eda.pct_late_departures(t.flights), "pct_late_departures") == [(50.0,)]


def test_tight_turnaround(t):
    assert rows(eda.tight_turnaround_flights(t.flights), "flight_number") == [("102",), ("104",)]
    assert rows(eda.tight_turnaround_count(t.flights), "*") == [(2,)]


def test_bag_ratio_eda_literals_as_written(t):
    got = rows(eda.bag_ratio_eda(t.bags), "flight_number", "transfer_bags", "origin_bags",
               "transfer_to_origin_ratio")
    assert got == [("101", 1, 0, None), ("102", 1, 0, None), ("104", 0, 0, None)]


def test_avg_bag_ratio_checked_literal(t):
    assert rows(eda.avg_bag_ratio(t.bags), "*") == [(None,)]


def test_transfer_to_checked_ratio(t):
    got = rows(features.transfer_to_checked_ratio(t.bags), "flight_number", "transfer_bags",
               "checked_bags", "transfer_to_checked_ratio")
    assert got == [("101", 2, 1, 2.0), ("102", 1, 0, None), ("104", 0, 4, 0.0)]


def test_pax_and_load_factor(t):
    assert rows(eda.pax_per_flight(t.bookings), "flight_number", "scheduled_departure_date_local",
                "total_passengers") == sorted(
        [("101", SUN, 8), ("101", MON, 1), ("102", SUN, 4), ("104", SUN, 10)], key=repr)
    got = rows(eda.load_factor(t.flights, t.bookings), "flight_number",
               "scheduled_departure_date_local", "load_factor")
    assert got == sorted([("101", SUN, 0.08), ("101", MON, 0.01), ("102", SUN, 0.08),
                          ("104", SUN, 0.1)], key=repr)
    assert len(rows(eda.load_vs_delay(t.flights, t.bookings), "*")) == 4


def test_ssr_per_flight_counts_booking_copies(t):
    got = rows(eda.ssr_per_flight(t.remarks, t.bookings), "flight_number",
               "scheduled_departure_date_local", "num_special_service_requests")
    assert got == sorted([("101", SUN, 7), ("101", MON, 2), ("102", SUN, 1)], key=repr)


def test_ssr_load_delay_and_groups(t):
    got = rows(eda.ssr_load_delay(t.flights, t.bookings, t.remarks), "flight_number",
               "total_passengers", "num_special_service_requests", "departure_delay_mins")
    assert got == [("101", 8, 7, 120.0), ("104", 10, 0, 0.5)]
    got = rows(eda.delay_by_ssr_group(t.flights, t.bookings, t.remarks), "*")
    assert got == [("High SSR", 120.0), ("Low SSR", 0.5)]


def test_ground_time_margin(t):
    got = rows(features.ground_time_margin(t.flights), "flight_number",
               "scheduled_departure_date_local", "ground_time_margin")
    assert got == sorted([("101", SUN, 15), ("102", SUN, 0), ("103", SUN, 30), ("104", SUN, -5),
                          ("101", MON, None)], key=repr)


def test_bags_per_pax_reproduces_join_fanout(t):
    got = rows(features.bags_per_pax(t.bags, t.bookings), "flight_number", "total_bags",
               "total_pax", "bags_per_pax", ordered=True)
    assert got == [("101", 9, 24, 0.375), ("102", 1, 4, 0.25), ("104", 2, 40, 0.05)]


def test_lap_children_ratio_null_first(t):
    got = rows(features.lap_children_ratio(t.bookings), "flight_number",
               "scheduled_departure_date_local", "lap_children", "total_passengers",
               "lap_children_ratio", ordered=True)
    assert got[0] == ("102", SUN, None, 4, None)
    assert got[1] == ("101", SUN, 2, 8, 0.25)
    assert sorted(got[2:], key=repr) == sorted([("101", MON, 0, 1, 0.0),
                                                ("104", SUN, 0, 10, 0.0)], key=repr)


def test_haul_category(t):
    got = rows(features.haul(t.flights), "flight_number", "scheduled_departure_date_local",
               "scheduled_haul_hours", "haul_category")
    assert got == sorted([("101", SUN, 4.5, "Medium Haul"), ("102", SUN, 1.983333, "Short Haul"),
                          ("103", SUN, 5.016667, "Long Haul"), ("104", SUN, 5.0, "Medium Haul"),
                          ("101", MON, 1.983333, "Short Haul")], key=repr)


def test_fleet_rarity(t):
    got = rows(features.fleet_rarity(t.flights), "*", ordered=True)
    assert got[2] == ("B737", "Mainline", 3, 5, 60.0, "Common")
    assert sorted(got[:2]) == [("B777", "Mainline", 1, 5, 20.0, "Common"),
                               ("E175", "Express", 1, 5, 20.0, "Common")]


def test_fleet_rarity_flags_rare(spark):
    from tarmac.sources.schemas import FLIGHTS
    recs = [dict(fleet_type="A", carrier="X")] * 19 + [dict(fleet_type="B", carrier="X")]
    names = [f.name for f in FLIGHTS.fields]
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in recs], FLIGHTS)
    got = rows(features.fleet_rarity(df), "fleet_type", "pct_of_flights", "rarity_flag",
               ordered=True)
    assert got == [("B", 5.0, "Common"), ("A", 95.0, "Common")]
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in recs * 2
                                + [dict(fleet_type="C", carrier="X")]], FLIGHTS)
    assert rows(features.fleet_rarity(df), "fleet_type", "rarity_flag", ordered=True)[0] == \
        ("C", "Rare")


def test_ssr_per_pax(t):
    got = rows(features.ssr_per_pax(t.remarks, t.bookings), "flight_number",
               "scheduled_departure_date_local", "ssr_per_pax")
    assert got == sorted([("101", SUN, 0.875), ("101", MON, 2.0), ("102", SUN, 0.25)], key=repr)


def test_temporal_features(t):
    got = rows(features.temporal_features(t.flights), "flight_number",
               "scheduled_departure_date_local", "departure_hour", "departure_bank", "day_of_week")
    assert got == sorted([("101", SUN, 1, "Early Morning", "Sunday   "),
                          ("102", SUN, 7, "Morning", "Sunday   "),
                          ("103", SUN, 18, "Afternoon", "Sunday   "),
                          ("104", SUN, 12, "Morning", "Sunday   "),
                          ("101", MON, 22, "Evening/Night", "Monday   ")], key=repr)


def test_ranges(t):
    assert rows(scoring.range_ground_time(t.flights), "*") == [(30, 120)]
    assert rows(scoring.range_transfer_ratio(t.bags), "*") == [(0.0, 2.0)]
    assert rows(scoring.range_ssr(t), "*") == [(1, 5)]
    assert rows(scoring.range_load_factor(t), "*") == [(0.01, 0.1)]


EXPECTED_RANKING = [
    ("104", SUN, 0.307982, 0.99883, 0.0, 0, 0.041667, 1, "Difficult"),
    ("101", SUN, 0.298287, 0.99823, 0.014925, 0, -0.020833, 2, "Medium"),
    ("102", SUN, 0.287239, 0.99913, 0.0, 0, -0.0625, 3, "Easy"),
    ("103", SUN, 0.286429, 0.996429, 0.0, 0, -0.0625, 4, "Easy"),
    ("101", MON, None, None, 0.0, 0, -0.052083, 1, "Easy"),
]
RANK_COLS = ["flight_number", "scheduled_departure_date_local", "difficulty_score",
             "ground_time_score", "transfer_score", "ssr_score", "load_factor_score",
             "daily_rank", "difficulty_category"]


def test_daily_ranking(t):
    got = rows(scoring.daily_ranking(t), *RANK_COLS, ordered=True)
    assert got == sorted(EXPECTED_RANKING, key=lambda r: (r[1], r[7]))


def test_difficulty_score_null_first(t):
    got = rows(scoring.difficulty_scores(t), "flight_number", "difficulty_score", ordered=True)
    assert got == [("101", None), ("104", 0.307982), ("101", 0.298287), ("102", 0.287239),
                   ("103", 0.286429)]


def test_normalized_features_step2_preset(t):
    got = rows(scoring.normalized_features(t), "flight_number", "scheduled_departure_date_local",
               "ssr_score", "transfer_score")
    # (n - 1) div 26 truncates toward zero: 0 flights with no request give 0, not -1
    assert {r[2] for r in got} == {0}
    assert ("101", SUN, 0, 0.014925) in got


def test_integer_ssr_score_reaches_one(t):
    p = P.SCORE_PRESET.with_bounds(max_ssr=5)
    got = dict(((r[0], r[1]), r[2]) for r in rows(
        scoring.normalized_features(t, p), "flight_number", "scheduled_departure_date_local",
        "ssr_score"))
    assert got[("101", SUN)] == 1 and got[("102", SUN)] == 0


def test_store_and_read_back(spark, t, tmp_path):
    path = str(tmp_path / "flight_difficulty")
    scoring.write_flight_difficulty(scoring.daily_ranking(t, sort=False), path)
    back = scoring.read_flight_difficulty(spark, path)
    assert rows(back, *RANK_COLS) == sorted(EXPECTED_RANKING, key=repr)


def test_hard_destinations_above_avg(t):
    scored = scoring.difficulty_scores(t, sort=False)
    got = rows(insights.hard_destinations_above_avg(t.flights, scored), "*", ordered=True)
    assert got == [("SFO", 1, 0.307982, "Medium"), ("LAX", 2, 0.298287, "Easy")]


def test_hard_destinations_majority(t):
    ranked = scoring.daily_ranking(t, sort=False)
    got = rows(insights.hard_destinations_majority(t.flights, ranked), "*")
    assert got == [("SFO", 1, 0.307982, 1, 100.0)]


def test_params_from_data(t):
    p = scoring.params_from_data(t)
    assert (p.min_ground, p.max_ground, p.min_tr, p.max_tr) == (30.0, 120, 0.0, 2.0)
    assert (p.min_ssr, p.max_ssr) == (0, 5)
    assert (round(p.min_lf, 6), round(p.max_lf, 6)) == (0.01, 0.1)


def test_empty_flights(spark, raw):
    empty = raw.replace(flights=lambda: raw.flights.limit(0)).cleaned()
    assert scoring.daily_ranking(empty).count() == 0
    ranked = scoring.daily_ranking(empty, sort=False)
    assert insights.hard_destinations_majority(empty.flights, ranked).count() == 0
    assert rows(eda.pct_late_departures(empty.flights), "*") == [(None,)]


def test_clear_scratch(spark, t):
    import os

    from tarmac.session import clear_scratch, ensure_checkpoint_dir
    scoring.daily_ranking(t, sort=False).count()
    base = ensure_checkpoint_dir(spark).replace("file:", "")
    assert any(n.startswith("tarmac-") for n in os.listdir(base))
    assert clear_scratch(spark) >= 1
    assert not any(n.startswith("tarmac-") for n in os.listdir(base))


def test_zero_seats_give_null(spark, raw):
    """A flight with 0 seats has no load factor and no load score, and counts
    in no range (the same rule as in the check SQL)."""
    zero = raw.replace(flights=lambda: raw.flights.withColumn("total_seats", F.lit(0))).cleaned()
    got = eda.load_factor(zero.flights, zero.bookings).collect()
    assert got and {r.load_factor for r in got} == {None}
    scored = scoring.difficulty_scores(zero, sort=False).collect()
    assert {(r.load_factor_score, r.difficulty_score) for r in scored} == {(None, None)}
    assert rows(scoring.range_load_factor(zero), "*") == [(None, None)]


def test_equal_means_are_not_above(spark):
    """One destination, or destinations with equal means, are never above the
    overall mean, however the scores are added up."""
    import random
    rng = random.Random(8)
    for seed in range(6):
        n = 5000
        scores = [rng.uniform(-1, 1) for _ in range(n // 2)]
        flights = [(f"F{i}", SUN, "ABC" if seed % 2 else ("ABC", "XYZ")[i % 2]) for i in range(n)]
        data = [(f"F{i}", SUN, scores[i // 2]) for i in range(n)]
        f = spark.createDataFrame(flights, "flight_number string, scheduled_departure_date_local date, "
                                           "scheduled_arrival_station_code string").repartition(1 + seed)
        s = spark.createDataFrame(data, "flight_number string, scheduled_departure_date_local date, "
                                        "difficulty_score double").repartition(7 - seed)
        assert insights.hard_destinations_above_avg(f, s).count() == 0


def test_rollups_read_the_stored_ranking(spark, t, tmp_path):
    """The destination roll-ups give the same from the stored table as from
    the ranking itself (the source reads the stored table)."""
    ranked = scoring.daily_ranking(t, sort=False)
    path = str(tmp_path / "flight_difficulty")
    scoring.write_flight_difficulty(ranked, path)
    stored = scoring.read_flight_difficulty(spark, path)
    for rollup in (insights.hard_destinations_above_avg, insights.hard_destinations_majority):
        want = rows(rollup(t.flights, ranked), "*", ordered=True)
        assert want and rows(rollup(t.flights, stored), "*", ordered=True) == want


def test_stored_ranking_leaves_no_scratch(spark, t):
    import os

    from tarmac.plans.catalog import _flight_difficulty_table
    from tarmac.session import clear_scratch, ensure_checkpoint_dir
    clear_scratch(spark)
    base = ensure_checkpoint_dir(spark).replace("file:", "")
    before = {n for n in os.listdir(base) if n.startswith("tarmac-")}
    assert _flight_difficulty_table(spark, t).count() > 0
    assert {n for n in os.listdir(base) if n.startswith("tarmac-")} == before
