"""Queries on the co-partitioned store: same rows, no shuffle below the joins."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from minidata import mini_tables
from tarmac import params as P
from tarmac.operators.skew import join_stored
from tarmac.plans import eda, features, stored
from tarmac.sources.bucketed import LAYOUT, read_bucketed, write_bucketed

KEY = list(P.FLIGHT_KEY)


def held(df):
    names = sorted(df.columns)
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(names).collect()), key=repr)


def check(store, t):
    pairs = [
        (stored.pax_per_flight(store), eda.pax_per_flight(t.bookings)),
        (stored.load_factor(store), eda.load_factor(t.flights, t.bookings)),
        (stored.load_vs_delay(store), eda.load_vs_delay(t.flights, t.bookings)),
        (stored.transfer_to_checked_ratio(store), features.transfer_to_checked_ratio(t.bags)),
        (stored.bags_per_pax(store), features.bags_per_pax(t.bags, t.bookings)),
        (stored.lap_children_ratio(store), features.lap_children_ratio(t.bookings)),
        (stored.ssr_per_flight(store), eda.ssr_per_flight(t.remarks, t.bookings)),
        (stored.ssr_per_pax(store), features.ssr_per_pax(t.remarks, t.bookings)),
    ]
    for got, want in pairs:
        assert got.columns == want.columns and held(got) == held(want)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def make(spark, t, path, buckets, **how):
    write_bucketed(t, path, buckets, **how)
    return read_bucketed(spark, path)


@pytest.fixture(scope="module")
def hot_tables(spark):
    """Mini tables with a flight key, a booking key and rows without a key that
    hold a third of the rows each."""
    raw = mini_tables(spark)

    def more(df, **same):
        n = 40
        row = df.limit(1)
        for c, v in same.items():
            row = row.withColumn(c, F.lit(v).cast(df.schema[c].dataType))
        blank = row
        for c in [c for c in KEY if c in df.columns]:
            blank = blank.withColumn(c, F.lit(None).cast(df.schema[c].dataType))
        many = spark.range(n).crossJoin(F.broadcast(row.unionByName(blank))).drop("id")
        return df.unionByName(many)

    day = raw.flights.first()["scheduled_departure_date_local"]
    key = dict(flight_number="HOT", scheduled_departure_date_local=day)
    return raw.replace(
        flights=lambda: raw.flights.unionByName(raw.flights.limit(1).withColumn("flight_number", F.lit("HOT"))
                                                .withColumn(KEY[1], F.lit(day))),
        bookings=lambda: more(raw.bookings, record_locator="HL", **key),
        remarks=lambda: more(raw.remarks, record_locator="HL", flight_number="HOT"),
        bags=lambda: more(raw.bags, **key).withColumn("bag_tag_unique_number", F.concat(
            F.lit("U"), F.monotonically_increasing_id().cast("string")))).cleaned()


def test_same_rows(spark, tmp_path):
    t = mini_tables(spark).cleaned()
    check(make(spark, t, str(tmp_path / "s"), 4), t)
    check(make(spark, t, str(tmp_path / "one"), 1), t)


def test_hot_keys_lie_apart(spark, hot_tables, tmp_path):
    t = hot_tables
    cold, hot = store = make(spark, t, str(tmp_path / "s"), 8)
    check(store, t)
    for name, (_, keys) in LAYOUT.items():
        a, b = getattr(cold, name), getattr(hot, name)
        whole = t.bookings if name == "locators" else getattr(t, name)
        assert a.count() + b.count() == whole.count()
        # no key in both halves, and no cold key beyond two average buckets
        same = [a[k].eqNullSafe(b[k]) for k in keys]
        assert a.join(b.select(*keys).distinct(), same, "left_semi").count() == 0
        most = a.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        assert most <= max(1, -(-2 * whole.count() // 8))
    assert hot.bookings.filter("flight_number = 'HOT'").count() == 40
    assert hot.bookings.filter("flight_number IS NULL").count() == 40


def test_buckets_grow_with_the_rows(spark, tmp_path):
    """A bucket, which one task reads, holds about as many rows in a larger store."""
    t, path = mini_tables(spark).cleaned(), str(tmp_path / "s")
    most = max(getattr(t, m).count() for m in t.MEMBERS)
    want = -(-most // 2)
    check(make(spark, t, path, 2, rows_per_bucket=2), t)
    assert want > 2 and json.loads((tmp_path / "s" / "layout.json").read_text()) == {"buckets": want}


def test_keys_are_counted_by_many_tasks(spark, tmp_path, monkeypatch):
    """The list of hot keys is one file, but no single task counts the keys."""
    from tarmac.sources import bucketed
    plans, real = [], bucketed.hot_keys
    monkeypatch.setattr(bucketed, "hot_keys", lambda *a: plans.append(real(*a)) or plans[-1])
    coalesced, coalesce = [], type(spark.range(1)).coalesce
    monkeypatch.setattr(type(spark.range(1)), "coalesce", lambda df, n: coalesced.append(n) or coalesce(df, n))
    write_bucketed(mini_tables(spark).cleaned(), str(tmp_path / "s"), 2)
    assert len(plans) == 2 and coalesced == []
    assert all(len(list((tmp_path / "s" / "hot_keys").glob(f"{k}/*.parquet"))) <= 1
               for k in ("-".join(P.FLIGHT_KEY), "-".join(P.REMARK_KEY)))


def test_no_shuffle_below_the_joins(spark, tmp_path):
    t = mini_tables(spark).cleaned()
    cold, _ = make(spark, t, str(tmp_path / "s"), 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # as if the tables were large
    try:
        for df in (eda.load_factor(cold.flights, cold.bookings, join_stored),
                   features.bags_per_pax_rows(cold.bags, cold.bookings), stored.matched_remarks(cold, join_stored)):
            plan = plan_of(df)
            assert "SortMergeJoin" in plan and "Exchange" not in plan
        # remarks are counted per flight after their join; bookings are not shuffled for the second one
        ssr = stored.matched_remarks(cold, join_stored).groupBy(*KEY).agg(F.sum("_n").alias("n"))
        plan = plan_of(ssr.join(eda.pax_per_flight(cold.bookings), KEY))
        assert len(re.findall(r"Exchange hashpartitioning", plan.split("Initial Plan")[0])) == 1
        # the same query on plain tables shuffles both sides
        assert plan_of(eda.load_factor(t.flights, t.bookings)).count("Exchange hashpartitioning") >= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_store_is_written_once_and_whole(spark, tmp_path):
    t, path = mini_tables(spark).cleaned(), str(tmp_path / "s")
    write_bucketed(t, path, 2)
    with pytest.raises(Exception):
        write_bucketed(t, path, 2)
    with pytest.raises(Exception):
        read_bucketed(spark, str(tmp_path / "none"))


def test_empty_tables(spark, tmp_path):
    t = mini_tables(spark).cleaned()
    empty = t.replace(**{m: (lambda m=m: getattr(t, m).limit(0)) for m in t.MEMBERS})
    check(make(spark, empty, str(tmp_path / "s"), 3), empty)


# ------------------------------------------------------------------ exact means

def test_means_do_not_depend_on_the_partitions(spark):
    import datetime as dt
    import random
    rng = random.Random(2)
    at = dt.datetime(2024, 1, 1)
    flights = [(f"F{i % 90}", at.date(), at, at + dt.timedelta(microseconds=rng.randint(1, 10**10)), 100) for i in range(3000)]
    f = spark.createDataFrame(flights, "flight_number string, scheduled_departure_date_local date, "
                              "scheduled_departure_datetime_local timestamp_ntz, "
                              "actual_departure_datetime_local timestamp_ntz, total_seats int")
    bags = [(f"F{rng.randint(0, 400)}", at.date(), rng.choice(["Transfer", "Origin", "Origin", None])) for _ in range(5000)]
    b = spark.createDataFrame(bags, "flight_number string, scheduled_departure_date_local date, bag_type string")
    books = spark.createDataFrame([(f"F{i % 90}", at.date(), f"R{i}") for i in range(200)],
                                  "flight_number string, scheduled_departure_date_local date, record_locator string")
    asks = spark.createDataFrame([(f"R{i}", f"F{i % 90}") for i in range(200) for _ in range(i % 9)],
                                 "record_locator string, flight_number string")
    seen = set()
    for n in (1, 2, 3, 7, 13):
        g = f.repartition(n, F.rand(n))
        seen.add((eda.avg_positive_delay(g).first()[0],
                  eda.avg_bag_ratio(b.repartition(n, F.rand(n)), checked="Origin").first()[0],
                  tuple(sorted(map(tuple, eda.delay_by_ssr_group(g, books, asks).collect())))))
    assert len(seen) == 1
    from fractions import Fraction
    delay = Fraction(sum(int((x[3] - x[2]) / dt.timedelta(microseconds=1)) for x in flights), len(flights) * 60_000_000)
    per = {}
    for key, _, kind in bags:
        t, c = per.get(key, (0, 0))
        per[key] = (t + (kind == "Transfer"), c + (kind == "Origin"))
    ratios = [Fraction(t, c) for t, c in per.values() if c]
    (got,) = seen
    assert got[0] == pytest.approx(float(delay), rel=1e-15)
    assert got[1] == pytest.approx(float(sum(ratios) / len(ratios)), rel=1e-12)
