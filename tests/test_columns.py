"""Column helpers: the dialect points that change results."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from tarmac.functions import columns as C


def one(spark, col, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(col.alias("v")).first().v


def test_minutes_between_signed_subsecond(spark):
    a, b = dt.datetime(2024, 3, 10, 1, 59, 30), dt.datetime(2024, 3, 10, 3, 0, 0)
    df = spark.createDataFrame([(a, b)], "a timestamp_ntz, b timestamp_ntz")
    got = df.select(C.minutes_between("a", "b").alias("fwd"), C.minutes_between("b", "a").alias("back"),
                    C.hours_between("a", "b").alias("h")).first()
    # wall-clock difference, no time zone: the DST change does not matter
    assert (got.fwd, got.back) == (60.5, -60.5)
    assert round(got.h, 6) == round(60.5 / 60, 6)


def test_int_div_truncates_toward_zero(spark):
    df = spark.createDataFrame([(-1, 26), (7, 3), (-27, 26), (53, 27)], "a long, b long")
    assert [r.v for r in df.select(C.int_div("a", "b").alias("v")).collect()] == [0, 2, -1, 1]


def test_ratio_null_on_zero_and_null(spark):
    df = spark.createDataFrame([(1, 0), (1, None), (3, 4)], "a long, b long")
    assert [r.v for r in df.select(C.ratio("a", "b").alias("v")).collect()] == [None, None, 0.75]


def test_count_where_null_predicate_counts_zero(spark):
    df = spark.createDataFrame([(None,), (1,), (2,)], "x int")
    assert df.agg(C.count_where(F.col("x") > 1).alias("v")).first().v == 1
    assert df.filter("false").agg(C.count_where(F.col("x") > 1).alias("v")).first().v is None


def test_minmax_score_unclamped_and_zero_width(spark):
    assert one(spark, C.minmax_score(F.lit(0.0), 0.06, 1.02)) == pytest.approx(-0.0625)
    assert one(spark, C.minmax_score(F.lit(40), 1.0, 33327, invert=True)) == \
        pytest.approx(33287 / 33326)
    assert one(spark, C.minmax_score(F.lit(5), 3, 3)) is None


def test_tercile_label_integer_thirds(spark):
    def labels(n):
        df = spark.createDataFrame([(r, n) for r in range(1, n + 1)], "r long, n long")
        return [x.v for x in df.select(C.tercile_label("r", "n").alias("v")).collect()]
    assert labels(1) == ["Easy"]
    assert labels(2) == ["Medium", "Easy"]
    assert labels(4) == ["Difficult", "Medium", "Easy", "Easy"]
    assert labels(6) == ["Difficult"] * 2 + ["Medium"] * 2 + ["Easy"] * 2


def test_padded_day_name(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 10),), (dt.date(2024, 3, 13),)], "d date")
    assert [r.v for r in df.select(C.padded_day_name("d").alias("v")).collect()] == \
        ["Sunday   ", "Wednesday"]


def test_bank_and_haul_null_fall_to_else(spark):
    df = spark.createDataFrame([(None,), (6,), (7,), (12,), (13,), (18,), (19,)], "h int")
    assert [r.v for r in df.select(C.departure_bank("h").alias("v")).collect()] == [
        "Evening/Night", "Early Morning", "Morning", "Morning", "Afternoon", "Afternoon",
        "Evening/Night"]
    df = spark.createDataFrame([(None,), (1.99,), (2.0,), (5.0,), (5.01,)], "h double")
    assert [r.v for r in df.select(C.haul_category("h").alias("v")).collect()] == [
        "Long Haul", "Short Haul", "Medium Haul", "Medium Haul", "Long Haul"]


def test_pct_round2_half_up_on_exact_decimal(spark):
    # 100 * 23 / 4000 = 0.575 exactly; a binary double rounds it down to 0.57
    df = spark.createDataFrame([(23, 4000), (1, 3), (2, 3), (1, 8), (0, 5), (1, 0)],
                               "n long, d long")
    got = [r.v for r in df.select(C.pct_round2("n", "d").alias("v")).collect()]
    assert got == [0.58, 33.33, 66.67, 12.5, 0.0, None]


def test_round6_matches_duckdb(spark):
    vals = [57.49999999999999 / 1e6, 2.5e-6, -2.5e-6, -1e-7, 0.1234565, 1 / 3, 0.0078125]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.v for r in df.select(C.round6("x").alias("v")).collect()]
    want = [duckdb.sql(f"SELECT round(CAST({v!r} AS DOUBLE) * 1000000.0, 0) / 1000000.0 + 0.0")
            .fetchall()[0][0] for v in vals]
    assert got == want


def test_weighted_sum_null_propagates(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 2.0)], "a double, b double")
    got = [r.v for r in df.select(C.weighted_sum([(0.5, "a"), (0.25, "b")]).alias("v")).collect()]
    assert got == [None, 1.0]


def test_time_differences_ignore_session_time_zone(spark):
    # 02:30 does not exist on 2024-03-10 in Chicago (clocks jump 02:00 -> 03:00);
    # wall-clock arithmetic must not care.
    a = [(dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 3, 10, 3, 30, 0, 500)),
         (dt.datetime(2024, 3, 10, 1, 0), dt.datetime(2024, 3, 10, 2, 15)),
         (dt.datetime(2024, 11, 3, 1, 30), dt.datetime(2024, 11, 3, 1, 0))]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ["America/Chicago", "UTC", "Asia/Kolkata"]:
            spark.conf.set("spark.sql.session.timeZone", tz)
            df = spark.createDataFrame(a, "a timestamp_ntz, b timestamp_ntz")
            got = [r.v for r in df.select(C.minutes_between("a", "b").alias("v")).collect()]
            assert got == [60 + 0.0005 / 60, 75.0, -30.0], tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
