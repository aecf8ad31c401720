"""Published tables change in one step, whatever fails in between."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import types as T

from minidata import MON, SUN, mini_tables
from tarmac.plans import scoring
from tarmac.sources.published import PublishConflict, PublishedTable
from tarmac.streaming.daily import rank_dates
from test_golden import RANK_COLS, rows

DATE = "scheduled_departure_date_local"
SCHEMA = T.StructType([T.StructField("day", T.DateType()), T.StructField("x", T.LongType())])
D1, D2, D3 = dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 3)


@pytest.fixture
def table(spark, tmp_path):
    return PublishedTable(spark, str(tmp_path / "t"), SCHEMA, "day")


def frame(spark, *values):
    return spark.createDataFrame(values, SCHEMA)


def held(df):
    return sorted(((r.day, r.x) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or D1, r[1]))


def test_replace_keep_and_remove(spark, table):
    assert table.read().collect() == [] and not table.exists()
    table.write(frame(spark, (D1, 1), (D2, 2), (None, 3)))
    assert held(table.read()) == [(D1, 1), (D2, 2), (None, 3)]
    table.write(frame(spark, (D2, 20), (D3, 30)), remove=[D1, D2])
    assert held(table.read()) == [(D2, 20), (D3, 30), (None, 3)]
    assert held(table.read(version=1)) == [(D1, 1), (D2, 2), (None, 3)]
    table.publish(remove=[None])
    assert held(table.read()) == [(D2, 20), (D3, 30)]
    table.write(frame(spark, (D1, 5)), replace_all=True)
    assert held(table.read()) == [(D1, 5)] and table.versions() == [1, 2, 3, 4]


def test_reads_only_the_named_partitions(spark, table):
    table.write(frame(spark, (D1, 1), (D2, 2), (None, 3)))
    df = table.read([D2, None, D3])
    assert held(df) == [(D2, 2), (None, 3)]
    assert all("day=2024-01-01" not in f for f in df.inputFiles())
    assert table.read([D3]).collect() == []


def test_a_reader_keeps_its_version(spark, table):
    table.write(frame(spark, (D1, 1), (D2, 2)))
    before = table.read()
    table.write(frame(spark, (D1, 10)))
    assert held(before) == [(D1, 1), (D2, 2)] and held(table.read()) == [(D1, 10), (D2, 2)]


def test_crash_between_staging_and_publishing(spark, table, monkeypatch):
    table.write(frame(spark, (D1, 1), (D2, 2)))

    def fail(self, manifest):
        raise OSError("crash")

    with monkeypatch.context() as m:
        m.setattr(PublishedTable, "_put", fail)
        with pytest.raises(OSError):
            table.write(frame(spark, (D1, 10), (D3, 30)), remove=[D2])
    assert held(table.read()) == [(D1, 1), (D2, 2)]
    table.write(frame(spark, (D1, 10), (D3, 30)), remove=[D2])
    assert held(table.read()) == [(D1, 10), (D3, 30)]


def test_crash_before_the_rename_leaves_no_version(spark, table):
    """A manifest that was written but not renamed is no version."""
    table.write(frame(spark, (D1, 1)))
    folder = os.path.join(table.path.replace("file:", ""), "_versions")
    with open(os.path.join(folder, ".000000000002-dead"), "w") as f:
        f.write("{")
    assert table.versions() == [1] and held(table.read()) == [(D1, 1)]


def test_two_writers(spark, table):
    table.write(frame(spark, (D1, 1), (D2, 2)))
    a, b, c = (table.stage(frame(spark, x)) for x in ((D1, 10), (D2, 20), (D1, 11)))
    table.publish(a)
    table.publish(b)                     # other partitions: on top of a
    assert held(table.read()) == [(D1, 10), (D2, 20)]
    with pytest.raises(PublishConflict):
        table.publish(c)
    assert held(table.read()) == [(D1, 10), (D2, 20)]


def test_versions_are_never_overwritten(spark, table, monkeypatch):
    """The rename of the second writer of a version fails and it goes on after it."""
    table.write(frame(spark, (D1, 1)))
    staged = table.stage(frame(spark, (D2, 2)))
    other = PublishedTable(spark, table.path, SCHEMA, "day")
    stale = table.manifest()
    real = PublishedTable.manifest
    seen = []

    def once_stale(self, version=None):
        seen.append(version)
        return stale if len(seen) == 1 else real(self, version)

    other.write(frame(spark, (D3, 3)))
    monkeypatch.setattr(PublishedTable, "manifest", once_stale)
    assert table.publish(staged).version == 3
    assert held(table.read()) == [(D1, 1), (D2, 2), (D3, 3)]


def test_a_batch_is_published_once(spark, table):
    table.write(frame(spark, (D1, 1)), batch=("s", 4))
    assert table.write(frame(spark, (D1, 9)), batch=("s", 4)).version == 1
    assert table.write(frame(spark, (D1, 9)), batch=("s", 3)).version == 1
    table.write(frame(spark, (D1, 2)), batch=("s", 5))
    table.write(frame(spark, (D2, 3)), batch=("other", 0))
    assert held(table.read()) == [(D1, 2), (D2, 3)]


def test_vacuum(spark, table):
    for x in range(4):
        table.write(frame(spark, (D1, x), (D2 if x == 0 else D3, x)))
    assert table.vacuum(older_than_seconds=3600) == 0          # all could still be in progress
    want = held(table.read())
    assert table.vacuum(keep=1, older_than_seconds=-5) > 0
    assert held(table.read()) == want and len(table.versions()) == 1


def test_partition_column_types(spark, tmp_path):
    with pytest.raises(ValueError):
        PublishedTable(spark, str(tmp_path), T.StructType([T.StructField("s", T.StringType())]), "s")
    n = PublishedTable(spark, str(tmp_path / "n"), T.StructType([T.StructField("x", T.LongType()),
                                                                 T.StructField("b", T.IntegerType())]), "b")
    n.write(spark.createDataFrame([(1, 0), (2, 7)], n.schema))
    assert sorted(map(tuple, n.read([7]).collect())) == [(2, 7)]


# ------------------------------------------------------------ the stored ranking

def ranking(spark, path):
    return rows(scoring.read_flight_difficulty(spark, path), *RANK_COLS)


def test_daily_run_that_fails_leaves_the_old_ranking(spark, tmp_path, monkeypatch):
    """Sunday loses all its flights and Monday changes: both or neither."""
    raw, out = mini_tables(spark), str(tmp_path / "out")
    days = spark.createDataFrame([(SUN,), (MON,)], f"{DATE} date")
    rank_dates(raw, days, out)
    before = ranking(spark, out)
    changed = raw.replace(flights=lambda: raw.flights.filter((raw.flights[DATE] != SUN)
                                                             & (raw.flights["flight_number"] != "201")))
    with monkeypatch.context() as m:
        m.setattr(PublishedTable, "_put", lambda self, manifest: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError):
            rank_dates(changed, days, out)
    assert ranking(spark, out) == before
    rank_dates(changed, days, out)
    assert ranking(spark, out) == rows(scoring.daily_ranking(changed.cleaned(), sort=False), *RANK_COLS) != before


def test_stored_ranking_of_some_dates(spark, tmp_path):
    out = str(tmp_path / "out")
    scoring.write_flight_difficulty(scoring.daily_ranking(mini_tables(spark).cleaned(), sort=False), out)
    df = scoring.read_flight_difficulty(spark, out, [SUN])
    assert {r[1] for r in rows(df, *RANK_COLS)} == {SUN}
    assert all(f"{DATE}={SUN}" in f for f in df.inputFiles())
