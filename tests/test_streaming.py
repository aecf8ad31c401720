"""The incremental daily ranking gives the batch ranking's rows."""

from __future__ import annotations

import os

from minidata import MON, SUN, mini_tables
from tarmac.plans import scoring
from tarmac.streaming import start_daily_ranking
from tarmac.streaming.daily import rank_dates
from test_golden import RANK_COLS, rows


def test_stream_reranks_touched_dates(spark, tmp_path):
    raw = mini_tables(spark)
    new_dir, out, ckpt = (str(tmp_path / n) for n in ("new", "out", "ckpt"))
    date = "scheduled_departure_date_local"
    # first file: Sunday's flights only
    raw.flights.filter(raw.flights[date] == SUN).write.mode("append").parquet(new_dir)
    q = start_daily_ranking(spark, new_dir, lambda: raw, out, ckpt, available_now=True)
    q.awaitTermination(300)
    back = scoring.read_flight_difficulty(spark, out)
    assert {r[1] for r in rows(back, *RANK_COLS)} == {SUN}
    # second file: Monday's flights; Sunday's folder stays as it was
    raw.flights.filter(raw.flights[date] == MON).write.mode("append").parquet(new_dir)
    q = start_daily_ranking(spark, new_dir, lambda: raw, out, ckpt, available_now=True)
    q.awaitTermination(300)
    back = scoring.read_flight_difficulty(spark, out)
    want = scoring.daily_ranking(raw.cleaned(), sort=False)
    assert rows(back, *RANK_COLS) == rows(want, *RANK_COLS)


# ------------------------------------------------- daily run against the batch

def _stored(spark, path):
    return rows(scoring.read_flight_difficulty(spark, path), *RANK_COLS)


def _with_rows(spark, raw, **extra):
    """``raw`` with rows added to members (dicts of the columns that are set)."""
    def more(member):
        df = getattr(raw, member)
        new = [tuple(r.get(f.name) for f in df.schema.fields) for r in extra[member]]
        return df.union(spark.createDataFrame(new, df.schema))
    return raw.replace(**{m: (lambda m=m: more(m)) for m in extra})


def _days(spark, *days):
    return spark.createDataFrame([(d,) for d in days], f"{DATE} date")


DATE = "scheduled_departure_date_local"


def test_tag_repeated_on_another_date(spark, tmp_path):
    """A tag on two dates is dropped, whichever date is ranked."""
    bag = dict(flight_number="101", bag_tag_unique_number="X1", bag_type="Transfer")
    raw = _with_rows(spark, mini_tables(spark), bags=[{**bag, DATE: SUN}, {**bag, DATE: MON}])
    out = str(tmp_path / "out")
    for day in (SUN, MON):
        rank_dates(raw, _days(spark, day), out)
    assert _stored(spark, out) == rows(scoring.daily_ranking(raw.cleaned(), sort=False), *RANK_COLS)


def test_null_departure_date(spark, tmp_path):
    """Flights without a date are ranked among themselves, as in the batch."""
    raw = _with_rows(spark, mini_tables(spark), flights=[
        dict(flight_number="900", scheduled_ground_time_minutes=50, total_seats=100),
        dict(flight_number="901", scheduled_ground_time_minutes=40, total_seats=100)])
    out = str(tmp_path / "out")
    rank_dates(raw, _days(spark, SUN, None), out)
    rank_dates(raw, _days(spark, MON), out)
    want = rows(scoring.daily_ranking(raw.cleaned(), sort=False), *RANK_COLS)
    assert len([r for r in want if r[1] is None]) == 2
    assert _stored(spark, out) == want


def test_emptied_date_goes(spark, tmp_path):
    """Once a date has no flight left, its stored rows go; others stay."""
    raw = mini_tables(spark)
    out = str(tmp_path / "out")
    rank_dates(raw, _days(spark, SUN, MON), out)
    gone = raw.replace(flights=lambda: raw.flights.filter(raw.flights[DATE] != SUN))
    rank_dates(gone, _days(spark, SUN), out)
    assert _stored(spark, out) == rows(scoring.daily_ranking(gone.cleaned(), sort=False), *RANK_COLS)


def test_daily_run_leaves_no_scratch(spark, tmp_path):
    from tarmac.session import clear_scratch, ensure_checkpoint_dir
    clear_scratch(spark)
    base = ensure_checkpoint_dir(spark).replace("file:", "")
    before = set(os.listdir(base))
    rank_dates(mini_tables(spark), _days(spark, SUN), str(tmp_path / "out"))
    assert set(os.listdir(base)) == before
