"""Incremental daily ranking: re-rank the departure dates that new rows touch
and replace only those dates of ``flight_difficulty``.

This is the daily-run form of the ranking query (no new operator): a
Structured Streaming file source delivers new flight rows (and, with tag
counts, new bag rows), and ``foreachBatch`` runs the batch ranking restricted
to the dates that the micro-batch touches.  A date is always re-ranked from
*all* its flights in the full tables (ranks and thirds depend on the whole
day).  All dates of a batch are published in one step (``sources.published``),
dates that lost all their flights go with them, and a batch that is repeated
after a failure changes nothing more.  So the stored table equals a full batch
run after every batch, and readers never see part of one.  The stream's own
checkpoint location tracks which files were processed.

Bags are cleaned by the whole history: a tag is dropped on every date if it
occurs twice on any.  Without ``TagCounts`` a run scans the tags of all bags for
that.  With them it reads the bags of the touched dates and the buckets of their
tags, and it also finds the dates that new bags touch from afar, by repeating a
tag that was the only one of its kind on another date.
"""

from __future__ import annotations

import datetime as dt
from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac import params as P
from tarmac.operators.skew import join_unique
from tarmac.plans.cleaning import TAG, clean_flights
from tarmac.plans.facts import FlightFacts
from tarmac.plans.scoring import daily_ranking, ranking_from, write_flight_difficulty
from tarmac.plans.tag_counts import TagCounts
from tarmac.session import scratch_scope
from tarmac.sources.schemas import BAGS, FLIGHTS
from tarmac.sources.tables import FlightTables

DATE = "scheduled_departure_date_local"


def restrict_to_dates(t: FlightTables, dates: Sequence[dt.date | None],
                      counts: TagCounts | None = None) -> FlightTables:
    """The cleaned tables limited to the given departure dates (None: rows
    without one).  The dates are literals, so date partitions of stored tables
    are pruned.  Remarks carry no date; they meet bookings of those dates
    through the join inside the ranking.

    Bags are cleaned by the whole table: a tag of these dates is dropped if it
    occurs again on any date, as the stored counts tell or, without them, a count
    of these tags over all bags.
    """
    known = [d for d in dates if d is not None]
    mine = F.col(DATE).isin(known)
    if len(known) < len(dates):
        mine = F.coalesce(mine, F.lit(True))

    def bags(*columns: str) -> DataFrame:
        here = t.bags.select(*dict.fromkeys([*columns, DATE, TAG])).filter(mine)
        if counts is not None:
            return join_unique(here, counts.repeated(here), [TAG], how="left_anti").select(*columns)
        tags = here.select(TAG).filter(F.col(TAG).isNotNull()).distinct()
        repeated = (t.bags.select(TAG).join(tags, TAG, "left_semi").groupBy(TAG)
                    .agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > 1).select(TAG))
        return join_unique(here, repeated, [TAG], how="left_anti").select(*columns)

    class Dated(FlightTables):
        def bags_of(self, *columns: str) -> DataFrame:
            return bags(*columns)

    return Dated(flights=lambda: clean_flights(t.flights.filter(mine)),
                 bookings=lambda: t.bookings.filter(mine), remarks=lambda: t.remarks,
                 bags=lambda: bags(*t.bags.columns))


def rank_dates(t: FlightTables, dates: DataFrame, out_path: str,
               p: P.ScoreParams = P.SCORE_PRESET, counts: TagCounts | None = None,
               new_bags: DataFrame | None = None, batch: tuple[str, int] | None = None,
               facts: FlightFacts | None = None) -> None:
    """Daily run: rank the given dates from the raw tables and replace them in
    the ranking at ``out_path``; a date without a flight goes.

    With ``counts``, ``new_bags`` are the bag rows that came since the last run
    (already part of ``t.bags``): they are merged into the counts, and their
    dates and the dates of tags that they repeat are ranked too.  With ``facts``,
    the stored facts of these dates are refreshed first and ranked from.  The
    distinct dates, at most the days of the calendar, come to the driver."""
    spark = dates.sparkSession
    days = {r[0] for r in dates.select(DATE).distinct().collect()}
    if counts is not None and new_bags is not None:
        days |= {r[0] for r in new_bags.select(DATE).distinct().collect()}
        days |= set(counts.merge(new_bags, batch))
    if not days:
        return
    with scratch_scope(spark):
        mine = restrict_to_dates(t, sorted(days, key=str), counts)
        if facts is None:
            ranked = daily_ranking(mine, p, sort=False)
        else:
            facts.refresh(mine, days, batch)
            ranked = ranking_from(facts.inputs(days), p, sort=False)
        write_flight_difficulty(ranked, out_path, dates=days, batch=batch)


def start_daily_ranking(spark: SparkSession, new_flights_dir: str,
                        tables: Callable[[], FlightTables], out_path: str,
                        checkpoint_location: str, p: P.ScoreParams = P.SCORE_PRESET,
                        available_now: bool = False, counts: TagCounts | None = None,
                        new_bags_dir: str | None = None, name: str = "daily",
                        facts: FlightFacts | None = None):
    """Start the stream.  ``new_flights_dir`` receives flight files (declared
    flight schema, parquet), ``new_bags_dir`` bag files for ``counts``;
    ``tables`` returns the full, raw tables (already holding the new rows) when
    a batch runs.  ``name`` marks the stream's batches in what it publishes: a
    stream that starts over with a new checkpoint needs a new one."""
    stream = spark.readStream.schema(FLIGHTS).parquet(new_flights_dir).select(
        DATE, F.lit(None).cast("string").alias(TAG), F.lit(False).alias("bag"))
    if counts is not None and new_bags_dir is not None:
        bags = spark.readStream.schema(BAGS).parquet(new_bags_dir)
        stream = stream.unionByName(bags.select(DATE, TAG, F.lit(True).alias("bag")))

    def handle(rows: DataFrame, batch_id: int) -> None:
        rank_dates(tables(), rows.filter(~F.col("bag")), out_path, p, counts,
                   rows.filter("bag").drop("bag"), (name, batch_id), facts)

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation",
                                                             checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
