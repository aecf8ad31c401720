"""Changing a stored ranking for some flights without sorting their dates again.

A late or corrected flight moves a stored ranking little: its old rows leave, its
new rows enter, and every other row of the date shifts by the number of rows that
left and entered before it.  ``rerank`` computes these shifts from the changed
rows alone and applies them in one narrow pass over the stored rows of the
touched dates.  Neither a sort nor a shuffle of a date is left; only the changed
rows, at most ``MAX_CHANGED`` flight keys, are sorted and broadcast.  With more
changes the dates are ranked anew, with the same result.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from typing import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac import params as P
from tarmac.functions.columns import tercile_label
from tarmac.plans import facts as stored_facts
from tarmac.plans import scoring
from tarmac.session import scratch_path, scratch_scope
from tarmac.sources.published import Manifest

KEY = list(P.FLIGHT_KEY)
DATE = "scheduled_departure_date_local"
SCORES = ["difficulty_score", *scoring.SCORE_COLS]
MAX_CHANGED = 1000          # flight keys, and about as many rows, to compare every stored row with


def _before(x: str, a: str) -> Column:
    """Does row ``x`` come before row ``a`` in the order of ``scoring.rank_order``
    (or is it equal in all columns, where the order is free)?"""
    same, found = F.lit(True), F.lit(False)
    for name, descending in [("difficulty_score", True), ("flight_number", False),
                             *[(c, True) for c in scoring.SCORE_COLS]]:
        left, right = F.col(f"{x}.{name}"), F.col(f"{a}.{name}")
        # descending: NULL first; ascending: NULL last
        ahead = (left.isNull() & right.isNotNull()) | (left > right) if descending else (
            left.isNotNull() & right.isNull()) | (left < right)
        found = found | (same & F.coalesce(ahead, F.lit(False)))
        same = same & left.eqNullSafe(right)
    return found | same


def _match(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    return a.join(F.broadcast(b), reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys]), how)


def rerank(ranked: DataFrame, keys: DataFrame, fresh: DataFrame) -> DataFrame:
    """The ranking ``ranked`` of some dates after the rows of ``keys`` (flight
    keys) are replaced by the scored rows ``fresh``.  ``keys`` and ``fresh`` are
    small: both are broadcast."""
    kept = _match(ranked, keys, KEY, "left_anti")
    gone = _match(ranked, keys, KEY, "left_semi")
    first = Window.partitionBy(DATE).orderBy(*scoring.rank_order())
    fresh = fresh.select(*KEY, *SCORES).withColumn("_i", F.row_number().over(first))
    # how many kept rows come before each new row
    x, a = kept.alias("x"), F.broadcast(fresh).alias("a")
    ahead = (x.join(a, F.col(f"x.{DATE}").eqNullSafe(F.col(f"a.{DATE}")) & _before("x", "a"))
             .groupBy(F.col(f"a.{DATE}").alias("_d"), F.col("a._i").alias("_j")).agg(F.count(F.lit(1)).alias("_q")))
    entered = (fresh.join(ahead, fresh[DATE].eqNullSafe(ahead["_d"]) & (fresh["_i"] == ahead["_j"]), "left")
               .select(*KEY, *SCORES, "_i", F.coalesce("_q", F.lit(0)).alias("_q")))
    # per date: the ranks that left, the places of the new rows, rows before and after
    ranks = F.collect_list("daily_rank")
    none = F.lit(None).cast("array<long>")
    parts = [gone.groupBy(DATE).agg(ranks.alias("_left"), none.alias("_came"), F.lit(0).cast("long").alias("_n")),
             entered.groupBy(DATE).agg(none.alias("_left"), F.collect_list("_q").alias("_came"), F.lit(0).cast("long").alias("_n")),
             ranked.groupBy(DATE).agg(none.alias("_left"), none.alias("_came"), F.max("daily_rank").alias("_n"))]
    dates = reduce(DataFrame.unionByName, parts).groupBy(F.col(DATE).alias("_date")).agg(
        F.flatten(F.collect_list("_left")).alias("_left"), F.flatten(F.collect_list("_came")).alias("_came"),
        F.max("_n").alias("_n"))
    dates = dates.withColumn("_n", F.col("_n") - F.size("_left") + F.size("_came"))
    moved = kept.join(F.broadcast(dates), kept[DATE].eqNullSafe(dates["_date"]))
    moved = moved.withColumn("daily_rank", F.col("daily_rank") - F.size(
        F.filter("_left", lambda r: r < F.col("daily_rank"))))
    moved = moved.withColumn("daily_rank", F.col("daily_rank") + F.size(
        F.filter("_came", lambda q: q < F.col("daily_rank"))))
    new = entered.join(F.broadcast(dates), entered[DATE].eqNullSafe(dates["_date"])).withColumn(
        "daily_rank", F.col("_q") + F.col("_i"))
    columns = [*KEY, *SCORES, "daily_rank", "_n"]
    return (moved.select(*columns).unionByName(new.select(*columns))
            .select(*KEY, *SCORES, F.col("daily_rank").cast("long").alias("daily_rank"),
                    tercile_label("daily_rank", "_n").alias("difficulty_category")))


def rank_flights(facts: stored_facts.FlightFacts, keys: DataFrame, out_path: str, p: P.ScoreParams = P.SCORE_PRESET,
                 batch: tuple[str, int] | None = None, max_changed: int = MAX_CHANGED) -> Manifest | None:
    """Bring the stored ranking at ``out_path`` up to date for some flight keys,
    whose facts (already refreshed) may have changed, appeared or gone."""
    spark = keys.sparkSession
    store = scoring.flight_difficulty_store(spark, out_path)
    with scratch_scope(spark):
        path = scratch_path(spark, "changed-keys")
        keys.select(*KEY).distinct().write.mode("errorifexists").parquet(path)
        keys = spark.read.schema(keys.select(*KEY).schema).parquet(path)
        dates: Iterable[dt.date | None] = [r[0] for r in keys.select(DATE).distinct().collect()]
        if not dates:
            return None
        inputs = facts.inputs(dates)
        if keys.count() <= max_changed:
            mine = _match(inputs, keys, KEY, "left_semi")
            if mine.count() <= 10 * max_changed:
                fresh = scoring.scores_from(mine, p, sort=False)
                staged = store.stage(rerank(store.read(dates), keys, fresh))
                return store.publish(staged, remove=dates, batch=batch)
        return scoring.write_flight_difficulty(scoring.ranking_from(inputs, p, sort=False), out_path, dates, batch)
