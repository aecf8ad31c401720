"""Destination roll-ups of the scored flights.

The source joins flights with the scored table on the flight key, which
repeats both sides when a key has several rows (a number flown twice a day).
Both roll-ups aggregate each side by the flight key first and multiply
counts, so a hot key costs linear, not quadratic, work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac import params as P
from tarmac.functions.columns import pct_round2
from tarmac.operators.scalar import attach_scalar

KEY = list(P.FLIGHT_KEY)
DEST = "scheduled_arrival_station_code"
# Scores are summed as whole billionths in exact decimals.
SCORE_UNITS = 1e9
EXACT = "decimal(38,0)"


def _per_key(scored: DataFrame, with_category: bool) -> DataFrame:
    """Rows, score sum (whole billionths), non-NULL scores (and Difficult rows)
    per flight key."""
    score = F.round(F.col("difficulty_score") * F.lit(SCORE_UNITS), 0).cast(EXACT)
    aggs = [F.count(F.lit(1)).alias("_cs"), F.sum(score).alias("_ss"),
            F.count("difficulty_score").alias("_ns")]
    if with_category:
        aggs.append(F.sum(F.when(F.col("difficulty_category") == "Difficult", 1).otherwise(0))
                    .alias("_ds"))
    return scored.groupBy(*KEY).agg(*aggs)


def _per_destination(flights: DataFrame, s: DataFrame, with_category: bool) -> DataFrame:
    """flight_count, mean score and (optionally) Difficult count per
    destination over ``flights JOIN scored USING (flight key)``, from the
    per-key aggregate ``s`` of the scored table."""
    f = flights.groupBy(*KEY, DEST).agg(F.count(F.lit(1)).alias("_cf"))
    j = f.join(s, on=KEY, how="inner")
    cf = F.col("_cf")
    out = [F.sum(cf * F.col("_cs")).alias("flight_count"),
           F.sum((cf.cast(EXACT) * F.col("_ss")).cast(EXACT)).alias("_total"),
           F.sum((cf * F.col("_ns")).cast(EXACT)).alias("_n")]
    if with_category:
        out.append(F.sum(cf * F.col("_ds")).alias("difficult_flights_count"))
    mean = F.col("_total").cast("double") / F.nullif(F.col("_n").cast("double"), F.lit(0.0)) / F.lit(SCORE_UNITS)
    return (j.groupBy(F.col(DEST).alias("destination")).agg(*out)
            .withColumn("avg_difficulty_score", mean))


def hard_destinations_above_avg(flights: DataFrame, scored: DataFrame) -> DataFrame:
    """Destinations whose mean score beats the mean of the whole scored table,
    with a label from the mean (>= 0.5 Difficult, >= 0.3 Medium, else Easy)."""
    s = _per_key(scored, with_category=False)
    d = _per_destination(flights, s, with_category=False)
    # one-row global sum, from the same per-key aggregate, so AQE reuses its
    # shuffle stages.  Means are compared as exact fractions: equal means are
    # never "above", whatever the order of the additions
    overall = s.agg(F.sum("_ss").alias("_all"), F.sum(F.col("_ns").cast(EXACT)).alias("_all_n"))
    above = F.col("_total") * F.col("_all_n") > F.col("_all") * F.col("_n")
    avg = F.col("avg_difficulty_score")
    label = (F.when(avg >= P.DESTINATION_DIFFICULT_AT, "Difficult")
             .when(avg >= P.DESTINATION_MEDIUM_AT, "Medium").otherwise("Easy"))
    return (attach_scalar(d, overall).filter(above)
            .select("destination", "flight_count", "avg_difficulty_score",
                    label.alias("representative_difficulty_category"))
            .orderBy(avg.desc_nulls_first()))


def hard_destinations_majority(flights: DataFrame, ranked: DataFrame) -> DataFrame:
    """Destinations where more than half of the joined flights are Difficult,
    with that share in percent rounded to 2 decimals."""
    d = _per_destination(flights, _per_key(ranked, with_category=True), with_category=True)
    share = F.col("difficult_flights_count").cast("double") / F.col("flight_count")
    return (d.filter(share > P.MAJORITY_SHARE)
            .select("destination", "flight_count", "avg_difficulty_score",
                    "difficult_flights_count",
                    pct_round2("difficult_flights_count", "flight_count")
                    .alias("percent_difficult_flights"))
            .orderBy(F.col("percent_difficult_flights").desc_nulls_first(),
                     F.col("avg_difficulty_score").desc_nulls_first()))
