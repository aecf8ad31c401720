"""Rows per task when ranking per day with one day holding a third of the
flights: hash partitioning by date (what a window does) against the range
sort of ``rank_within_groups``.

    python tools/rank_skew_demo.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from tarmac.plans import catalog, scoring  # noqa: E402
from tarmac.session import build_session  # noqa: E402


def sizes(df):
    counts = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p"))
              .agg(F.count(F.lit(1)).alias("n")).collect()]
    return max(counts), sorted(counts)[len(counts) // 2], len(counts)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", shuffle_partitions=16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    scored = scoring.difficulty_scores(catalog.tables(spark, sf_dir), sort=False)
    day = "scheduled_departure_date_local"
    hot_day = F.to_date(F.lit("1995-01-01"))
    third = F.abs(F.xxhash64("flight_number", "ground_time_score")) % 3 == 0
    df = scored.withColumn(day, F.when(third, hot_day).otherwise(F.col(day)))
    print("busy day rows", df.filter(F.col(day) == hot_day).count(), "of", df.count())
    print("hash by date (window): max, median, partitions =",
          sizes(df.repartition(16, day)))
    keys = [F.col(day).asc_nulls_last()] + scoring.rank_order()
    print("range sort (rank_within_groups): max, median, partitions =",
          sizes(df.orderBy(*keys)))


if __name__ == "__main__":
    main()
