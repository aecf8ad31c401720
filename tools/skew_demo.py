"""Measure how a hot key is split: records per join task of a plain join and
of ``join_unique``.

    python tools/skew_demo.py <scratch_dir> [sf_dir]

Bookings of the stand-in tables get a third of their rows remapped to one
flight key, then join a per-key aggregate of flights once as a plain join
and once through ``operators.skew.join_unique``.  Spark's event log (written
to the scratch folder) gives the shuffle records each join task read; the
script prints max / median / total per variant, and checks both variants
return the same rows.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tarmac.operators import skew  # noqa: E402
from tarmac.sources.standin import standin_tables  # noqa: E402

KEY = ["flight_number", "scheduled_departure_date_local"]


def main() -> None:
    scratch = sys.argv[1]
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    log_dir = os.path.join(scratch, "eventlog")
    os.makedirs(log_dir, exist_ok=True)
    spark = (SparkSession.builder.master("local[8]")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "64")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
             .config("spark.sql.autoBroadcastJoinThreshold", "-1")
             .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
             .config("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "128k")
             .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
             .config("spark.eventLog.enabled", "true")
             .config("spark.eventLog.dir", log_dir)
             .config("spark.eventLog.compress", "false")
             .config("spark.eventLog.rolling.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(os.path.join(scratch, "ckpt"))
    t = standin_tables(spark, sf_dir)
    hot_fn, hot_day = F.lit("HOT"), F.to_date(F.lit("1995-01-01"))
    third = F.abs(F.xxhash64("record_locator", "total_pax", "flight_number")) % 3 == 0
    big = t.bookings.select(
        F.when(third, hot_fn).otherwise(F.col("flight_number")).alias("flight_number"),
        F.when(third, hot_day).otherwise(F.col("scheduled_departure_date_local"))
        .alias("scheduled_departure_date_local"),
        # a payload that does not compress, as AQE judges partitions by their bytes
        F.xxhash64(F.monotonically_increasing_id()).alias("payload"))
    per_key = (t.flights.groupBy(*KEY).agg(F.max("total_seats").alias("seats"))
               .unionByName(spark.createDataFrame([("HOT", None, 999)], "flight_number string, "
                            "scheduled_departure_date_local date, seats int")
                            .withColumn("scheduled_departure_date_local", hot_day))
               .groupBy(*KEY).agg(F.max("seats").alias("seats")))

    # materialize both inputs so the measured jobs hold only the join
    spark.sparkContext.setJobGroup("prep", "prep")
    big.repartition(16).write.parquet(os.path.join(scratch, "big"))
    per_key.write.parquet(os.path.join(scratch, "per_key"))
    big = spark.read.parquet(os.path.join(scratch, "big"))
    per_key = (spark.read.parquet(os.path.join(scratch, "per_key"))
               .groupBy(*KEY).agg(F.max("seats").alias("seats")))

    variants = {"plain": big.join(per_key, KEY, "left"),
                "split": skew.join_unique(big, per_key, KEY, "left")}
    sums = {}
    for name, df in variants.items():
        spark.sparkContext.setJobGroup(name, name)
        sums[name] = df.agg(F.count(F.lit(1)), F.sum("seats"), F.bit_xor("payload")).collect()[0]
    spark.stop()
    assert sums["plain"] == sums["split"], sums

    f = [p for p in glob.glob(log_dir + "/**", recursive=True) if os.path.isfile(p)][0]
    stage_group, tasks = {}, {}
    for line in open(f):
        e = json.loads(line)
        if e["Event"] == "SparkListenerJobStart":
            group = (e.get("Properties") or {}).get("spark.jobGroup.id")
            for sid in e["Stage IDs"]:
                stage_group[sid] = group
        elif e["Event"] == "SparkListenerTaskEnd" and e.get("Task Metrics"):
            read = e["Task Metrics"]["Shuffle Read Metrics"].get("Total Records Read", 0)
            if read:
                tasks.setdefault((stage_group.get(e["Stage ID"]), e["Stage ID"]), []).append(read)
    print(f"rows and seat sums equal: {sums['plain'][0]} rows")
    for name in variants:
        reads = [r for (g, _), v in tasks.items() if g == name for r in v]
        per_stage = {sid: v for (g, sid), v in tasks.items() if g == name}
        sid, worst = max(per_stage.items(), key=lambda kv: max(kv[1]))
        print(f"{name:6s} largest task read {max(reads)} records (stage {sid}: "
              f"{len(worst)} tasks, median {int(statistics.median(worst))}); "
              f"all shuffle reads {sum(reads)}")


if __name__ == "__main__":
    main()
