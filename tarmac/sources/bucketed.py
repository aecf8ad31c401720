"""Cleaned flight tables stored co-partitioned on the keys that queries join on.

Flights, bookings and bags lie in buckets by the flight key, remarks and a narrow
copy of the bookings (``locators``) in buckets by (record locator, flight
number).  A query on such tables aggregates and joins bucket by bucket, without
shuffling bookings or bags again for every query.

A bucket is read by one task, so a flight key that holds a large share of the
rows must not lie in one.  ``write_bucketed`` counts the rows per key first and
stores the rows of *hot* keys, those with more than ``hot_factor`` times an
average bucket, apart:

    <path>/cold/<table>    bucketed and sorted, no hot key
    <path>/hot/<table>     the rows of hot keys, as plain files
    <path>/layout.json     number of buckets; written last, so that a store that
                           has it is complete

There is a bucket for every ``ROWS_PER_BUCKET`` rows of the largest table, so what
a task holds stays the same as the tables grow.

A key is hot in all tables of its layout or in none, so no key spans both
halves: whatever is computed per key is the union of both (``plans.stored``).
There are at most ``buckets / hot_factor`` hot keys a table, one for every
``hot_factor * ROWS_PER_BUCKET`` rows at most; that list is broadcast.  Rows without a key count as a key of their own.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac import params as P
from tarmac.session import scratch_path, scratch_scope, small_tasks
from tarmac.sources.schemas import BAGS, BOOKINGS, FLIGHTS, REMARKS
from tarmac.sources.tables import FlightTables

LOCATORS = T.StructType([BOOKINGS[c] for c in (*P.BOOKING_KEY, "total_pax", "lap_child_count")])

#: table -> (columns, keys of its buckets)
LAYOUT = {"flights": (FLIGHTS, P.FLIGHT_KEY), "bookings": (BOOKINGS, P.FLIGHT_KEY), "bags": (BAGS, P.FLIGHT_KEY),
          "remarks": (REMARKS, P.REMARK_KEY), "locators": (LOCATORS, P.REMARK_KEY)}
HOT_FACTOR = 2.0
ROWS_PER_BUCKET = 250_000


@dataclass(frozen=True)
class StoredTables:
    """One half of a store: the flight tables and ``locators``."""
    flights: DataFrame
    bookings: DataFrame
    bags: DataFrame
    remarks: DataFrame
    locators: DataFrame


def _members(t: FlightTables) -> dict[str, DataFrame]:
    return {"flights": t.flights, "bookings": t.bookings, "bags": t.bags, "remarks": t.remarks,
            "locators": t.bookings}


def _staged(t: FlightTables) -> FlightTables:
    """The tables as plain files: every step of the store reads them again, and what
    they derive from is joined and cleaned only once."""
    spark = t.flights.sparkSession

    def stage(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "staged")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return FlightTables(**{m: stage(getattr(t, m)) for m in t.MEMBERS})


def hot_keys(tables: list[tuple[DataFrame, int]], keys: tuple[str, ...], buckets: int, hot_factor: float) -> DataFrame:
    """Keys with more than ``hot_factor`` average buckets of the rows of a table
    (given with its number of rows)."""
    def of(df: DataFrame, rows: int) -> DataFrame:
        limit = max(1, math.ceil(hot_factor * rows / buckets))
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        return counts.filter(F.col("_n") > limit).select(*keys)

    return reduce(DataFrame.unionByName, [of(*t) for t in tables]).distinct()


def _split(df: DataFrame, hot: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(hot[k]) for k in keys])
    return df.join(F.broadcast(hot), same, how)


def write_bucketed(t: FlightTables, path: str, buckets: int, hot_factor: float = HOT_FACTOR,
                   rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
    """Store cleaned tables at ``path``, which must not exist, in ``buckets`` or, for
    large tables, as many as ``rows_per_bucket`` takes."""
    spark = t.flights.sparkSession
    with small_tasks(spark), scratch_scope(spark):
        _write_bucketed(t, path.rstrip("/"), buckets, hot_factor, rows_per_bucket)


def _write_bucketed(t: FlightTables, path: str, buckets: int, hot_factor: float, rows_per_bucket: int) -> None:
    spark, members = t.flights.sparkSession, _members(_staged(t))
    rows = {name: members[name].count() for name in t.MEMBERS}
    rows["locators"] = rows["bookings"]
    buckets = max(buckets, -(-max(rows.values()) // rows_per_bucket))
    for keys in dict.fromkeys(k for _, k in LAYOUT.values()):
        mine = {n: members[n].select(*schema.fieldNames()) for n, (schema, k) in LAYOUT.items() if k == keys}
        found = f"{path}/hot_keys/{'-'.join(keys)}"
        # one small file, but counted by many tasks: coalesce(1) would count in one
        (hot_keys([(df.select(*keys), rows[n]) for n, df in mine.items()], keys, buckets, hot_factor)
         .repartition(1).write.parquet(found))
        hot = spark.read.parquet(found)
        for name, df in mine.items():
            table = _table_name(path, name) + "_w"
            (_split(df, hot, keys, "left_anti").repartition(buckets, *keys)
             .write.mode("errorifexists").format("parquet").option("path", f"{path}/cold/{name}")
             .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table))
            spark.sql(f"DROP TABLE {table}")                # its files stay
            _split(df, hot, keys, "left_semi").write.mode("errorifexists").parquet(f"{path}/hot/{name}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/layout.json")
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, False)
    try:
        out.write(bytearray(json.dumps({"buckets": buckets}).encode()))
    finally:
        out.close()


def _table_name(path: str, name: str) -> str:
    return f"tarmac_{hashlib.sha256(path.encode()).hexdigest()[:16]}_{name}"


def read_bucketed(spark: SparkSession, path: str) -> tuple[StoredTables, StoredTables]:
    """(cold, hot) halves of a store.  The cold tables are entered, as external
    tables with their buckets, in the session's catalog."""
    path, jvm = path.rstrip("/"), spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/layout.json")
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        buckets = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["buckets"]
    finally:
        stream.close()
    cold, hot = {}, {}
    for name, (schema, keys) in LAYOUT.items():
        table, by = _table_name(path, name), ", ".join(keys)
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
                  f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}/cold/{name}'")
        cold[name] = spark.table(table)
        hot[name] = spark.read.schema(schema).parquet(f"{path}/hot/{name}")
    return StoredTables(**cold), StoredTables(**hot)
