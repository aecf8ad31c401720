"""Flight tables derived from the order/line-item/customer tables.

The test data has no flight tables, so the four inputs are derived from
``orders``, ``lineitem`` and ``customer`` with integer arithmetic only (the
same mapping is written in SQL for the DuckDB check in
``tarmac.plans.oracle``):

* flights  = orders JOIN customer (one flight per order)
* bookings = lineitem JOIN orders (one booking per line)
* remarks  = the same join, lines with discount >= 0.05
* bags     = the same join (one bag per line)

Flight number is ``'F' || custkey % 400``, departure date the order date,
times are the order date plus minute offsets.  Columns that no query reads
are typed NULLs.  Everything stays lazy: the derivations are plain
projections over joins that Catalyst prunes per query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.sources.schemas import BAGS, BOOKINGS, FLIGHTS, REMARKS
from tarmac.sources.tables import FlightTables

# Fixed values of the mapping (shared with the SQL version).
FLIGHT_NUMBERS = 400
LOCATORS = 500
ARRIVAL_STATIONS = 25
REMARK_MIN_DISCOUNT = 0.05

# Declared read schemas (only the columns the mapping reads), so a read does
# not start a schema-inference job.
ORDERS_READ = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderdate", T.TimestampNTZType()),
    T.StructField("o_orderpriority", T.StringType())])
LINEITEM_READ = T.StructType([
    T.StructField("l_orderkey", T.LongType()), T.StructField("l_partkey", T.LongType()),
    T.StructField("l_linenumber", T.IntegerType()), T.StructField("l_quantity", T.DoubleType()),
    T.StructField("l_discount", T.DoubleType()), T.StructField("l_returnflag", T.StringType()),
    T.StructField("l_linestatus", T.StringType())])
CUSTOMER_READ = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("c_nationkey", T.IntegerType())])


def _project(df: DataFrame, schema: T.StructType, exprs: dict) -> DataFrame:
    """Select ``schema``'s columns in order from SQL expressions (typed NULL
    for columns the mapping leaves out), in one ``selectExpr`` call."""
    out = []
    for f in schema.fields:
        e = exprs.get(f.name, "NULL")
        out.append(f"CAST({e} AS {f.dataType.simpleString()}) AS {f.name}")
    return df.selectExpr(*out)


FN = f"concat('F', CAST(o_custkey % {FLIGHT_NUMBERS} AS STRING))"
LOCATOR = f"concat('R', CAST(l_partkey % {LOCATORS} AS STRING))"


def _minutes_after(minutes: str) -> str:
    return f"timestampadd(MINUTE, {minutes}, o_orderdate)"


def derive_flights(orders: DataFrame, customer: DataFrame) -> DataFrame:
    o = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = customer.select("c_custkey", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    dep = "(o_orderkey * 37) % 1440"
    return _project(j, FLIGHTS, {
        "company_id": "o_orderkey",
        "flight_number": FN,
        "scheduled_departure_date_local": "to_date(o_orderdate)",
        "scheduled_departure_station_code": "concat('S', CAST(c_nationkey AS STRING))",
        "scheduled_arrival_station_code":
            f"concat('S', CAST(o_orderkey % {ARRIVAL_STATIONS} AS STRING))",
        "scheduled_departure_datetime_local": _minutes_after(dep),
        "scheduled_arrival_datetime_local":
            _minutes_after(f"{dep} + 45 + (o_orderkey * 29) % 600"),
        "actual_departure_datetime_local":
            f"CASE WHEN o_orderkey % 97 <> 0 THEN "
            f"{_minutes_after(f'{dep} + (o_orderkey * 13) % 91 - 20')} END",
        "total_seats": "50 + 50 * (o_orderkey % 5)",
        "fleet_type": "o_orderpriority",
        "carrier": "CASE WHEN o_custkey % 10 = 0 THEN 'Express' ELSE 'Mainline' END",
        "scheduled_ground_time_minutes": "(o_orderkey * 17) % 180 - 2",
        "minimum_turn_minutes": "25 + 5 * (o_orderkey % 8)",
    })


def _order_lines(lineitem: DataFrame, orders: DataFrame, line_cols) -> DataFrame:
    o = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return lineitem.select("l_orderkey", *line_cols).join(
        o, F.col("l_orderkey") == F.col("o_orderkey"), "inner")


def derive_bookings(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    j = _order_lines(lineitem, orders, ["l_partkey", "l_quantity", "l_linenumber"])
    return _project(j, BOOKINGS, {
        "flight_number": FN,
        "scheduled_departure_date_local": "to_date(o_orderdate)",
        "record_locator": LOCATOR,
        "total_pax": "1 + CAST(l_quantity AS INT) % 9",
        "lap_child_count": "CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END",
    })


def derive_remarks(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    lines = lineitem.filter(F.col("l_discount") >= REMARK_MIN_DISCOUNT)
    j = _order_lines(lines, orders, ["l_partkey", "l_linestatus"])
    return _project(j, REMARKS, {
        "record_locator": LOCATOR,
        "flight_number": FN,
        "special_service_request": "l_linestatus",
    })


def derive_bags(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    j = _order_lines(lineitem, orders, ["l_linenumber", "l_returnflag"])
    return _project(j, BAGS, {
        "flight_number": FN,
        "scheduled_departure_date_local": "to_date(o_orderdate)",
        "bag_tag_unique_number": "concat('B', CAST(l_orderkey * 8 + l_linenumber AS STRING))",
        "bag_type": "CASE l_returnflag WHEN 'A' THEN 'Transfer' WHEN 'R' THEN 'Hot Transfer' "
                    "ELSE 'Origin' END",
    })


def source_files(sf_dir: str) -> list[str]:
    """The stored tables that the flight tables derive from."""
    return [f"{sf_dir.rstrip('/')}/{name}.parquet" for name in ("orders", "lineitem", "customer")]


def standin_tables(spark: SparkSession, sf_dir: str) -> FlightTables:
    """Raw (uncleaned) flight tables derived from ``sf_dir``'s parquet files."""
    base = sf_dir.rstrip("/")

    def read(name, schema):
        return lambda: spark.read.schema(schema).parquet(f"{base}/{name}.parquet")

    orders, lineitem, customer = (read("orders", ORDERS_READ), read("lineitem", LINEITEM_READ),
                                  read("customer", CUSTOMER_READ))
    return FlightTables(
        flights=lambda: derive_flights(orders(), customer()),
        bookings=lambda: derive_bookings(lineitem(), orders()),
        remarks=lambda: derive_remarks(lineitem(), orders()),
        bags=lambda: derive_bags(lineitem(), orders()),
    )
