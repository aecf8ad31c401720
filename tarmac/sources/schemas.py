"""Declared input schemas (all columns nullable, no keys) and the schema of
the stored ranking."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _TS, _I, _B = (T.StringType(), T.DateType(), T.TimestampNTZType(),
                       T.IntegerType(), T.BooleanType())


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


FLIGHTS = _struct(
    ("company_id", _S),
    ("flight_number", _S),
    ("scheduled_departure_date_local", _D),
    ("scheduled_departure_station_code", _S),
    ("scheduled_arrival_station_code", _S),
    ("scheduled_departure_datetime_local", _TS),
    ("scheduled_arrival_datetime_local", _TS),
    ("actual_departure_datetime_local", _TS),
    ("actual_arrival_datetime_local", _TS),
    ("total_seats", _I),
    ("fleet_type", _S),
    ("carrier", _S),
    ("scheduled_ground_time_minutes", _I),
    ("actual_ground_time_minutes", _I),
    ("minimum_turn_minutes", _I),
)

BOOKINGS = _struct(
    ("company_id", _S),
    ("flight_number", _S),
    ("scheduled_departure_date_local", _D),
    ("scheduled_departure_station_code", _S),
    ("scheduled_arrival_station_code", _S),
    ("record_locator", _S),
    ("pnr_creation_date", _D),
    ("total_pax", _I),
    ("is_child", _B),
    ("basic_economy_pax", _I),
    ("is_stroller_user", _B),
    ("lap_child_count", _I),
)

REMARKS = _struct(
    ("record_locator", _S),
    ("pnr_creation_date", _D),
    ("flight_number", _S),
    ("special_service_request", _S),
)

AIRPORTS = _struct(
    ("airport_iata_code", _S),
    ("iso_country_code", _S),
)

BAGS = _struct(
    ("company_id", _S),
    ("flight_number", _S),
    ("scheduled_departure_date_local", _D),
    ("scheduled_departure_station_code", _S),
    ("scheduled_arrival_station_code", _S),
    ("bag_tag_unique_number", _S),
    ("bag_tag_issue_date", _D),
    ("bag_type", _S),
)

FLIGHT_DIFFICULTY = _struct(
    ("flight_number", _S),
    ("scheduled_departure_date_local", _D),
    ("difficulty_score", T.DoubleType()),
    ("ground_time_score", T.DoubleType()),
    ("transfer_score", T.DoubleType()),
    ("ssr_score", T.LongType()),
    ("load_factor_score", T.DoubleType()),
    ("daily_rank", T.LongType()),
    ("difficulty_category", _S),
)

TABLE_SCHEMAS = {
    "flight_level_data": FLIGHTS,
    "pnr_flight_level_data": BOOKINGS,
    "pnr_remark_level_data": REMARKS,
    "airports_data": AIRPORTS,
    "bag_level_data": BAGS,
}


def require_columns(columns, schema: T.StructType, table: str) -> None:
    """Fail early when a table lacks a declared column."""
    missing = [f.name for f in schema.fields if f.name not in columns]
    if missing:
        raise ValueError(f"{table} is missing columns {missing}")


def conform(df, schema: T.StructType):
    """Select the declared columns in declared order, cast to declared types."""
    return df.select([df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
