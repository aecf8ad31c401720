"""The hand-worked mini data set: four flight tables over two days.

Sun = 2024-03-10 (a daylight-saving change day in the US), Mon = 2024-03-11.
"""

from __future__ import annotations

import datetime as dt

from tarmac.sources.schemas import BAGS, BOOKINGS, FLIGHTS, REMARKS
from tarmac.sources.tables import FlightTables

SUN, MON = dt.date(2024, 3, 10), dt.date(2024, 3, 11)


def ts(day: dt.date, hh: int, mm: int, ss: int = 0) -> dt.datetime:
    return dt.datetime(day.year, day.month, day.day, hh, mm, ss)


def _rows(schema, records):
    names = [f.name for f in schema.fields]
    return [tuple(r.get(n) for n in names) for r in records]


def flights_records():
    def f(fn, day, arr, dep, act, sarr, seats, fleet, carrier, ground, turn):
        return dict(flight_number=fn, scheduled_departure_date_local=day,
                    scheduled_departure_station_code="ORD", scheduled_arrival_station_code=arr,
                    scheduled_departure_datetime_local=dep, actual_departure_datetime_local=act,
                    scheduled_arrival_datetime_local=sarr, total_seats=seats, fleet_type=fleet,
                    carrier=carrier, scheduled_ground_time_minutes=ground,
                    minimum_turn_minutes=turn)
    return [
        f("101", SUN, "LAX", ts(SUN, 1, 30), ts(SUN, 3, 30), ts(SUN, 6, 0), 100, "B737", "Mainline", 60, 45),
        f("102", SUN, "DEN", ts(SUN, 7, 0), ts(SUN, 6, 50), ts(SUN, 8, 59), 50, "E175", "Express", 30, 30),
        f("103", SUN, "LHR", ts(SUN, 18, 59), None, ts(MON, 0, 0), 200, "B777", "Mainline", 120, 90),
        f("104", SUN, "SFO", ts(SUN, 12, 59, 30), ts(SUN, 13, 0, 0), ts(SUN, 17, 59, 30), 100, "B737", "Mainline", 40, 45),
        f("101", MON, "LAX", ts(MON, 22, 0), ts(MON, 22, 0), ts(MON, 23, 59), 100, "B737", "Mainline", None, 45),
        f("105", MON, "SFO", ts(MON, 19, 0), ts(MON, 19, 30), ts(MON, 21, 0), 100, "B737", "Mainline", 0, 45),
    ]


def bookings_records():
    def b(fn, day, loc, pax, lap):
        return dict(flight_number=fn, scheduled_departure_date_local=day, record_locator=loc,
                    total_pax=pax, lap_child_count=lap)
    return [b("101", SUN, "R1", 3, 1), b("101", SUN, "R1", 3, 1), b("101", SUN, "R2", 2, 0),
            b("102", SUN, "R3", 4, None), b("104", SUN, "R4", 10, 0), b("101", MON, "R1", 1, 0)]


def remarks_records():
    def r(loc, fn):
        return dict(record_locator=loc, flight_number=fn, special_service_request="WCHR")
    return [r("R1", "101")] * 2 + [r("R2", "101")] * 3 + [r("R3", "102"), r("R9", "101")]


def bags_records():
    def g(fn, tag, kind):
        return dict(flight_number=fn, scheduled_departure_date_local=SUN,
                    bag_tag_unique_number=tag, bag_type=kind)
    return [g("101", "B1", "Origin"), g("101", "B2", "Transfer"), g("101", "B3", "Hot Transfer"),
            g("102", "B4", "Transfer"), g("104", "B5", "Origin"), g("104", "B6", "Origin"),
            g("104", "B7", "Origin"), g("104", "B7", "Origin"),
            g("104", None, "Origin"), g("104", None, "Origin")]


def mini_tables(spark) -> FlightTables:
    return FlightTables(
        flights=spark.createDataFrame(_rows(FLIGHTS, flights_records()), FLIGHTS),
        bookings=spark.createDataFrame(_rows(BOOKINGS, bookings_records()), BOOKINGS),
        remarks=spark.createDataFrame(_rows(REMARKS, remarks_records()), REMARKS),
        bags=spark.createDataFrame(_rows(BAGS, bags_records()), BAGS),
    )
