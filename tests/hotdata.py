"""Tables where single keys hold about a third of the rows."""

from __future__ import annotations

import datetime as dt
import random

from tarmac.sources.schemas import BAGS, BOOKINGS, FLIGHTS, REMARKS
from tarmac.sources.tables import FlightTables


def hot_tables(spark) -> FlightTables:
    """One flight key holds a third of bookings and bags, one date a third of
    the flights, one (locator, flight) a third of the remarks."""
    rnd = random.Random(11)
    day0 = dt.date(2024, 1, 1)
    names = lambda s: [f.name for f in s.fields]

    def rows(schema, recs):
        return [tuple(r.get(n) for n in names(schema)) for r in recs]

    flights = []
    for i in range(900):
        hotday = i % 3 == 0
        d = day0 if hotday else day0 + dt.timedelta(days=1 + i % 20)
        fn = "H1" if i < 3 else f"F{i % 90}"
        dep = dt.datetime.combine(d, dt.time(i % 24, 0))
        flights.append(dict(flight_number=fn, scheduled_departure_date_local=d,
                            scheduled_arrival_station_code=f"S{i % 7}",
                            scheduled_departure_datetime_local=dep,
                            actual_departure_datetime_local=dep + dt.timedelta(minutes=i % 40 - 10),
                            scheduled_arrival_datetime_local=dep + dt.timedelta(hours=1 + i % 6),
                            total_seats=100, fleet_type="B737", carrier="Mainline",
                            scheduled_ground_time_minutes=30 + i % 200, minimum_turn_minutes=45))
    keys = [(f["flight_number"], f["scheduled_departure_date_local"]) for f in flights]
    hot_key = ("H1", day0)
    bookings, bags, remarks = [], [], []
    for j in range(3000):
        fn, d = hot_key if j % 3 == 0 else rnd.choice(keys)
        loc = f"R{j % 50}"
        bookings.append(dict(flight_number=fn, scheduled_departure_date_local=d,
                             record_locator=loc, total_pax=1 + j % 4,
                             lap_child_count=rnd.choice([0, 0, 1, None])))
        bags.append(dict(flight_number=fn, scheduled_departure_date_local=d,
                         bag_tag_unique_number=f"B{j}" if j % 17 else None,
                         bag_type=rnd.choice(["Origin", "Transfer", "Hot Transfer"])))
        rfn = "H1" if j % 3 == 0 else fn
        remarks.append(dict(record_locator="R0" if j % 3 == 0 else loc, flight_number=rfn,
                            special_service_request="WCHR"))
    return FlightTables(
        flights=spark.createDataFrame(rows(FLIGHTS, flights), FLIGHTS).repartition(4),
        bookings=spark.createDataFrame(rows(BOOKINGS, bookings), BOOKINGS).repartition(4),
        remarks=spark.createDataFrame(rows(REMARKS, remarks), REMARKS).repartition(4),
        bags=spark.createDataFrame(rows(BAGS, bags), BAGS).repartition(4),
    ).cleaned()
