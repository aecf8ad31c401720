"""Inputs and outputs: declared schemas, stored-table readers, the stand-in
tables derived from the order data, and the ranking sink."""

from tarmac.sources.schemas import (AIRPORTS, BAGS, BOOKINGS, FLIGHT_DIFFICULTY, FLIGHTS,
                                    REMARKS, TABLE_SCHEMAS)
from tarmac.sources.standin import standin_tables
from tarmac.sources.tables import FlightTables, read_tables

__all__ = ["AIRPORTS", "BAGS", "BOOKINGS", "FLIGHT_DIFFICULTY", "FLIGHTS", "REMARKS",
           "TABLE_SCHEMAS", "FlightTables", "read_tables", "standin_tables"]
