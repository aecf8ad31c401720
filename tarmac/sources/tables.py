"""The four input tables as one value, and readers for stored tables."""

from __future__ import annotations

from typing import Callable, Union

from pyspark.sql import DataFrame, SparkSession

from tarmac.sources import drift
from tarmac.sources.schemas import BAGS, BOOKINGS, FLIGHTS, REMARKS, require_columns


Source = Union[DataFrame, Callable[[], DataFrame]]


class FlightTables:
    """Flights, bookings (PNR per flight), service-request remarks and bags.

    Members may be given as DataFrames or as zero-argument builders; a builder
    runs on first access only, so a query pays the (driver-side) analysis of
    the tables it reads and no others.  Nothing here runs a Spark job.
    """

    MEMBERS = ("flights", "bookings", "remarks", "bags")

    def __init__(self, flights: Source, bookings: Source, remarks: Source, bags: Source):
        self._src = dict(flights=flights, bookings=bookings, remarks=remarks, bags=bags)
        self._built: dict[str, DataFrame] = {}

    def _get(self, name: str) -> DataFrame:
        if name not in self._built:
            src = self._src[name]
            self._built[name] = src if isinstance(src, DataFrame) else src()
        return self._built[name]

    flights = property(lambda self: self._get("flights"))
    bookings = property(lambda self: self._get("bookings"))
    remarks = property(lambda self: self._get("remarks"))
    bags = property(lambda self: self._get("bags"))

    def bags_of(self, *columns: str) -> DataFrame:
        """The bag table with the given columns only.  Cleaned tables project
        before they clean, so a stored table is scanned for these columns and
        the tag."""
        return self.bags.select(*columns)

    def replace(self, **members: Source) -> "FlightTables":
        src = {m: (lambda m=m: self._get(m)) for m in self.MEMBERS}
        src.update(members)
        return FlightTables(**src)

    def cleaned(self) -> "FlightTables":
        """The tables as the analysis reads them: duplicate bag tags removed and
        flights without positive scheduled ground time removed."""
        from tarmac.plans.cleaning import clean_bags, clean_flights

        return _CleanedTables(flights=lambda: clean_flights(self.flights),
                              bookings=lambda: self.bookings, remarks=lambda: self.remarks,
                              bags=lambda: clean_bags(self.bags), raw=self)


class _CleanedTables(FlightTables):
    """Cleaned tables that know the raw ones."""

    def __init__(self, raw: FlightTables, **members: Source):
        super().__init__(**members)
        self._raw = raw

    def bags_of(self, *columns: str) -> DataFrame:
        from tarmac.plans.cleaning import clean_bags

        return clean_bags(self._raw.bags, *columns)


TABLE_FILES = {
    "flights": "flight_level_data",
    "bookings": "pnr_flight_level_data",
    "remarks": "pnr_remark_level_data",
    "bags": "bag_level_data",
}


def read_tables(spark: SparkSession, base: str, fmt: str = "parquet", all_files: bool = False,
                quarantine_to: str | None = None, **options) -> FlightTables:
    """Read stored tables ``<base>/<table name>`` with their declared schema.

    The declared schema is given to the reader, so no job infers one and Parquet
    gets column pruning and filter pushdown (CSV: header expected).  A Parquet
    table that lacks a declared column is an error, found in the footer of one
    of its files; with ``all_files`` the footers of all files are read (one Spark
    job a table) and a column of another type is an error too.  With
    ``quarantine_to``, CSV rows that do not fit the schema go, with their file, to
    ``<quarantine_to>/<table name>`` instead of being read with NULLs.
    """
    schemas = {"flights": FLIGHTS, "bookings": BOOKINGS, "remarks": REMARKS, "bags": BAGS}
    frames = {}
    for member, name in TABLE_FILES.items():
        path = f"{base.rstrip('/')}/{name}"
        if fmt == "csv" and quarantine_to is not None:
            frames[member], rejected = drift.read_csv_checked(spark, path, schemas[member], **options)
            drift.quarantine(rejected, f"{quarantine_to.rstrip('/')}/{name}")
            continue
        reader = spark.read.format(fmt).options(**options).schema(schemas[member])
        if fmt == "csv":
            reader = reader.option("header", options.get("header", "true"))
        elif fmt == "parquet":
            require_columns(stored_columns(spark, path), schemas[member], name)
            if all_files:
                drift.require_all_files(spark, path, schemas[member], name)
        frames[member] = reader.load(path)
    return FlightTables(**frames)


def stored_columns(spark: SparkSession, path: str) -> list[str]:
    """Columns of a stored Parquet table: partition folders on the way to its
    first file and that file's footer, read on the driver without a job."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    columns: list[str] = []
    while fs.getFileStatus(at).isDirectory():
        inside = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName()[0] not in "._"]
        if not inside:
            raise ValueError(f"{path} has no data file")
        at = min(inside, key=lambda p: p.getName())
        if "=" in at.getName():
            columns.append(at.getName().partition("=")[0])
    file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(at, conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
    try:
        fields = reader.getFooter().getFileMetaData().getSchema().getFields()
        return columns + [f.getName() for f in fields]
    finally:
        reader.close()
