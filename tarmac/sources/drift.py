"""Stored tables against their declared schemas: every file, every row.

Spark reads a table with the schema it is given.  A Parquet file that lacks a
column, or holds it in another type, then gives NULLs or fails in some task
later; a malformed CSV field becomes NULL.  ``footer_report`` reads the footers
of all files of a Parquet table in one Spark job and reports what differs.
``read_csv_checked`` keeps the rows that fit the schema and returns the others,
with file and line, instead of NULLs; ``quarantine`` stores them.
"""

from __future__ import annotations

from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILES_PER_TASK = 64
_LINE = "_rejected_line"
_REPORT = pa.schema([(c, pa.string()) for c in ("file", "column", "problem", "declared", "found")])
REPORT_DDL = "file string, column string, problem string, declared string, found string"
#: Problems that change results; ``extra`` columns are only reported.
SERIOUS = ("missing", "type", "unreadable")


def data_files(spark: SparkSession, path: str) -> list[str]:
    """Data files below ``path``, listed on the driver as Spark lists them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, files = [], fs.listFiles(at, True)
    while files.hasNext():
        f = files.next().getPath().toString()
        if not any(part.startswith(("_", ".")) for part in f[len(fs.makeQualified(at).toString()):].split("/")):
            found.append(f)
    return sorted(found)


def _spark_type(found: pa.DataType) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    try:
        return from_arrow_type(found, prefer_timestamp_ntz=True).simpleString()
    except Exception:           # a type that Spark does not have
        return str(found)


def _footer(uri: str) -> dict[str, str]:
    """Column -> type of a Parquet file, by its footer alone; columns in folder
    names count with any type."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    at = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
    store, path = fs.FileSystem.from_uri(at)
    with store.open_input_file(path) as f:
        schema = pq.read_schema(f)
    folders = {p.partition("=")[0]: "" for p in path.split("/")[:-1] if "=" in p}
    return folders | {f.name: _spark_type(f.type) for f in schema}


def compare(uri: str, schema: T.StructType) -> list[tuple]:
    """(file, column, problem, declared, found) of one file."""
    try:
        found = _footer(uri)
    except Exception as e:
        return [(uri, None, "unreadable", None, f"{type(e).__name__}: {e}"[:500])]
    out = []
    for f in schema.fields:
        declared = f.dataType.simpleString()
        if f.name not in found:
            out.append((uri, f.name, "missing", declared, None))
        elif found[f.name] not in ("", declared):
            out.append((uri, f.name, "type", declared, found[f.name]))
    known = set(schema.fieldNames())
    return out + [(uri, c, "extra", None, t) for c, t in found.items() if c not in known]


def footer_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """file, column, problem (missing, type, extra, unreadable), declared and
    found type: one row per difference of any file of a Parquet table."""
    files = data_files(spark, path)
    table = spark.createDataFrame([(f,) for f in files], "file string")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [r for f in batch.column(0).to_pylist() for r in compare(f, schema)]
            yield pa.RecordBatch.from_pylist([dict(zip(_REPORT.names, r)) for r in rows], schema=_REPORT)

    return table.repartition(max(1, -(-len(files) // FILES_PER_TASK))).mapInArrow(run, REPORT_DDL)


def require_all_files(spark: SparkSession, path: str, schema: T.StructType, table: str) -> None:
    """Raise ``ValueError`` naming files of ``table`` that do not fit ``schema``."""
    bad = footer_report(spark, path, schema).filter(F.col("problem").isin(*SERIOUS)).orderBy("file", "column").limit(20)
    lines = [f"{r['file']}: {r['problem']} {r['column'] or ''} {r['declared'] or ''} {r['found'] or ''}".rstrip()
             for r in bad.collect()]
    if lines:
        raise ValueError(f"{table} does not fit its declared columns:\n" + "\n".join(lines))


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType, **options) -> tuple[DataFrame, DataFrame]:
    """(rows that fit ``schema``, other rows as file and line) of CSV files.

    A row is rejected as a whole if a field cannot be read in its type or fields
    are missing or left over.  A header with other names is an error."""
    full = T.StructType([*schema.fields, T.StructField(_LINE, T.StringType())])
    df = (spark.read.options(**{"header": "true", "enforceSchema": "false", **options})
          .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _LINE).schema(full).csv(path))
    # all columns are named, whatever a query selects: Spark checks only the fields that it needs
    line = F.concat_ws("", F.col(_LINE), *[F.substring(F.col(c).cast("string"), 1, 0) for c in schema.fieldNames()])
    good = df.filter(line == "").select(*schema.fieldNames())
    rejected = df.filter(line != "").select(F.col("_metadata.file_path").alias("file"), line.alias("line"))
    return good, rejected


def quarantine(rejected: DataFrame, path: str) -> int:
    """Append rejected rows to the Parquet table at ``path``; returns the number."""
    spark = rejected.sparkSession
    before = spark.read.schema("file string, line string").parquet(path).count() if _has_data(spark, path) else 0
    rejected.write.mode("append").parquet(path)
    return spark.read.schema("file string, line string").parquet(path).count() - before


def _has_data(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
