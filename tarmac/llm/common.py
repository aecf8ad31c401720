"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import io
import math
import zipfile
from pathlib import Path
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.session import result_path, scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the session's shared checkpoint folder and read it
    back: the lineage is cut, a lost executor re-reads files, and columns that
    a later step does not use are pruned from the scan."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers import this package even where the driver was
    started from elsewhere without ``--py-files``: a zip of the sources in the
    shared checkpoint folder is added to the context once."""
    sc = spark.sparkContext
    if getattr(sc, "_tarmac_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package).as_posix()}")
    uri = result_path(spark, "sources") + ".zip"       # no scratch table: workers need it to the end
    fs, path = open_shared(uri)
    with fs.open_output_stream(path, compression=None) as out:
        out.write(held.getvalue())
    atexit.register(_delete_quietly, fs, path)
    sc.addPyFile(uri)
    sc._tarmac_shipped = True


def _delete_quietly(fs, path: str) -> None:
    try:
        fs.delete_file(path)
    except OSError:             # gone already, with the whole folder
        pass


def hash_sample(rows: DataFrame, key: Column, n_rows: int, wanted: int) -> DataFrame:
    """The ``wanted`` distinct rows with the smallest hashes ``key`` (64 bits) of
    ``n_rows``: first those below a bound that about twice as many pass, so that
    what the tasks send does not grow with their number.  Fewer come back if
    most rows are repeated (``hash_sampled`` tries again then)."""
    if n_rows > 4 * wanted:
        rows = rows.filter(key < (1 << 64) * 2 * wanted // n_rows - (1 << 63))
    return rows.distinct().orderBy(key).limit(wanted)


def hash_sampled(rows: DataFrame, key: Column, n_rows: int, wanted: int) -> list:
    """The rows of ``hash_sample`` on the driver."""
    got = hash_sample(rows, key, n_rows, wanted).collect()
    if len(got) < wanted and n_rows > 4 * wanted:
        got = hash_sample(rows, key, wanted, wanted).collect()
    return got


def first_bytes(rows: DataFrame, size: Column, limit: int) -> list:
    """The rows of a bounded, written table (columns ``order`` and ``id``) on the
    driver, in that order as long as their sizes stay within ``limit``."""
    sizes = sorted((r["order"], r["id"], r["size"]) for r in rows.select("order", "id", size.alias("size")).collect())
    whole, last = 0, None
    for order, id_, n in sizes:
        whole += n
        if whole > limit and last is not None:
            break
        last = (order, id_)
    if last is None:
        return []
    kept = (F.col("order") < last[0]) | ((F.col("order") == last[0]) & (F.col("id") <= last[1]))
    return rows.filter(kept).collect()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(spark: SparkSession, amount: int, per_task: int) -> int:
    """Enough tasks that none gets more than ``per_task`` of ``amount`` on
    average, and not fewer than the session's shuffle partitions."""
    return max(shuffle_partitions(spark), math.ceil(amount / per_task))


def utf8_rows(column: pa.Array) -> list[bytes | None]:
    """The strings of an Arrow column as UTF-8 bytes (null stays None)."""
    return column.cast(pa.binary()).to_pylist()


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n (null for a null doc_id)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def open_shared(uri: str):
    """(filesystem, path) of a folder that all executors share, for files that
    a task reads or writes itself.  ``uri`` is below ``spark.checkpoint.dir``."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows from an iterator of tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(col, type=f.type) for col, f in zip(zip(*rows), schema)], schema=schema)
