"""Exact deduplication through a Golomb-coded fingerprint exchange.

Texts are equal when identical after every run of ASCII white space
(space, \\t \\n \\v \\f \\r) became one space.

1. ``entries``: a task gathers its rows into chunks of bounded size.  Inside a
   chunk equal texts (compared by bytes) become one entry with its row ids and
   row keys, first row first; an entry has a short fingerprint, the leading
   bits of the text's SHA-256.
   Fingerprint ranges belong to owners.  For every owner the chunk sends its
   distinct fingerprints, sorted, as Golomb-Rice coded gaps.  Entries and
   messages are one written table, read back by column.
2. ``duplicate_bitmaps``: an owner decodes the messages of all chunks, finds the
   fingerprints that came from more than one chunk and answers every chunk
   with a bitmap over the order it sent.
3. Suspects are the entries whose bit is set.  Only their texts are shuffled,
   one per chunk and text, and compared by bytes in a grouped minimum and count
   with a map-side step.  An entry without a set bit is unique outside its
   chunk and needs no exchange.
4. Group results go back to the entries by SHA-256 (plus a second 64-bit hash of
   the bytes); entries unfold into one row per input row.

A group that holds a third of all rows sends one fingerprint, one text and one
result row per chunk, never one per copy.

Edge cases: null text counts as empty; rows with a null doc_id take part, but a
null id is never the smallest unless the group has no other; of rows that share
the smallest doc_id the one with the smallest row key stays; very long texts are
hashed and compared whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import batches, materialize, open_shared, tasks_for, utf8_rows
from tarmac.session import scratch_path

CHUNK_BYTES = 16 << 20      # text held by a task before a chunk is closed
CHUNK_ROWS = 100_000
ROWS_PER_OWNER = 250_000
SPARE_BITS = 16             # fingerprint bits beyond log2(rows): 2^-16 false suspects a row

_ENTRY = pa.schema([
    ("chunk", pa.int64()), ("owner", pa.int32()), ("rank", pa.int32()), ("sha", pa.binary()),
    ("check", pa.int64()), ("text", pa.binary()), ("ids", pa.list_(pa.int64())),
    ("keys", pa.list_(pa.int64())), ("n_sent", pa.int32()), ("sent", pa.binary()),
])
_ENTRY_DDL = ("chunk long, owner int, rank int, sha binary, check long, text binary, ids array<long>, "
              "keys array<long>, n_sent int, sent binary")


def normalise(text: bytes | None) -> bytes:
    """White-space runs as one space each."""
    if not text:
        return b""
    out = b" ".join(text.split())
    blank = b" \t\n\v\f\r"
    if not out:
        return b" "
    return b" " * (text[0] in blank) + out + b" " * (text[-1] in blank)


# --- Golomb-Rice coding of sorted integers --------------------------------------

def rice_encode(values: np.ndarray, span: int) -> bytes:
    """Sorted distinct integers in [0, span) as Golomb-Rice coded gaps: one
    byte for the parameter, the unary quotients, then the remainders."""
    if not len(values):
        return b"\0"
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    k = max(0, (max(1, span // len(values))).bit_length() - 1)
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(quotient.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 0
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return bytes([k]) + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def rice_decode(blob: bytes, n: int) -> np.ndarray:
    """The ``n`` integers of ``rice_encode``."""
    if not n:
        return np.zeros(0, np.uint64)
    k = blob[0]
    rest_bytes = -(-n * k // 8)
    body = np.frombuffer(blob, np.uint8, offset=1)
    unary = np.unpackbits(body[:len(body) - rest_bytes])
    stops = np.flatnonzero(unary == 0)[:n]
    quotient = np.diff(stops, prepend=-1) - 1
    bits = np.unpackbits(body[len(body) - rest_bytes:])[:n * k].reshape(n, k).astype(np.uint64)
    rest = (bits << np.arange(k, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return np.cumsum((quotient.astype(np.uint64) << np.uint64(k)) + rest, dtype=np.uint64)


# --- steps -----------------------------------------------------------------------

def _fingerprint_bits(rows: int) -> int:
    return min(63, max(1, rows).bit_length() + SPARE_BITS)


def entries(docs: DataFrame, rows: int, owners: int, text_col: str, id_col: str, key: Column) -> DataFrame:
    """Entries (owner, rank, sha, text, ids, keys set) and messages (owner, n_sent,
    sent set) of all chunks; not yet written."""
    bits = _fingerprint_bits(rows)

    def close(chunk: int, held: dict[bytes, list]) -> Iterator[tuple]:
        import xxhash

        texts = list(held)
        shas = [hashlib.sha256(t).digest() for t in texts]
        fps = np.array([int.from_bytes(s[:8], "big") >> (64 - bits) for s in shas], np.uint64)
        owner = ((fps.astype(object) * owners) >> bits).astype(np.int64) if len(fps) else fps
        distinct, at = np.unique(fps, return_inverse=True)
        of = np.zeros(len(distinct), np.int64)
        of[at] = owner
        first = np.searchsorted(of, np.arange(owners + 1))
        for i, t in enumerate(texts):
            ids, keys = zip(*sorted(held[t], key=_row_order))
            yield (chunk, int(owner[i]), int(at[i] - first[owner[i]]), shas[i],
                   xxhash.xxh64_intdigest(t) - (1 << 63), t, ids, keys, None, None)
        for o in np.unique(of):
            sent = distinct[first[o]:first[o + 1]]
            low = _range_start(int(o), owners, bits)
            span = _range_start(int(o) + 1, owners, bits) - low
            yield (chunk, int(o), None, None, None, None, None, None, len(sent),
                   rice_encode(sent - np.uint64(low), span))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 24

        def rows_out() -> Iterator[tuple]:
            nonlocal chunk
            held: dict[bytes, list] = {}
            size = count = 0
            for batch in it:
                for doc_id, text, row_key in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1)),
                                                 batch.column(2).to_pylist()):
                    held.setdefault(t := normalise(text), []).append((doc_id, row_key))
                    size, count = size + len(t), count + 1
                    if size >= CHUNK_BYTES or count >= CHUNK_ROWS:
                        yield from close(chunk, held)
                        held, size, count, chunk = {}, 0, 0, chunk + 1
            if held:
                yield from close(chunk, held)

        yield from batches(rows_out(), _ENTRY, 512)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), key
                       ).mapInArrow(run, _ENTRY_DDL)


def _row_order(row: tuple[int | None, int]) -> tuple:
    """Rows (id, row key) by id, then row key; null ids last."""
    return row[0] is None, row[0] or 0, row[1]


def _range_start(owner: int, owners: int, bits: int) -> int:
    """Smallest fingerprint f with f * owners >> bits == owner."""
    return -(-(owner << bits) // owners)


def duplicate_bitmaps(messages: DataFrame) -> DataFrame:
    """chunk, owner, bitmap: which of the fingerprints that the chunk sent to
    the owner also came from another chunk."""
    out = pa.schema([("chunk", pa.int64()), ("owner", pa.int32()), ("bitmap", pa.binary())])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        sent = [rice_decode(b, n) for b, n in zip(t.column("sent").to_pylist(),
                                                  t.column("n_sent").to_pylist())]
        _, at, n = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        often = (n > 1)[at]
        cuts = np.cumsum([len(s) for s in sent])[:-1]
        maps = [np.packbits(part).tobytes() for part in np.split(often, cuts)]
        return pa.table([t.column("chunk").cast(pa.int64()),
                         pa.array([key[0].as_py()] * len(maps), pa.int32()),
                         pa.array(maps, pa.binary())], schema=out)

    return (messages.select("chunk", "owner", "n_sent", "sent").groupBy("owner")
            .applyInArrow(run, "chunk long, owner int, bitmap binary"))


def _suspects(table: DataFrame, folder: str) -> DataFrame:
    """Entries with a set bit.  Each chunk's bitmaps are one small folder
    ``chunk=<id>``; a task loads it when it meets the chunk."""
    schema = pa.schema([f for f in _ENTRY if f.name not in ("n_sent", "sent")])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        fs, root = open_shared(folder)
        chunk, bitmaps = None, {}
        for batch in it:
            keep = np.zeros(batch.num_rows, bool)
            for i, (c, o, r) in enumerate(zip(*(batch.column(k).to_pylist()
                                                for k in ("chunk", "owner", "rank")))):
                if c != chunk:
                    files = fs.get_file_info(_selector(f"{root}/chunk={c}"))
                    parts = [pq.read_table(fs.open_input_file(f.path)) for f in files
                             if f.path.endswith(".parquet")]
                    chunk, bitmaps = c, {k: v for p in parts for k, v in
                                         zip(p.column("owner").to_pylist(), p.column("bitmap").to_pylist())}
                keep[i] = bitmaps[o][r >> 3] >> (7 - (r & 7)) & 1
            if keep.any():
                yield batch.filter(pa.array(keep))

    return (table.filter("rank IS NOT NULL").select(*schema.names)
            .mapInArrow(run, "chunk long, owner int, rank int, sha binary, check long, text binary, "
                        "ids array<long>, keys array<long>"))


def _selector(path: str):
    from pyarrow import fs

    return fs.FileSelector(path)


def exact_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                 key_col: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 per row of ``docs``;
    with ``key_col``, a stored long that is unique per row, also that as
    row_key."""
    spark = docs.sparkSession
    rows = docs.count()
    owners = max(16, -(-rows // ROWS_PER_OWNER))
    key = F.col(key_col) if key_col else F.monotonically_increasing_id()
    table = materialize(entries(docs, rows, owners, text_col, id_col, key), "dedup-entries")
    folder = scratch_path(spark, "dedup-bitmaps")
    bitmaps = duplicate_bitmaps(table.filter("rank IS NULL"))
    (bitmaps.repartition(tasks_for(spark, rows, CHUNK_ROWS), "chunk")
     .write.partitionBy("chunk").parquet(folder))

    # the first row of an entry: null ids last, then by id and row key
    first = F.struct(F.col("ids")[0].isNull().alias("no_id"), F.col("ids")[0].alias("id"),
                     F.col("keys")[0].alias("key"))
    found = _suspects(table, folder).select("sha", "check", "text", F.size("ids").alias("n"),
                                            first.alias("first"))
    groups = materialize(
        found.groupBy("sha", "check", "text").agg(F.min("first").alias("keep"), F.sum("n").alias("group_size"))
        .drop("text"), "dedup-groups")
    own = table.filter("rank IS NOT NULL").select("sha", "check", "ids", "keys")
    # an entry outside the groups is a group of its own
    joined = own.join(groups, ["sha", "check"], "left").select(
        "ids", "keys", "sha", F.coalesce("keep", first).alias("keep"),
        F.coalesce("group_size", F.size("ids").cast("long")).alias("group_size"))
    return joined.select("keep", "group_size", "sha", F.explode(F.arrays_zip("ids", "keys")).alias("row")).select(
        F.col("row.ids").alias("doc_id"), F.col("keep.id").alias("keep_id"), "group_size",
        (F.col("row.keys") == F.col("keep.key")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *([F.col("row.keys").alias("row_key")] if key_col else []))
