"""WARC archives and a merged capture index.

* ``write_archives``: every task writes its rows as WARC/1.1 records, one gzip
  member per record, into archive files of bounded size in the shared folder.
  A file name holds the task attempt, and only the files of attempts that
  succeeded are returned.  ``mark_revisits`` decides before which records carry
  their payload (``response``) and which refer to an equal one (``revisit``,
  profile identical-payload-digest).
* ``read_archives``: an archive is read back record by record; payload digests
  are computed anew and must equal the record's header.  An archive gives one
  *run* of index entries, sorted by URL key and timestamp.
* ``merge_runs``: an external merge of the sorted runs.  Splitters over (URL key,
  timestamp, record) cut the key space into ranges of bounded size, a URL with
  a third of all captures spans many ranges.  Each run is cut at the splitters
  and sent to the ranges as sorted slices; a range merges its slices k ways in a
  loser tree.  (range, position) orders all captures globally.

URL keys are in sort-friendly form: host labels reversed, then path and query
in lower case, without scheme, leading www, default port and fragment.

Edge cases: a null payload is empty; a null URL gets the URI
``urn:page:<page_id>``; rows with a null page_id are always responses and never
referred to; rows that share the largest page_id of equal payloads are all
responses; very long payloads are archives of their own; without a date column,
or where it is null, ``WARC-Date`` is ``EPOCH``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
from typing import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import batches, hash_sampled, materialize, open_shared, shuffle_partitions, tasks_for
from tarmac.session import scratch_path

REVISIT_BYTES = 1000        # shorter payloads are always stored
ARCHIVE_BYTES = 64 << 20    # uncompressed bytes before a new archive is begun
RANGE_ROWS = 20_000         # captures of a merge range at most, about
SAMPLE_ROWS = 20_000        # captures from which splitters are taken
EPOCH = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- which records refer to another ------------------------------------------------

def capture_date(date_col: str | None) -> Column:
    """WARC-Date of a timestamp column (EPOCH where it is null or there is none)."""
    if date_col is None:
        return F.lit(EPOCH)
    return F.coalesce(F.date_format(F.col(date_col), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(EPOCH))


def mark_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str,
                  min_bytes: int = REVISIT_BYTES, date_col: str | None = None) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null: response), date."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = (pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                         payload.alias("payload"), capture_date(date_col).alias("date"))
            .withColumn("digest", F.sha1("payload")))
    long_ = F.octet_length("payload") >= min_bytes
    # equal payloads are few: only their digests and ids are joined back, by page
    same = (rows.filter(long_ & F.col("page_id").isNotNull()).groupBy("digest")
            .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1).select("digest", "keeper"))
    same = materialize(same, "warc-same")      # a fresh scan, so AQE can split a digest that many pages share
    known = rows.join(same, "digest", "left")
    return known.select("page_id", "url", "payload", "digest",
                        F.when(long_ & (F.col("page_id") != F.col("keeper")), F.col("keeper")).alias("refers_to"), "date")


# --- records ------------------------------------------------------------------------

def _b32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           date: str = EPOCH) -> bytes:
    """One WARC record: an HTTP response block, without the payload for a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    uri = "".join(c for c in url or "" if c >= " " and c != "\x7f").strip() or f"urn:page:{page_id}"
    head = [("WARC-Type", "response" if refers_to is None else "revisit"),
            ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", date), ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", "sha1:" + _b32(digest)),
            ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head += [("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "replace")
    return b"WARC/1.1\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("truncated WARC record")
        yield head, block


def url_key(uri: str) -> str:
    """Sort-friendly key of a URL: com,example)/path?query."""
    try:
        parts = urlsplit(uri)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return uri.lower()
    if not host:
        return uri.lower()
    host = host.removeprefix("www.")
    port_text = f":{port}" if port and port not in (80, 443) else ""
    key = ",".join(reversed(host.split("."))) + port_text + ")" + (parts.path or "/")
    return (key + (f"?{parts.query}" if parts.query else "")).lower()


# --- archives -----------------------------------------------------------------------

_ARCHIVE = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def write_archives(marked: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records of ``mark_revisits`` below ``folder`` (shared); one row
    per archive, to be materialised once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        fs, root = open_shared(folder)
        fs.create_dir(root, recursive=True)

        def archives() -> Iterator[tuple]:
            out, name, n, size, part = None, "", 0, 0, 0
            for batch in it:
                cols = [c.to_pylist() for c in batch.columns]
                for row in zip(*cols):
                    if out is None:
                        name = f"pages-{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{part:04d}.warc.gz"
                        out, n, size, part = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0, part + 1
                    data = record(*row)
                    out.write(gzip.compress(data, 1, mtime=0))
                    n, size = n + 1, size + len(data)
                    if size >= archive_bytes:
                        out.close()
                        out = None
                        yield name, n, size
            if out is not None:
                out.close()
                yield name, n, size

        yield from batches(archives(), _ARCHIVE)

    return marked.mapInArrow(run, "archive string, records long, bytes long")


_RUN = pa.schema([("run", pa.int64()), ("place", pa.int64()), ("range", pa.int64()), ("url_key", pa.string()),
                  ("date", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()),
                  ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                  ("archive", pa.string())])
_RUN_DDL = ("run long, place long, range long, url_key string, date string, page_id long, record_type string, "
            "refers_to long, payload_bytes long, payload_digest string, archive string")


def _page_number(urn: str) -> int | None:
    text = urn.strip("<>").removeprefix("urn:page:")
    return None if text == "None" else int(text)


def entry(head: dict[str, str], block: bytes) -> tuple:
    """(url key, date, page_id, type, refers_to, payload bytes, payload digest)."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = head["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {head['warc-record-id']} does not fit its digest")
    return (url_key(head["warc-target-uri"]), head["warc-date"], _page_number(head["warc-record-id"]),
            head["warc-type"], _page_number(head["warc-refers-to"]) if revisit else None, size, digest)


def _order(e: tuple) -> tuple:
    """Sort key of an entry: URL key, date, then the record."""
    return e[0], e[1], -1 if e[2] is None else e[2], e[6]


def read_archives(archives: DataFrame, folder: str, splitters: list[tuple]) -> DataFrame:
    """Read archives back: one sorted run of entries per archive, each entry
    with the merge range that ``splitters`` give it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_shared(folder)

        def rows() -> Iterator[tuple]:
            for batch in it:
                for number, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    with fs.open_input_stream(f"{root}/{name}", compression=None) as raw:
                        stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20)
                        found = sorted((entry(h, b) for h, b in parse_records(stream)), key=_order)
                    for place, e in enumerate(found):
                        yield number, place, bisect.bisect_right(splitters, _order(e)), *e, name

        yield from batches(rows(), _RUN)

    return archives.select("run", "archive").mapInArrow(run, _RUN_DDL)


class LoserTree:
    """k-way merge of sorted lists: inner nodes keep the loser of a match, the
    winner is at the top, and the next item replays one path."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key = runs, key
        self.at = [0] * len(runs)
        self.k = max(1, len(runs))
        self.head = [self._head(r) for r in range(len(runs))]
        self.tree = [-1] * self.k                # tree[0]: winner, then losers
        for r in range(len(runs)):
            self._replay(r, building=True)

    def _head(self, r: int):
        return (0, self.key(self.runs[r][self.at[r]]), r) if self.at[r] < len(self.runs[r]) else (1, (), r)

    def _replay(self, r: int, building: bool = False) -> None:
        node = (r + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0 and building:
                self.tree[node] = r
                return
            if other >= 0 and self.head[other] < self.head[r]:
                self.tree[node], r = r, other
            node //= 2
        self.tree[0] = r

    def __iter__(self) -> Iterator:
        while self.runs:
            r = self.tree[0]
            if self.head[r][0]:
                return
            yield self.runs[r][self.at[r]]
            self.at[r] += 1
            self.head[r] = self._head(r)
            self._replay(r)


def merge_runs(runs: DataFrame) -> DataFrame:
    """Globally ordered captures: (range, position) and the entry's columns."""
    names = [f.name for f in _RUN][3:]
    out = pa.schema([("range", pa.int64()), ("position", pa.int64()), *[_RUN.field(n) for n in names]])

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        slices: dict[int, list] = {}
        for run, place, e in sorted(zip(t.column("run").to_pylist(), t.column("place").to_pylist(),
                                        zip(*(t.column(n).to_pylist() for n in names))), key=lambda x: x[:2]):
            slices.setdefault(run, []).append(e)
        merged = list(LoserTree(list(slices.values()), _order))
        number = key[0].as_py()
        return pa.Table.from_batches(
            list(batches(((number, i, *e) for i, e in enumerate(merged)), out)), schema=out)

    ddl = "range long, position long, " + _RUN_DDL.partition("range long, ")[2]
    return runs.groupBy("range").applyInArrow(merge, ddl)


def splitters(pages: DataFrame, id_col: str, url_col: str, payload_col: str, ranges: int, n_pages: int,
              sample: int = SAMPLE_ROWS, date_col: str | None = None) -> list[tuple]:
    """``ranges`` - 1 splitters from a bounded sample of the captures, picked by
    hash; equal captures, which no splitter can part, count as one."""
    if ranges < 2:
        return []
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        capture_date(date_col).alias("date"),
                        F.sha1(F.coalesce(F.col(payload_col).cast("string"), F.lit(""))).alias("sha"))
    got = hash_sampled(rows, F.xxhash64("id", "url", "date"), n_pages, sample)
    keys = []
    for r in got:
        head, block = next(parse_records(io.BytesIO(record(
            r["id"], r["url"], b"", hashlib.sha1(b"").hexdigest(), None, r["date"]))))
        e = entry(head, block)
        keys.append(_order((*e[:6], r["sha"])))
    keys.sort()
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def capture_index(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  min_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES,
                  range_rows: int = RANGE_ROWS, date_col: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back and merge the index runs:
    range, position, url_key, date, page_id, record_type, refers_to,
    payload_bytes, payload_digest, archive per row, in global order (URL key, date,
    page).  ``date_col``: the captures' timestamps."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    n = pages.count()
    ranges = max(1, -(-n // range_rows), min(2 * shuffle_partitions(spark), n // 500))
    cuts = splitters(pages, id_col, url_col, payload_col, ranges, n, date_col=date_col)
    marked = mark_revisits(pages, id_col, url_col, payload_col, min_bytes, date_col)
    archives = materialize(
        write_archives(marked, folder, archive_bytes).withColumn("run", F.monotonically_increasing_id()),
        "warc-archives")
    one_each = archives.repartition(tasks_for(spark, archives.count(), 4), "run")
    return merge_runs(read_archives(one_each, folder, cuts))
