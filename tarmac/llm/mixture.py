"""Mixture-controlled packing: deficit round-robin over source queues.

Every source has a queue of its documents' tokens (in table order) and a target
share.  A round grants each queue ``window`` x share tokens; a queue sends whole
packets of ``packet`` tokens as long as its grants cover them, and what is left,
its deficit, stays for the next rounds.  The queues take turns in a fixed order,
so the sends of all rounds form one stream, which is cut into sequences of
``capacity`` tokens.  Any stretch of the stream therefore holds the target
proportions up to a packet per queue, until a queue runs dry; then the others
share on.  By default a source's share is its share of all tokens, so that all
queues run dry together and the whole table is one even mixture.

After r rounds a queue has sent ``min(tokens, packet * ((r * quantum + first) div
packet))``, so the deficit that a partition or window hands to the next one is
known from numbers alone (``Rounds``), and no task waits for another:

1. ``encode``: a task writes its documents' ids in chunks of bounded size to a
   side file of the shared folder, with one row per chunk: its place and the
   tokens of each source in it (a written table).
2. Token totals per source give the quanta; running totals over the chunks give
   the place in its queue at which a chunk's part begins.  Both are sums over
   chunk rows; the ids are not shuffled.
3. A task reads a chunk back, finds the round and the place in the stream of
   every packet, and cuts pieces at the ends of rounds, sequences and documents.

Nothing is padded: sequences are full, and the rest of the stream is cut into
sequences whose lengths are powers of two (its binary digits).

At most ``MAX_QUEUES`` queues: with more sources, those with fewest tokens share
the last queue (each of them would have less than ``window / MAX_QUEUES`` tokens
of a window); they are packed whole like all others.

Edge cases: null or empty text is the end id alone; a null doc_id is kept; a null
source is a source of its own; repeated rows are packed each; equal sources by
tokens are told apart by the hash of their names; a text longer than a chunk is
a chunk of its own; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from typing import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarmac.llm.bpe import _SideFile, from_planes, pack_parts, planes, read_side, unpack_parts
from tarmac.llm.common import batches, materialize, tasks_for
from tarmac.llm.textids import text_ids
from tarmac.llm.words import default_vocab
from tarmac.session import scratch_path

CAPACITY = 4096
END_ID = 2
PACKET = 64                 # tokens sent at once
MAX_QUEUES = 1024
CHUNK_TOKENS = 2 << 20      # ids written and placed together
CHUNK_ROWS = 50_000
CHUNKS_PER_TASK = 2
UNIT = 1 << 16              # parts of a token in a quantum
ROUNDS_AT_ONCE = 2048

_CHUNK = pa.schema([("chunk", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("size", pa.int64()),
                    ("keys", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])
_CHUNK_DDL = "chunk long, file string, start long, size long, keys array<long>, tokens array<long>"
_OUT = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                             "sequence_id", "offset")])
_OUT_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# --- rounds ----------------------------------------------------------------------

class Rounds:
    """Deficit round-robin in closed form.

    ``tokens`` and ``shares`` per queue (shares are normalised).  A quantum is
    a whole number of 1/UNIT tokens.  The first deficits differ from queue to
    queue, so that queues with equal quanta do not send in the same rounds."""

    def __init__(self, tokens: list[int], shares: list[float], window: int, packet: int):
        whole = sum(shares) or 1.0
        self.n = np.array(tokens, np.int64)
        self.quantum = np.array([max(1, round(window * UNIT * s / whole)) for s in shares], np.int64)
        self.packet = packet
        self.first = np.arange(len(tokens), dtype=np.int64) * (packet * UNIT) // max(1, len(tokens))
        self.rounds = self.round_of(np.maximum(self.n - 1, 0), np.arange(len(tokens)))

    def round_of(self, token: np.ndarray, queue: np.ndarray) -> np.ndarray:
        """The round (from 1) in which a queue sends its token number ``token``."""
        packets = token // self.packet + 1
        need = packets * (self.packet * UNIT) - self.first[queue]
        return -(-need // self.quantum[queue])

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that each queue (column) has sent after so many rounds (row)."""
        r = np.minimum(rounds[:, None], self.rounds)
        done = (r * self.quantum + self.first) // (self.packet * UNIT) * self.packet
        return np.minimum(np.where(rounds[:, None] >= self.rounds, self.n, done), self.n)

    def places(self, token: np.ndarray, queue: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        """Place in the stream of a queue's token, sent in the given round."""
        out = np.empty(len(token), np.int64)
        order = np.argsort(rounds, kind="stable")
        distinct, first = np.unique(rounds[order], return_index=True)
        bounds = np.append(first, len(order))
        for at in range(0, len(distinct), ROUNDS_AT_ONCE):
            now = distinct[at:at + ROUNDS_AT_ONCE]
            before, after = self.sent(now - 1), self.sent(now)
            ahead = np.cumsum(after - before, axis=1) - (after - before) + before.sum(axis=1, keepdims=True)
            rows = order[bounds[at]:bounds[at + len(now)]]
            which = np.searchsorted(now, rounds[rows])
            q = queue[rows]
            out[rows] = ahead[which, q] + token[rows] - before[which, q]
        return out


def _ranges(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of every value first[i] .. first[i] + n[i] - 1."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - first, n)


def sequence_starts(total: int, capacity: int) -> tuple[int, list[int]]:
    """(number of full sequences, places where the sequences after them begin,
    and the end): the rest in powers of two, longest first."""
    full = total // capacity
    starts = [full * capacity]
    for bit in reversed(range(capacity.bit_length())):
        if (total - full * capacity) >> bit & 1:
            starts.append(starts[-1] + (1 << bit))
    return full, starts


def cut(rounds: Rounds, first: np.ndarray, n: np.ndarray, queue: np.ndarray, capacity: int
        ) -> tuple[np.ndarray, ...]:
    """Pieces (document, start, length, sequence, offset) of documents whose
    ``n`` tokens begin at place ``first`` of their queues."""
    g = rounds.packet
    doc, packet = _ranges(first // g, (first + n - 1) // g - first // g + 1)
    begin = np.maximum(packet * g, first[doc])
    end = np.minimum((packet + 1) * g, (first + n)[doc])
    sent_in = rounds.round_of(begin, queue[doc])
    # packets of a document and round are one run
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (sent_in[1:] != sent_in[:-1])
    runs = np.flatnonzero(new)
    last = np.append(runs[1:], len(doc))[:len(runs)] - 1
    doc, begin, length = doc[runs], begin[runs], end[last] - begin[runs]
    place = rounds.places(begin, queue[doc], sent_in[runs])
    # cut where sequences begin
    full, rest = sequence_starts(int(rounds.n.sum()), capacity)
    row, seq = _ranges(place // capacity, (place + length - 1) // capacity - place // capacity + 1)
    lo = np.maximum(place[row], seq * capacity)
    hi = np.minimum((place + length)[row], (seq + 1) * capacity)
    tail = seq >= full
    if tail.any():
        starts = np.array(rest, np.int64)
        a = np.searchsorted(starts, lo[tail], "right") - 1
        b = np.searchsorted(starts, hi[tail], "left") - 1
        trow, tseq = _ranges(a, b - a + 1)
        tlo = np.maximum(lo[tail][trow], starts[tseq])
        thi = np.minimum(hi[tail][trow], starts[tseq + 1])
        row = np.concatenate([row[~tail], row[tail][trow]])
        lo, hi = np.concatenate([lo[~tail], tlo]), np.concatenate([hi[~tail], thi])
        seq = np.concatenate([seq[~tail], full + tseq])
        origin = np.concatenate([seq[:len(seq) - len(tseq)] * capacity, starts[tseq]])
    else:
        origin = seq * capacity
    start = begin[row] + (lo - place[row]) - first[doc[row]]
    doc, length, offset = doc[row], hi - lo, lo - origin
    # a document's runs that follow each other within a sequence are one piece
    order = np.lexsort((start, doc))
    doc, start, length, seq, offset = (x[order] for x in (doc, start, length, seq, offset))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (seq[1:] != seq[:-1]) | (offset[1:] != (offset + length)[:-1])
    at = np.flatnonzero(new)
    length = np.add.reduceat(length, at) if len(at) else length
    return doc[at], start[at], length, seq[at], offset[at]


# --- Spark -----------------------------------------------------------------------

def encode(docs: DataFrame, folder: str, vocab: str, end_id: int, text_col: str, id_col: str,
           source_col: str | None) -> DataFrame:
    """One row per chunk of documents, whose ids are in a file below ``folder``.
    To be written once: a file belongs to one task attempt."""

    def close(chunk: int, ids: list, keys: list[int], parts: list[np.ndarray], file) -> tuple:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        names, number = np.unique(np.array(keys, np.int64), return_inverse=True)
        blob = pack_parts(
            np.array([i is None for i in ids], bool).tobytes(), np.array([i or 0 for i in ids], np.int64).tobytes(),
            number.astype("<u4").tobytes(), sizes.tobytes(), planes(np.concatenate(parts)))
        start = file.tell()
        file.write(blob)
        totals = np.zeros(len(names), np.int64)
        np.add.at(totals, number, sizes)
        return chunk, file.name, start, len(blob), names.tolist(), totals.tolist()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        file = _SideFile(folder, f"ids-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.bin")
        ids_of = text_ids(vocab)
        end = np.array([end_id], np.uint32)

        def chunks() -> Iterator[tuple]:
            chunk = ctx.partitionId() << 24
            ids, keys, parts, size = [], [], [], 0
            for batch in it:
                rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ids_of(batch.column(2)))
                for doc_id, key, part in rows:
                    ids.append(doc_id)
                    keys.append(key)
                    parts.append(np.concatenate([part, end]))
                    size += len(part) + 1
                    if size >= CHUNK_TOKENS or len(ids) >= CHUNK_ROWS:
                        yield close(chunk, ids, keys, parts, file)
                        ids, keys, parts, size, chunk = [], [], [], 0, chunk + 1
            if ids:
                yield close(chunk, ids, keys, parts, file)

        yield from batches(chunks(), _CHUNK, 64)
        file.close()

    key = F.xxhash64(F.col(source_col)) if source_col else F.lit(0).cast("long")
    return docs.select(F.col(id_col).cast("long"), key, F.col(text_col).cast("string")).mapInArrow(run, _CHUNK_DDL)


def _queues(spark: SparkSession, per_key: DataFrame, targets: Mapping[str | None, float] | None
            ) -> tuple[dict[int, int], list[int], list[float]]:
    """(queue of each source key but those of the shared last queue, tokens per
    queue, share per queue)."""
    totals = per_key.groupBy("key").agg(F.sum("tokens").alias("tokens"))
    whole = per_key.agg(F.sum("tokens")).first()[0] or 0
    rows = totals.orderBy(F.desc("tokens"), "key").limit(MAX_QUEUES).collect()
    if len(rows) == MAX_QUEUES:
        rows = rows[:-1]                # the last queue takes all other sources
    queue = {r["key"]: i for i, r in enumerate(rows)}
    tokens = [r["tokens"] for r in rows]
    shares = [t / whole for t in tokens] if whole else []
    if targets:
        names = spark.createDataFrame([(k, float(v)) for k, v in targets.items()], "source string, share double")
        for r in names.select(F.xxhash64("source").alias("key"), "share").collect():
            if r["key"] in queue:
                shares[queue[r["key"]]] = r["share"]
    if (rest := whole - sum(tokens)) > 0:
        tokens.append(rest)
        shares.append(rest / whole)
    return queue, tokens, shares


def _chunk_offsets(per_key: DataFrame, queue: dict[int, int], spark: SparkSession) -> DataFrame:
    """chunk, starts (queue, before): the tokens of each of the chunk's queues in
    earlier chunks.  Chunks are summed in groups first, so that no task has a
    row per chunk of a queue."""
    known = F.broadcast(spark.createDataFrame(list(queue.items()), "key long, queue int"))   # <= MAX_QUEUES rows
    sums = (per_key.join(known, "key", "left")
            .groupBy("chunk", F.coalesce("queue", F.lit(len(queue))).alias("queue"))
            .agg(F.sum("tokens").alias("n"))
            .withColumn("group", F.shiftright("chunk", 32)))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    groups = (sums.groupBy("queue", "group").agg(F.sum("n").alias("n"))
              .select("queue", "group", F.coalesce(F.sum("n").over(earlier("queue").orderBy("group")),
                                                   F.lit(0)).alias("groups_before")))
    inside = F.coalesce(F.sum("n").over(earlier("queue", "group").orderBy("chunk")), F.lit(0))
    return (sums.withColumn("inside", inside).join(groups, ["queue", "group"])
            .groupBy("chunk").agg(F.collect_list(F.struct(
                "queue", (F.col("inside") + F.col("groups_before")).alias("before"))).alias("starts")))


def pack(docs: DataFrame, targets: Mapping[str | None, float] | None = None, vocab: str | None = None,
         capacity: int = CAPACITY, end_id: int = END_ID, window: int | None = None, packet: int = PACKET,
         text_col: str = "text", id_col: str = "doc_id", source_col: str | None = "source") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of the
    pieces of ``docs``.

    ``targets`` gives shares of sources (default, also for sources that it does
    not name: their share of all tokens).  ``window`` tokens are granted a round
    (default: one sequence); longer windows cut documents less often."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "mixture-ids")
    table = materialize(encode(docs, folder, vocab or default_vocab(), end_id, text_col, id_col, source_col),
                        "mixture-chunks")
    pairs = F.explode(F.arrays_zip("keys", "tokens")).alias("p")
    per_key = table.select("chunk", pairs).select("chunk", F.col("p.keys").alias("key"), F.col("p.tokens").alias("tokens"))
    queue, tokens, shares = _queues(spark, per_key, targets)
    shared = spark.sparkContext.broadcast((queue, Rounds(tokens, shares, window or capacity, packet)))
    todo = table.drop("tokens").join(_chunk_offsets(per_key, queue, spark), "chunk")
    todo = todo.repartition(tasks_for(spark, table.count(), CHUNKS_PER_TASK), "chunk")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue_of, rounds = shared.value
        for batch in it:
            for chunk in batch.to_pylist():
                yield from place(chunk, queue_of, rounds)

    def place(chunk: dict, queue_of: dict[int, int], rounds: Rounds) -> Iterator[pa.RecordBatch]:
        null, ids, number, sizes, raw = unpack_parts(read_side(folder, chunk["file"], chunk["start"], chunk["size"]))
        null, ids, sizes = np.frombuffer(null, bool), np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
        data = memoryview(from_planes(raw).tobytes())
        names = np.array([queue_of.get(k, len(queue_of)) for k in chunk["keys"]], np.int64)
        queue = names[np.frombuffer(number, "<u4")]
        before = np.zeros(len(queue_of) + 1, np.int64)
        for s in chunk["starts"]:
            before[s["queue"]] = s["before"]
        # place of each document in its queue
        order = np.argsort(queue, kind="stable")
        upto = np.cumsum(sizes[order]) - sizes[order]
        heads = np.flatnonzero(np.r_[True, np.diff(queue[order]) != 0])
        upto -= np.repeat(upto[heads], np.diff(np.append(heads, len(order))))
        first = np.empty(len(sizes), np.int64)
        first[order] = upto + before[queue[order]]
        doc, start, length, seq, offset = cut(rounds, first, sizes, queue, capacity)
        at = 4 * ((np.cumsum(sizes) - sizes)[doc] + start)
        crc = np.fromiter((zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())),
                          np.int64, len(at))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[doc], mask=null[doc]), *map(pa.array, (start, length, crc, sizes[doc], seq, offset))],
            schema=_OUT)

    return todo.mapInArrow(run, _OUT_DDL)
