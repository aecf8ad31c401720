"""Best-fit packing of documents into sequences, after Martello-Toth
dominance reduction.

1. ``pieces``: documents become token ids (plus an end id); only longer ones
   than ``capacity`` are cut.  The pieces (without texts or ids) are a written
   table.
2. The lengths of all pieces form a histogram with at most ``capacity`` rows,
   whatever the number of documents.  ``plan`` packs the histogram: items of
   equal length are interchangeable, so a bin *pattern* with a multiplicity
   stands for any number of equal bins.
   * Reduction (``reduce_instance``): for each length j, longest first, a set F
     of at most three pieces that contains j and dominates every other feasible
     set with j is fixed for good: {j} if nothing fits beside it;
     {j, k} with the largest fitting k if k fills the bin, no two pieces fit
     beside j, or k is at least as long as any two that fit; {j, a, b} if k can
     be taken as a, {a, b} dominates every other pair and no three fit.  An
     optimal packing that contains F exists, so the rest is a smaller instance.
   * Rest (``best_fit``): longest first, each piece goes to the fullest bin
     that takes it; equal pieces and equal bins move together.
3. Pieces of one length are numbered without putting a length in one task (a
   length is dealt over salted groups, group sizes give offsets), and a piece's
   number finds its pattern, bin and offset.

Edge cases: null or empty text is one piece with the end id alone; a null
doc_id is kept; repeated rows are packed each; a text of more than ``capacity``
tokens is cut; pieces of equal length take any places of that length; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import materialize
from tarmac.llm.textids import text_ids
from tarmac.llm.words import default_vocab

CAPACITY = 4096
END_ID = 1
GROUP_ROWS = 64             # a numbering group has at least so many rows ...
GROUPS = 4096               # ... and about 1/4096 of all rows at most

_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                    ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocab: str | None = None, capacity: int = CAPACITY,
           end_id: int = END_ID, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 per piece."""
    vocab = vocab or default_vocab()
    end = np.array([end_id], "<u4").tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = text_ids(vocab)
        for batch in it:
            out: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of(batch.column(1))):
                ids = ids.tobytes() + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    for col, v in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PIECE)],
                                             schema=_PIECE)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")
                       ).mapInArrow(run, _PIECE_DDL)


# --- the plan over the histogram -------------------------------------------------

Pattern = tuple[tuple[int, int], ...]       # (length, how many), in bin order


class _Lengths:
    """Multiset of lengths: sorted distinct lengths with counts."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.keys = sorted(self.n)

    def take(self, length: int, n: int) -> None:
        self.n[length] -= n
        if not self.n[length]:
            del self.n[length]
            self.keys.pop(bisect.bisect_left(self.keys, length))

    def smallest(self, n: int, without: int) -> list[int]:
        """The n smallest lengths when one piece of length ``without`` is out."""
        out: list[int] = []
        for k in self.keys:
            out += [k] * min(n, self.n[k] - (k == without))
            if len(out) >= n:
                break
        return out[:n]

    def largest(self, limit: int, without: tuple[int, ...] = ()) -> int | None:
        """The largest length up to ``limit`` once ``without`` is out."""
        at = bisect.bisect_right(self.keys, limit) - 1
        while at >= 0 and self.n[self.keys[at]] <= without.count(self.keys[at]):
            at -= 1
        return self.keys[at] if at >= 0 else None


def dominating_set(lengths: _Lengths, j: int, capacity: int) -> Pattern | None:
    """A set with one piece of length j that dominates all feasible sets with
    j, or None if none of at most three pieces is found."""
    room = capacity - j
    low = lengths.smallest(3, j)
    if not low or low[0] > room:
        return ((j, 1),)
    k = lengths.largest(room, (j,))
    if k == room or len(low) < 2 or low[0] + low[1] > room:
        return _pattern(j, k)
    # the best pairs beside j
    pairs: list[tuple[int, int]] = []
    for a in reversed(lengths.keys):
        if lengths.n[a] <= (a == j) or a + low[0] > room:
            continue
        b = lengths.largest(min(a, room - a), (j, a))
        if b is None:
            continue
        if pairs and b <= pairs[-1][1]:
            continue                        # smaller in both
        pairs.append((a, b))
        if len(pairs) > 1:
            break
    if len(low) == 3 and sum(low) <= room:
        return None                         # four pieces fit: not decided here
    if pairs and max(a + b for a, b in pairs) <= k and len(pairs) == 1:
        return _pattern(j, k)               # k stands for any two together
    if len(pairs) == 1 and pairs[0][0] >= k:
        return _pattern(j, *pairs[0])       # better piece by piece than any other choice
    return None


def _pattern(*parts: int) -> Pattern:
    return tuple((p, parts.count(p)) for p in sorted(set(parts), reverse=True))


def reduce_instance(lengths: _Lengths, capacity: int) -> list[tuple[Pattern, int]]:
    """Fix dominating sets, longest length first."""
    fixed: list[tuple[Pattern, int]] = []
    for j in reversed(list(lengths.keys)):
        while j in lengths.n and (pattern := dominating_set(lengths, j, capacity)):
            # taking pieces away only removes alternatives, so the choice holds
            # as long as its own pieces last
            times = min(lengths.n[p] // q for p, q in pattern)
            for p, q in pattern:
                lengths.take(p, q * times)
            fixed.append((pattern, times))
    return fixed


def best_fit(lengths: _Lengths, capacity: int) -> list[tuple[Pattern, int]]:
    """Longest first into the fullest bins that take it, equal bins together."""
    open_: dict[int, list[tuple[Pattern, int]]] = {}      # room left -> patterns
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((pattern, n))

    for length in reversed(lengths.keys):
        left = lengths.n[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                per = capacity // length
                if bins := left // per:
                    put(capacity - per * length, ((length, per),), bins)
                if rest := left % per:
                    put(capacity - rest * length, ((length, rest),), 1)
                break
            room = rooms[at]
            pattern, bins = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            per = room // length
            full = min(bins, left // per)
            if full:
                put(room - per * length, (*pattern, (length, per)), full)
            left -= full * per
            if full < bins:
                if left:                                   # fewer than per are left
                    put(room - left * length, (*pattern, (length, left)), 1)
                    full, left = full + 1, 0
                if full < bins:
                    put(room, pattern, bins - full)
    return [x for same in open_.values() for x in same]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """(pattern, number of equal bins) for a histogram length -> count."""
    lengths = _Lengths(counts)
    return reduce_instance(lengths, capacity) + best_fit(lengths, capacity)


def _slots(bins: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """length -> rows (first number, first bin, pieces per bin, offset)."""
    slots: dict[int, list] = {}
    used: dict[int, int] = {}
    first_bin = 0
    for pattern, n in bins:
        offset = 0
        for length, per in pattern:
            at = used.get(length, 0)
            slots.setdefault(length, []).append((at, first_bin, per, offset))
            used[length] = at + n * per
            offset += length * per
        first_bin += n
    return {k: np.array(v, np.int64) for k, v in slots.items()}


def pack(docs: DataFrame, vocab: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
         text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The pieces of ``docs`` with sequence_id and offset."""
    spark = docs.sparkSession
    table = materialize(pieces(docs, vocab, capacity, end_id, text_col, id_col), "pack-pieces")
    # at most ``capacity`` rows
    counts = {r["length"]: r["n"] for r in
              table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(plan(counts, capacity)))
    group = max(GROUP_ROWS, -(-sum(counts.values()) // GROUPS))
    # at most GROUPS + capacity groups
    salts = spark.createDataFrame([(k, -(-n // group)) for k, n in counts.items()],
                                  "length long, salts long")
    row = ["doc_id", "piece", "start", "ids_crc32"]
    dealt = (table.join(F.broadcast(salts), "length")
             .withColumn("salt", F.pmod(F.xxhash64(*row, F.spark_partition_id()), F.col("salts")))
             .drop("salts"))
    dealt = materialize(dealt, "pack-dealt")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
               .select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    inside = Window.partitionBy("length", "salt").orderBy(*row)
    numbered = (dealt.withColumn("number", F.row_number().over(inside) - 1)
                .join(F.broadcast(offsets), ["length", "salt"])
                .select("doc_id", "piece", "start", "length", "ids_crc32",
                        (F.col("number") + F.col("before")).alias("number")))
    out = pa.schema([*_PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            seq, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            same = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0]) if len(order) else []
            for rows in np.split(order, same[1:]):
                if not len(rows):
                    continue
                size = int(length[rows[0]])
                slot = slots.value[size]
                slot = slot[np.searchsorted(slot[:, 0], number[rows], "right") - 1]
                inner = number[rows] - slot[:, 0]
                seq[rows] = slot[:, 1] + inner // slot[:, 2]
                offset[rows] = slot[:, 3] + inner % slot[:, 2] * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(offset)],
                                             schema=out)

    return numbered.mapInArrow(place, _PIECE_DDL + ", sequence_id long, offset long")
