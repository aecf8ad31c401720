"""SimHash near-duplicate groups through a Gray-order hierarchical index.

Fingerprints (``fingerprints``): a text is lower-cased (A-Z), cut into words
at ASCII white space and into ``shingle_words``-word shingles (repeats
included; a shorter text is one shingle, a text without words has fingerprint
0).  Bit b of the 64 is set when it is set in over half of the shingles'
XXH64 hashes.

Links (``linked``): every pair of distinct fingerprints that differ in at most
``max_bits`` bits is found.

* The 64 bits are cut into ``max_bits + 1`` masks.  Two fingerprints within
  ``max_bits`` agree on at least one mask (pigeonhole), so each mask with its
  bit pattern is a top node of the index, and Spark shuffles fingerprints by
  top node.  A top node that holds more than ``node_rows`` fingerprints is cut
  into blocks, and every pair of blocks becomes a work unit of its own.
* Inside a unit fingerprints are sorted by Gray rank, so that neighbours share
  bits.  Levels of ``FANOUT`` neighbours become nodes that hold the masked bit
  pattern all their members share, less what their parent already holds.
* All fingerprints of a unit descend the nodes together.  A pair of
  (fingerprint, node) adds up the bits in which it differs from the patterns
  on the path and is dropped, with the whole group below, once the sum exceeds
  ``max_bits``.

Components (``near_duplicate_groups``): each task reduces the links it found to
stars (one link per fingerprint), so the number of links that leave a task is
bounded by its rows.  Components come from repeated minimum exchange over the
links with pointer jumping, each round written to the shared folder.

Exact copies meet as one fingerprint before any search (a grouped minimum with
a map-side step), so a group of copies of any size costs one row per task.

Every row has a row key.  Components are told apart by their smallest row key,
and the first row of a component, by doc_id (nulls last) and row key, names it.

Edge cases: null text counts as empty (fingerprint 0, linked like any other);
a null doc_id is never a component id, a component of null ids has a null id;
repeated rows are listed; a very long text gives one fingerprint of all its
shingles; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import materialize, tasks_for, utf8_rows

SEED = 42
FANOUT = 8
NODE_ROWS = 2048           # fingerprints below one top node before it is cut into blocks
MAX_BLOCK_SHARE = 4096     # a block holds at least 1/4096 of all fingerprints
ROWS_PER_TASK = 1_000_000
FRONTIER = 1 << 20         # (fingerprint, node) pairs looked at together
_HASH_BLOCK = 1 << 15
_NO_ID = (1 << 63) - 1


# --- fingerprints -----------------------------------------------------------

def fingerprint(text: bytes | None, shingle_words: int = 3, seed: int = SEED) -> int:
    """64-bit SimHash (unsigned) of a UTF-8 text."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < shingle_words:
        return h(b" ".join(words), seed)
    total = len(words) - shingle_words + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, total, _HASH_BLOCK):
        part = words[at:at + _HASH_BLOCK + shingle_words - 1]
        grams = zip(*(part[i:] for i in range(shingle_words)))
        hashes = np.array([h(b" ".join(g), seed) for g in grams], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                 shingle_words: int = 3, seed: int = SEED, key_col: str | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long), row_key per
    row; the key is ``key_col`` or else a new one."""
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("row_key", pa.int64())])
    key = F.col(key_col) if key_col else F.monotonically_increasing_id()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = np.fromiter((fingerprint(t, shingle_words, seed)
                               for t in utf8_rows(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)],
                                             schema=out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"), key.alias("row_key")
                       ).mapInArrow(run, "doc_id long, fp long, row_key long")


# --- the index ----------------------------------------------------------------

def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Position of each 64-bit pattern in the reflected Gray sequence."""
    r = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(shift)
    return r


def masks(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the ``max_bits + 1`` top masks over 64 bits."""
    n = max_bits + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


class GrayIndex:
    """Hierarchical index over the rows of many work units.

    ``unit``: non-decreasing work-unit number per row; within a unit rows are
    in Gray order.  ``levels[k]``: per node the first row or child node, the
    unit, the pattern that all members share and the mask of those bits less
    the mask of the node above."""

    def __init__(self, unit: np.ndarray, fps: np.ndarray):
        self.fps = fps
        first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if len(unit) else np.zeros(0, int)
        start = np.repeat(first, np.diff(np.r_[first, len(unit)]))
        self.levels: list[dict] = []
        ones, zeros, node_unit, pos = fps, ~fps, unit, np.arange(len(unit)) - start
        while len(node_unit) and (not self.levels or pos.max(initial=0) > 0):
            block = pos // FANOUT
            cut = np.flatnonzero(np.r_[True, (node_unit[1:] != node_unit[:-1]) | (block[1:] != block[:-1])])
            self.levels.append({"ends": np.r_[cut, len(node_unit)]})
            ones = np.bitwise_and.reduceat(ones, cut)
            zeros = np.bitwise_and.reduceat(zeros, cut)
            node_unit, pos = node_unit[cut], block[cut]
            self.levels[-1] |= {"pattern": ones, "mask": ones | zeros, "unit": node_unit}
        for below, above in zip(self.levels, self.levels[1:]):
            up = np.repeat(above["mask"], np.diff(above["ends"]))
            below["new"] = below["mask"] & ~up
        if self.levels:
            self.levels[-1]["new"] = self.levels[-1]["mask"]

    def within(self, max_bits: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, other row) with row < other row, same unit, at most
        ``max_bits`` apart, for the given rows."""
        if not self.levels or not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        top = self.levels[-1]
        row_unit = self._row_unit[rows]
        node = np.searchsorted(top["unit"], row_unit)
        q = rows
        acc = np.bitwise_count((self.fps[q] ^ top["pattern"][node]) & top["new"][node]).astype(np.int16)
        keep = acc <= max_bits
        q, node, acc = q[keep], node[keep], acc[keep]
        for level in range(len(self.levels) - 1, 0, -1):
            here, below = self.levels[level], self.levels[level - 1]
            q, node, acc = self._children(here["ends"], q, node, acc)
            last = below["ends"][node + 1] - 1 if level == 1 else None
            acc = acc + np.bitwise_count((self.fps[q] ^ below["pattern"][node]) & below["new"][node])
            keep = acc <= max_bits
            if last is not None:
                keep &= last > q          # each pair once: rows after q only
            q, node, acc = q[keep], node[keep], acc[keep]
        mask = self.levels[0]["mask"][node]
        reps = np.diff(self.levels[0]["ends"])[node]
        mask = np.repeat(mask, reps)
        q, row, acc = self._children(self.levels[0]["ends"], q, node, acc)
        acc = acc + np.bitwise_count((self.fps[q] ^ self.fps[row]) & ~mask)
        keep = (acc <= max_bits) & (row > q)
        return q[keep], row[keep]

    @staticmethod
    def _children(ends, q, node, acc):
        n = ends[node + 1] - ends[node]
        total = int(n.sum())
        child = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[node], n)
        return np.repeat(q, n), child, np.repeat(acc, n)

    def pairs(self, max_bits: int, unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs, in slices of rows whose frontier stays near FRONTIER."""
        self._row_unit = unit
        if not len(unit):
            return
        # rows that a row can meet: those of its unit, but only sum(C(64, i <= 3))
        # patterns lie within 3 bits, so the pruned frontier of a row stays small
        size = np.minimum(np.bincount(unit)[unit], 4096)
        cost = np.cumsum(size)
        at = 0
        while at < len(unit):
            to = int(np.searchsorted(cost, (cost[at - 1] if at else 0) + FRONTIER, "right"))
            to = max(to, at + 1)
            yield self.within(max_bits, np.arange(at, to))
            at = to


def stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest connected row per row 0..n-1 over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        root_a, root_b = label[a], label[b]
        low = np.minimum(root_a, root_b)
        np.minimum.at(label, root_a, low)
        np.minimum.at(label, root_b, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _link_task(max_bits: int):
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(it)
        if not held:
            return
        t = pa.Table.from_batches(held)
        part, key, lo, hi, salt = (t.column(c).to_numpy() for c in ("part", "key", "lo", "hi", "salt"))
        fps = t.column("fp").to_numpy().view(np.uint64)
        order = np.lexsort((gray_rank(fps), hi, lo, key, part))
        part, key, lo, hi, salt, fps = (x[order] for x in (part, key, lo, hi, salt, fps))
        new = np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1])
                    | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
        unit = np.cumsum(new) - 1
        # one number per fingerprint of this task: the links of all its units meet
        same, node = np.unique(fps, return_inverse=True)
        label = np.arange(len(same))
        for a, b in GrayIndex(unit, fps).pairs(max_bits, unit):
            cross = (lo[a] == hi[a]) | (salt[a] != salt[b])   # a block meets itself in one unit only
            a, b = label[node[a[cross]]], label[node[b[cross]]]
            open_ = a != b
            if open_.any():
                label = stars(a[open_], b[open_], len(same))[label]
        linked = np.flatnonzero(label != np.arange(len(same)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(same[linked].view(np.int64)), pa.array(same[label[linked]].view(np.int64))],
            schema=out)

    return run


def linked(nodes: DataFrame, max_bits: int = 3, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links u, v between the distinct fingerprints of ``nodes`` (column fp,
    a table that can be read twice) that connect exactly the fingerprints
    connected by pairs at most ``max_bits`` bits apart."""
    spark = nodes.sparkSession
    n = nodes.count()
    block = max(node_rows, -(-n // MAX_BLOCK_SHARE))
    tops = [F.struct(F.lit(i).alias("part"),
                     F.shiftrightunsigned(F.col("fp"), 64 - a - w)
                     .bitwiseAND(F.lit((1 << w) - 1)).alias("key"))
            for i, (a, w) in enumerate(masks(max_bits))]
    keyed = nodes.select("fp", F.explode(F.array(*tops)).alias("t")).select("fp", "t.part", "t.key")
    # at most len(masks) * MAX_BLOCK_SHARE nodes can be this large: a fixed bound
    large = (keyed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("rows"))
             .filter(F.col("rows") > block)
             .select("part", "key", F.ceil(F.col("rows") / block).cast("int").alias("blocks")))
    blocks = F.coalesce(F.col("blocks"), F.lit(1))
    units = (keyed.join(F.broadcast(large), ["part", "key"], "left")
             .withColumn("salt", F.pmod(F.xxhash64("fp"), blocks.cast("long")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select("part", "key", F.least("salt", "other").alias("lo"),
                     F.greatest("salt", "other").alias("hi"), "salt", "fp"))
    tasks = tasks_for(spark, (max_bits + 1) * n, ROWS_PER_TASK)
    return (units.repartition(tasks, "part", "key", "lo", "hi")
            .mapInArrow(_link_task(max_bits), "u long, v long"))


# --- components ---------------------------------------------------------------

def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """fp, component_id (smallest min_id reachable) for ``nodes`` (fp, min_id)
    that have a link in ``links`` (u, v)."""
    spark = nodes.sparkSession
    both = links.select("u", "v").union(links.select("v", "u")).distinct()
    ends = links.select(F.col("u").alias("fp")).union(links.select("v")).distinct()
    edges = materialize(both.union(ends.select("fp", "fp")), "simhash-edges")
    label = materialize(nodes.join(ends, "fp", "left_semi")
                        .select("fp", F.coalesce("min_id", F.lit(_NO_ID)).alias("id"),
                                F.col("fp").alias("root"), F.lit(True).alias("moved")), "simhash-label")
    while not label.filter("moved").isEmpty():
        near = (edges.join(label.select(F.col("fp").alias("v"), "id", "root"), "v")
                .groupBy("u").agg(F.min("id").alias("id"), F.min_by("root", "id").alias("root"),
                                  F.max(F.when(F.col("u") == F.col("v"), F.col("id"))).alias("was")))
        jump = label.select(F.col("fp").alias("root"), F.col("id").alias("jump_id"),
                            F.col("root").alias("jump_root"))
        label = materialize(
            near.join(jump, "root").select(
                F.col("u").alias("fp"), F.least("id", "jump_id").alias("id"),
                F.when(F.col("jump_id") < F.col("id"), F.col("jump_root"))
                .otherwise(F.col("root")).alias("root"),
                (F.least("id", "jump_id") < F.col("was")).alias("moved")), "simhash-label")
    return label.select("fp", F.when(F.col("id") != _NO_ID, F.col("id")).alias("component_id"))


def near_duplicate_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                          shingle_words: int = 3, max_bits: int = 3, seed: int = SEED,
                          node_rows: int = NODE_ROWS, key_col: str | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id per row of ``docs``;
    with ``key_col``, a stored long that is unique per row, also that as
    row_key and whether the row is the first of its component (kept)."""
    fps = materialize(fingerprints(docs, text_col, id_col, shingle_words, seed, key_col), "simhash-fp")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"),
                     F.col("row_key").alias("key"))
    nodes = materialize(fps.groupBy("fp").agg(F.min("row_key").alias("min_id"), F.min(first).alias("first")),
                        "simhash-nodes")
    links = materialize(linked(nodes, max_bits, node_rows), "simhash-links")
    found = materialize(components(nodes.select("fp", "min_id"), links), "simhash-found")
    # written, so that both inputs of the joins below are fresh scans and AQE can
    # split a component or a fingerprint that many rows share
    firsts = materialize(nodes.join(found, "fp").groupBy("component_id").agg(F.min("first").alias("component_first")),
                         "simhash-firsts")
    ids = materialize(nodes.join(found.join(firsts, "component_id"), "fp", "left")
                      .select("fp", F.coalesce("component_first", "first").alias("keep")), "simhash-ids")
    return fps.join(ids, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("keep.id").alias("component_id"),
        *(["row_key", (F.col("row_key") == F.col("keep.key")).alias("kept")] if key_col else []))
