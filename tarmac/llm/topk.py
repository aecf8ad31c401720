"""Exact top-k inner-product search with two cover trees.

Vectors become integers, floor(scale * x).  Queries and candidates are indexed
together, at two levels:

* Cells (``cells``): a bounded sample of the candidates, picked by hash, serves
  as pivots; every row belongs to its nearest pivot.  A cell has a covering
  radius and a largest norm.  The sample also gives each query a first worst
  kth score, as its members are candidates themselves.
* Blocks: a cell's rows are dealt over blocks of bounded size (a vector that
  many rows share spreads over many blocks).  A pair of (query block, data
  block) is one work unit, unless the bound of their two cells
  ``<cq, cd> + rq |cd| + rd |cq| + rq rd`` stays below the query cell's worst kth
  score.  Rows travel only to the units of the pairs that are left.
* Trees (``CoverTree``, ``dual_search``): a task builds a cover tree over the
  queries and one over the candidates of its unit, and descends both together,
  best bound first.  A pair of nodes is pruned when the same bound over their
  covering radii is below the worst kth score of the query node's queries.

Each unit returns at most k rows per query; a grouped step keeps the k best.
Every bound has slack for float rounding, pruning is strict, so ties stay
exact.

Edge cases: vectors that are null, or hold a null or non-finite component, and
rows without an id take no part; vectors of different length are not compared;
a candidate with the query's own id is left out; repeated rows are candidates
each, equal query rows (same id and vector) are answered once; components
beyond +-2^31 after scaling are cut to that range and scores to the range of a
long; a query without candidates has no rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import hash_sampled, materialize, tasks_for

SCALE = 1024
PIVOTS = 256                # sampled pivots, a fixed bound
BLOCK_ROWS = 2048           # candidates of a unit
QUERY_ROWS = 1024           # queries of a unit
BASE = 1.3                  # ratio of the radii of a level and the next
LEAF_ROWS = 48
QUERY_LEAF_ROWS = 16
SMALL_ROWS = 16
_LIMIT = 1 << 31
_EXACT = 1 << 53


def integer_vectors(df: DataFrame, is_query: Column, id_col: str, vector_col: str,
                    scale: int) -> DataFrame:
    """vec_id, v (array<long>), query of the rows that take part."""
    x = F.col(vector_col)
    ok = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double"))
                  & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    to_int = lambda e: F.least(F.greatest(F.floor(F.lit(float(scale)) * e.cast("double")),
                                          F.lit(-_LIMIT)), F.lit(_LIMIT)).cast("long")
    return (df.filter(F.col(id_col).isNotNull() & x.isNotNull() & ok)
            .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, to_int).alias("v"),
                    F.coalesce(is_query, F.lit(False)).alias("query")))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``a`` and ``b``."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < _EXACT:                       # every partial sum is exact in a double
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if top < 2.0 ** 63:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class CoverTree:
    """A node's children cover its points within 1 / BASE of its radius, with
    centres further apart than that.  ``leaf_rows`` points or fewer (or equal
    points) stay together; children of fewer than ``small_rows`` points share
    one leaf around the node's own centre."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS, small_rows: int = SMALL_ROWS):
        self.leaf_rows, self.small_rows = leaf_rows, small_rows
        self.x = points.astype(np.float64)
        self.rows: list[np.ndarray] = []       # points below a node
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        if len(points):
            rows = np.arange(len(points))
            stack = [self._node(0, rows, self._distance(0, rows))]
            while stack:
                stack += self._split(stack.pop())

    def _distance(self, centre: int, rows: np.ndarray) -> np.ndarray:
        d = self.x[rows] - self.x[centre]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _node(self, centre: int, rows: np.ndarray, dist: np.ndarray) -> int:
        self.rows.append(rows)
        self.centre.append(centre)
        self.radius.append(float(dist.max(initial=0.0)))
        self.children.append([])
        return len(self.rows) - 1

    def _split(self, node: int) -> list[int]:
        rows, scale = self.rows[node], self.radius[node] / BASE
        if len(rows) <= self.leaf_rows or scale == 0:
            return []
        centre, left, small, open_ = self.centre[node], rows, [], []
        while len(left):
            dist = self._distance(centre, left)
            near = dist <= scale
            if near.sum() < self.small_rows:
                small.append(left[near])
            else:
                open_.append(self._node(centre, left[near], dist[near]))
            left = left[~near]
            if len(left):
                centre = int(left[0])
        self.children[node] = list(open_)
        if small:
            rest = np.concatenate(small)
            self.children[node].append(
                self._node(self.centre[node], rest, self._distance(self.centre[node], rest)))
        return open_


def dual_search(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray,
                floor: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query row, id, score) of each query's k best points (best first), less
    those below its ``floor``, a kth score it is known to reach."""
    # a group of queries prunes by the worst of its kth scores, so few share a leaf
    qt, dt = CoverTree(queries, QUERY_LEAF_ROWS, 1), CoverTree(points)
    if not qt.rows or not dt.rows:
        return
    worst = floor.astype(np.float64)
    best_score = [np.zeros(0, np.int64) for _ in queries]
    best_id = [np.zeros(0, np.int64) for _ in queries]
    q_norm, d_norm = (np.sqrt((t.x[t.centre] ** 2).sum(1)) for t in (qt, dt))
    q_radius, d_radius = np.array(qt.radius), np.array(dt.radius)
    q_centre, d_centre = qt.x[qt.centre], dt.x[dt.centre]

    def bounds(a: int, nodes: list[int]) -> np.ndarray:
        b = np.array(nodes)
        top = (d_centre[b] @ q_centre[a] + q_radius[a] * d_norm[b] + d_radius[b] * q_norm[a]
               + q_radius[a] * d_radius[b])
        return top + 1e-9 * np.abs(top) + 1e-6

    def base(a: int, b: int) -> None:
        q, d = qt.rows[a], dt.rows[b]
        s = scores(queries[q], points[d])
        for i, row in enumerate(q):
            ok = (s[i] >= worst[row]) & (ids[d] != query_ids[row])
            if not ok.any():
                continue
            all_s = np.concatenate([best_score[row], s[i][ok]])
            all_i = np.concatenate([best_id[row], ids[d][ok]])
            order = np.lexsort((all_i, -all_s))[:k]
            best_score[row], best_id[row] = all_s[order], all_i[order]
            if len(order) == k:
                worst[row] = max(worst[row], float(all_s[order[-1]]))

    tie = 0
    heap = [(-float(bounds(0, [0])[0]), tie, 0, 0)]
    while heap:
        bound, _, a, b = heapq.heappop(heap)
        if -bound < worst[qt.rows[a]].min():
            continue
        qs, ds = qt.children[a], dt.children[b]
        if not qs and not ds:
            base(a, b)
            continue
        # open the node that covers more
        if qs and (not ds or q_radius[a] >= d_radius[b]):
            pairs = [(c, b, float(bounds(c, [b])[0])) for c in qs]
        else:
            pairs = [(a, c, v) for c, v in zip(ds, bounds(a, ds).tolist())]
        for c, d, top in pairs:
            if top >= worst[qt.rows[c]].min():
                tie += 1
                heapq.heappush(heap, (-top, tie, c, d))
    for row in range(len(queries)):
        yield from ((row, int(i), int(s)) for i, s in zip(best_id[row], best_score[row]))


# --- Spark --------------------------------------------------------------------

class _Pivots:
    """Sampled rows of one vector length: the first ``n_data`` are the pivots of
    data cells, the first ``n_query`` those of query cells (numbered from
    ``base``).  Without a sampled row the origin is the only pivot."""

    def __init__(self, sample: list, dim: int, rows: int, queries: int, base: int,
                 block_rows: int, query_rows: int):
        self.x = np.array([r["v"] for r in sample], np.int64).reshape(len(sample), dim)
        self.ids = np.array([r["vec_id"] for r in sample], np.int64)
        self.centres = self.x if len(sample) else np.zeros((1, dim), np.int64)
        self.n_data = min(len(self.centres), -(-rows // block_rows))
        self.n_query = min(len(self.centres), max(1, -(-queries // query_rows)))
        self.base = base

    def nearest(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        x, p = x.astype(np.float64), self.centres[:n].astype(np.float64)
        d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * (x @ p.T)))
        at = d.argmin(1)
        exact = x - p[at]
        return self.base + at, np.sqrt((exact * exact).sum(1))

    def floors(self, x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """kth best score of each query among the sample, which the whole
        table can only raise."""
        lowest = -(1 << 63)
        own = ids[:, None] == self.ids
        if len(self.x) <= k:
            return np.full(len(x), lowest)
        s = np.sort(np.where(own, lowest, scores(x, self.x)), 1)[:, -k]
        return np.where(own.sum(1) <= len(self.x) - k, s, lowest)


_CELLED = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("query", pa.bool_()),
                     ("cell", pa.int64()), ("radius", pa.float64()), ("q_cell", pa.int64()),
                     ("q_radius", pa.float64()), ("floor", pa.int64())])
_CELLED_DDL = ("vec_id long, v array<long>, query boolean, cell long, radius double, q_cell long, "
               "q_radius double, floor long")


def _cells(pivots, k: int):
    """Cells of every row as a candidate and, of queries, as a query."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n = batch.num_rows
            ids, query = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            dims = pa.compute.list_value_length(batch.column(1)).to_numpy()
            cell, q_cell, floor = (np.zeros(n, np.int64) for _ in range(3))
            radius, q_radius = np.zeros(n), np.zeros(n)
            for dim in np.unique(dims):
                p, rows = pivots.value[int(dim)], np.flatnonzero(dims == dim)
                x = matrix(batch.column(1).take(pa.array(rows)), dim)
                cell[rows], radius[rows] = p.nearest(x, p.n_data)
                q_cell[rows], q_radius[rows] = p.nearest(x, p.n_query)
                ask = np.flatnonzero(query[rows])
                floor[rows[ask]] = p.floors(x[ask], ids[rows[ask]], k)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *map(pa.array, (cell, radius, q_cell, q_radius, floor))], schema=_CELLED)

    return run


def top_k(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id",
          vector_col: str = "embedding", scale: int = SCALE, pivots: int = PIVOTS,
          block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row for
    which ``is_query`` holds."""
    spark = df.sparkSession
    rows = integer_vectors(df, is_query, id_col, vector_col, scale)
    counts = (rows.groupBy(F.size("v").alias("dim"))        # one row per vector length
              .agg(F.count(F.lit(1)).alias("n"), F.count_if("query").alias("queries")).collect())
    sample = hash_sampled(rows.select("vec_id", "v"), F.xxhash64("vec_id", "v"), sum(r["n"] for r in counts), pivots)
    by_dim: dict[int, _Pivots] = {}
    base = 0
    for r in counts:
        mine = [s for s in sample if len(s["v"]) == r["dim"]]
        by_dim[r["dim"]] = p = _Pivots(mine, r["dim"], r["n"], r["queries"], base, block_rows, query_rows)
        base += len(p.centres)
    celled = materialize(rows.mapInArrow(_cells(spark.sparkContext.broadcast(by_dim), k), _CELLED_DDL),
                         "topk-cells")
    # tables of cells: at most ``pivots`` rows, and one more per vector length
    n = F.count(F.lit(1)).alias("n")
    data_cells = {r["cell"]: r for r in
                  celled.groupBy("cell").agg(n, F.max("radius").alias("radius")).collect()}
    query_cells = {r["q_cell"]: r for r in celled.filter("query").groupBy("q_cell").agg(
        n, F.max("q_radius").alias("radius"), F.min("floor").alias("floor")).collect()}
    blocks = {c: -(-r["n"] // block_rows) for c, r in data_cells.items()}
    q_blocks = {c: -(-r["n"] // query_rows) for c, r in query_cells.items()}
    pairs = [(a, b, q_blocks[a], blocks[b]) for a, b in _cell_pairs(by_dim, query_cells, data_cells)]
    # at most ``pivots`` squared rows
    pair_table = F.broadcast(spark.createDataFrame(
        pairs, "q_cell long, cell long, q_blocks long, blocks long"))

    key = F.xxhash64("vec_id", "v")
    numbers = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = (celled.filter("query").groupBy("vec_id", "v", "q_cell").agg(F.min("floor").alias("floor"))
            .join(pair_table, "q_cell")
            .select("q_cell", F.pmod(key, "q_blocks").alias("q_block"), "cell", numbers("blocks").alias("block"),
                    "vec_id", "v", "floor", key.alias("query_key")))
    right = (celled.select("cell", "vec_id", "v").join(pair_table, "cell")
             .select(F.col("q_cell").alias("q_cell_"), numbers("q_blocks").alias("q_block_"),
                     F.col("cell").alias("cell_"), F.pmod(key, "blocks").alias("block_"),
                     F.col("vec_id").alias("d_id"), F.col("v").alias("d_v")))
    out = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()),
                     ("score", pa.int64())])

    def search(_: tuple, q: pa.Table, d: pa.Table) -> pa.Table:
        if not q.num_rows or not d.num_rows:
            return out.empty_table()
        dim = len(q.column("v")[0])
        q_ids, keys, floor = (q.column(c).to_numpy() for c in ("vec_id", "query_key", "floor"))
        hits = np.array(list(dual_search(
            matrix(q.column("v"), dim), q_ids, matrix(d.column("d_v"), dim), d.column("d_id").to_numpy(),
            floor, k)), np.int64).reshape(-1, 3)
        return pa.table([q_ids[hits[:, 0]], keys[hits[:, 0]], hits[:, 1], hits[:, 2]], schema=out)

    unit = ["q_cell", "q_block", "cell", "block"]
    tasks = tasks_for(spark, sum(a * b for _, _, a, b in pairs), 64)
    same_unit = [f"{c}_" for c in unit]
    found = (left.repartition(tasks, *unit).groupBy(*unit)
             .cogroup(right.repartition(tasks, *same_unit).groupBy(*same_unit))
             .applyInArrow(search, "query_id long, query_key long, vec_id long, score long"))
    ranked = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _cell_pairs(by_dim: dict, query_cells: dict, data_cells: dict) -> list[tuple[int, int]]:
    """(query cell, data cell) that the bound over both cells leaves."""
    pairs = []
    for p in by_dim.values():
        x = p.centres.astype(np.float64)
        norm, inner = np.sqrt((x * x).sum(1)), x @ x.T
        for a in range(p.n_query):
            q = query_cells.get(p.base + a)
            for b in range(p.n_data if q else 0):
                d = data_cells.get(p.base + b)
                if d is None:
                    continue
                rq, rd = q["radius"] + 1e-6, d["radius"] + 1e-6
                top = inner[a, b] + rq * norm[b] + rd * norm[a] + rq * rd
                if top + 1e-9 * abs(top) + 1e-6 >= q["floor"]:
                    pairs.append((p.base + a, p.base + b))
    return pairs
