"""Ranked lexical search by NRA (no random access) over impact-sorted lists.

A document's score for an item is the sum of its impacts for the item's terms;
an impact is ``w * ((10^9 tf) div (1000 tf + 8 m))`` (see ``impacts``).

1. Items are taken in blocks whose texts stay below ``ITEM_BYTES`` (``_blocks``);
   a block's terms are the vocabulary of one pass over all documents.
2. ``postings``: a task splits its documents' whole texts into terms and writes
   shards of at most ``SHARD_ROWS`` documents: per term of the vocabulary the
   documents that hold it and how often.  Counts over all shards (documents,
   terms, documents per term) give the weights.
3. ``impact_lists``: a shard's postings become one list per term, largest
   impact first.
4. ``nra``: an item's lists are read side by side from the front, a stretch of
   each at a time.  A document has a lower bound (the impacts read so far) and
   an upper bound (plus the next impact of every list that has not shown it).
   Once no unseen document can reach the kth lower bound, reading goes on for
   the documents whose upper bound still reaches it, until their bounds meet:
   then membership, order, ties and scores are final.
5. A shard's best k per item meet in a grouped step that keeps the k best.

Shards hold disjoint documents, so the best k of all shards hold the best k of
all documents, whatever term is in every document: its postings are spread over
all shards.

Edge cases: null text has no terms, empty texts and texts without terms score
nothing and do not count; a null doc_id ranks after all others of equal score;
repeated rows are documents each; repeated items are answered each; an item
without terms has no rows; memory follows a shard, the longest text and the
longest item; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.bpe import pack_parts, unpack_parts
from tarmac.llm.common import batches, materialize

ITEM_BYTES = 16 << 20       # text of the items that are answered in one pass
SHARD_ROWS = 20_000
SHARD_POSTINGS = 4 << 20
BLOCK_BYTES = 16 << 20      # text split into terms at a time
FIRST_READ = 64             # postings of a list in the first stretch

# maximal runs of ASCII letters, digits and anything beyond ASCII, A-Z lower-cased
_TO_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
                  for b in range(256))

_SHARD = pa.schema([("rows", pa.int64()), ("total", pa.int64()), ("terms", pa.list_(pa.int32())),
                    ("df", pa.list_(pa.int64())), ("data", pa.binary())])
_SHARD_DDL = "rows long, total long, terms array<int>, df array<long>, data binary"


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, with repeats."""
    return (text or b"").translate(_TO_TERMS).split()


def _counts(texts: list[bytes], vocab: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms per text, and (text, term of the vocabulary, occurrences) rows."""
    lists = pc.ascii_split_whitespace(pa.array([t.translate(_TO_TERMS) for t in texts], pa.binary()).cast(pa.string()))
    flat, ends = lists.flatten(), lists.offsets.to_numpy()
    filled = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy() > 0)])
    n = filled[ends[1:] - ends[0]] - filled[ends[:-1] - ends[0]]
    term = pc.fill_null(pc.index_in(flat, value_set=vocab), -1).to_numpy()
    of = np.repeat(np.arange(len(texts)), np.diff(ends))
    found = term >= 0
    key, tf = np.unique(of[found] * np.int64(max(1, len(vocab))) + term[found], return_counts=True)
    text, term = np.divmod(key, max(1, len(vocab)))
    return n, text, term, tf


def postings(docs: DataFrame, vocab, text_col: str, id_col: str) -> DataFrame:
    """Shards: rows and total (documents with terms, their terms), terms, df
    (of the vocabulary, in this shard), data (packed arrays)."""

    def close(held: list[tuple]) -> tuple:
        ids = [i for part in held for i in part[0]]
        n = np.concatenate([part[1] for part in held])
        base = np.cumsum([0] + [len(part[1]) for part in held])
        doc = np.concatenate([part[2] + b for part, b in zip(held, base)])
        term = np.concatenate([part[3] for part in held])
        tf = np.concatenate([part[4] for part in held])
        order = np.argsort(term, kind="stable")
        names, df = np.unique(term, return_counts=True)
        data = pack_parts(np.array([i is None for i in ids], bool).tobytes(),
                          np.array([i or 0 for i in ids], np.int64).tobytes(), n.astype(np.int64).tobytes(),
                          doc[order].astype(np.int32).tobytes(), tf[order].astype(np.int64).tobytes())
        return int((n > 0).sum()), int(n.sum()), names.tolist(), df.tolist(), data

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(vocab.value, pa.binary()).cast(pa.string())

        def shards() -> Iterator[tuple]:
            held, rows, found = [], 0, 0
            for batch in it:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
                for at, end in _stretches(texts):
                    part = _counts([t or b"" for t in texts[at:end]], words)
                    held.append((ids[at:end], *part))
                    rows, found = rows + end - at, found + len(part[1])
                    if rows >= SHARD_ROWS or found >= SHARD_POSTINGS:
                        yield close(held)
                        held, rows, found = [], 0, 0
            if held:
                yield close(held)

        yield from batches(shards(), _SHARD, 1)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _SHARD_DDL)


def _stretches(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Cuts of a batch into stretches of about BLOCK_BYTES and at most SHARD_ROWS texts."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= BLOCK_BYTES or i + 1 - at >= SHARD_ROWS:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def lengths(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """m of documents with ``n`` terms each."""
    if 90 * int(n.max(initial=0)) * n_docs < 1 << 63:
        return 10 + 90 * n * n_docs // max(1, total)
    return np.array([10 + 90 * x * n_docs // total for x in n.tolist()], np.int64)


def impacts(w: int, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return w * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def impact_lists(doc: np.ndarray, tf: np.ndarray, m: np.ndarray, terms: list[int], df: list[int],
                 weights: dict[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """term -> (documents, impacts), largest impact first."""
    out, at = {}, 0
    for term, n in zip(terms, df):
        mine, count = doc[at:at + n], tf[at:at + n]
        at += n
        impact = impacts(weights[term], count, m[mine])
        order = np.argsort(-impact, kind="stable")
        order = order[:np.count_nonzero(impact)]
        if len(order):
            out[term] = mine[order], impact[order]
    return out


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that may be among the k best, and their scores: all of the k
    best, and any that tie with the kth."""
    low = np.zeros(n_docs, np.int64)
    alive = np.zeros(0, np.int64)               # documents still in question
    open_ = np.ones(n_docs, bool)               # False: cannot be among the k best
    closed = False                              # no document beyond ``alive`` can be
    read = [0] * len(lists)
    step = FIRST_READ
    while True:
        ahead, rest = [], 0
        for t, (doc, impact) in enumerate(lists):
            upto = min(read[t] + step, len(doc))
            mine = doc[read[t]:upto]
            if closed:
                wanted = open_[mine]
                low[mine[wanted]] += impact[read[t]:upto][wanted]
            else:
                low[mine] += impact[read[t]:upto]
            read[t] = upto
            ahead.append(int(impact[upto]) if upto < len(doc) else 0)
            rest += ahead[-1]
        step *= 2
        if not closed:
            alive = np.flatnonzero(low)
        bounds = low[alive]
        kth = int(np.partition(bounds, -k)[-k]) if len(bounds) >= k else 0
        if rest == 0:
            return (keep := alive[bounds >= max(kth, 1)]), low[keep]
        if not closed and rest >= kth:
            continue                            # a document not yet seen may still enter
        # what the lists that have shown a document could no longer add
        shown = np.zeros(n_docs, np.int64)
        for (doc, _), upto, nxt in zip(lists, read, ahead):
            if nxt:
                shown[doc[:upto]] += nxt
        upper = bounds + rest - shown[alive]
        stay = upper >= kth
        alive, exact = alive[stay], bool((upper[stay] == bounds[stay]).all())
        closed = True
        open_[:] = False
        open_[alive] = True
        if exact:
            return alive, low[alive]


def _blocks(items: DataFrame) -> Iterator[list]:
    """The items in blocks of bounded text: hashed into so many blocks that none
    is over ITEM_BYTES, unless one item alone is."""
    sized = items.select("item_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    n = 1
    while True:
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
        per = sized.groupBy(block.alias("b")).agg(F.sum("size").alias("size"), F.countDistinct("text").alias("n"))
        over = per.filter((F.col("size") > ITEM_BYTES) & (F.col("n") > 1)).agg(F.max("size")).first()[0]
        if not over:
            break
        n *= max(2, -(-over // ITEM_BYTES))
    for b in range(n):
        rows = sized.filter(block == b).select("item_id", "text").distinct() if n > 1 else sized.select("item_id", "text")
        yield rows.collect()


def search(docs: DataFrame, items: DataFrame, k: int = 10, text_col: str = "text", id_col: str = "doc_id",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item."""
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    out = None
    for block in _blocks(items):
        part = _search_block(docs, [(r["item_id"], r["text"]) for r in block], k, text_col, id_col)
        out = part if out is None else out.unionByName(part)
    return out


def _search_block(docs: DataFrame, items: list[tuple[int | None, str | None]], k: int, text_col: str,
                  id_col: str) -> DataFrame:
    spark = docs.sparkSession
    of_item = [sorted(set(terms_of(None if t is None else t.encode()))) for _, t in items]
    vocab = sorted(set().union(*of_item))                   # below ITEM_BYTES, as the block is
    number = {t: i for i, t in enumerate(vocab)}
    shards = materialize(postings(docs, spark.sparkContext.broadcast(vocab), text_col, id_col), "nra-shards")
    n_docs, total = shards.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    pairs = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("p"))
    df = pairs.groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.df").alias("df")).collect()   # a row per term
    weights = {r["term"]: weight(n_docs, r["df"]) for r in df}
    queries = [[number[t] for t in terms] for terms in of_item]
    shared = spark.sparkContext.broadcast((queries, weights))
    found = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shared.value
        for batch in it:
            for shard in batch.to_pylist():
                null, ids, n, doc, tf = unpack_parts(shard["data"])
                null, ids, n, doc, tf = (np.frombuffer(x, t) for x, t in zip(
                    (null, ids, n, doc, tf), (bool, np.int64, np.int64, np.int32, np.int64)))
                lists = impact_lists(doc, tf, lengths(n, n_docs, total), shard["terms"], shard["df"], weights)
                for i, terms in enumerate(queries):
                    mine = [lists[t] for t in terms if t in lists]
                    if not mine:
                        continue
                    rows, score = nra(mine, len(n), k)
                    best = np.lexsort((ids[rows], null[rows], -score))[:k]
                    rows, score = rows[best], score[best]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), i, np.int32)), pa.array(ids[rows], mask=null[rows]),
                         pa.array(score)], schema=found)

    per_shard = shards.select("terms", "df", "data").mapInArrow(run, "item int, doc_id long, score long")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ids = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], "item int, item_id long")
    return (per_shard.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
