"""BPE encoding and decoding through a table of distinct words.

A *word* is a run without ASCII white space (see ``words.py``).

1. ``split``: a task gathers its documents into chunks of bounded size.  A
   document becomes the sequence of its words' numbers in the chunk (variable
   byte lengths; the most frequent words first, the others in alphabetical
   order).  The task appends the sequences, packed and compressed, to a side
   file in the shared folder; they are read once and never shuffled.  A chunk's
   distinct words are dealt by hash to buckets, one packed row per (chunk,
   bucket).  These rows and one per chunk, with its place in the side file, are
   a written table.
2. ``word_ids``: a bucket holds all occurrences of its words.  Its task builds
   the distinct-word table, encodes each word once with the tokenizer library
   and sends every chunk the ids of its words, in the order they came.
3. ``encode``: the task that receives a chunk's word ids reads the chunk's
   sequences back, and each position takes the ids of its word.
4. ``decode``: ids join the id-to-piece table (fixed by the vocabulary file:
   49,408 rows for ``word_bpe_49k.json``, broadcast) by position in Arrow, and
   a row's pieces are joined as the vocabulary's decoder does (no decoder: one
   space between pieces).

The number of buckets grows with the text, so a bucket stays of bounded size; a
word that occurs in every document reaches its bucket once per chunk.

Edge cases: null or empty text has no ids and decodes to the empty string; a
null doc_id is kept; repeated rows are each returned; a text longer than a chunk
is a chunk of its own, so memory follows the longest text; an id outside the
vocabulary decodes to nothing, as in the library; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.common import batches, materialize, open_shared, tasks_for, utf8_rows
from tarmac.llm.words import default_vocab, encoder, load_tokenizer
from tarmac.session import scratch_path

CHUNK_BYTES = 16 << 20
CHUNK_ROWS = 100_000
BUCKET_BYTES = 8 << 20      # text behind one bucket of distinct words
DECODE_ROWS = 64            # rows decoded at a time
FREQUENT = 1 << 14          # words of a chunk that are numbered by frequency

_SPLIT = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary()),
                    ("ids", pa.list_(pa.int64())), ("file", pa.string()), ("start", pa.int64()),
                    ("size", pa.int64())])
_SPLIT_DDL = "chunk long, bucket int, data binary, ids array<long>, file string, start long, size long"


def pack_parts(*parts: bytes) -> bytes:
    """Byte strings as one compressed byte string."""
    import zstandard

    head = np.array([len(parts), *map(len, parts)], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def unpack_parts(blob: bytes) -> list[bytes]:
    """The byte strings of ``pack_parts``."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    sizes = np.frombuffer(raw, "<u4", n, 4)
    cuts = 4 + 4 * n + np.cumsum([0, *sizes])
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def planes(ids: np.ndarray) -> bytes:
    """32-bit integers byte plane by byte plane, which compresses better."""
    return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack_numbers(n: np.ndarray) -> bytes:
    """Non-negative integers below 2^28, 7 bits a byte, low bits first; the
    high bit of a byte says that another follows."""
    n = n.astype(np.uint32)
    width = 1 + (n >= 1 << 7).astype(np.int64) + (n >= 1 << 14) + (n >= 1 << 21)
    out = np.empty(int(width.sum()), np.uint8)
    at = np.cumsum(width) - width
    for k in range(4):
        rows = np.flatnonzero(width > k)
        if not len(rows):
            break
        out[at[rows] + k] = (n[rows] >> (7 * k)) & 127 | ((width[rows] > k + 1) << 7)
    return out.tobytes()


def unpack_numbers(blob: bytes) -> np.ndarray:
    """The integers of ``pack_numbers``."""
    b = np.frombuffer(blob, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(b < 128)
    first = np.r_[0, last[:-1] + 1]
    place = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), first)


def split(docs: DataFrame, buckets: int, folder: str, text_col: str, id_col: str) -> DataFrame:
    """Rows (chunk, bucket, packed words) and, without a bucket, (chunk, doc
    ids, place of the packed sequences in a file below ``folder``).  To be
    written once: a file belongs to one task attempt."""

    def close(chunk: int, ids: list, texts: list[np.ndarray], words: list[bytes], file) -> Iterator[tuple]:
        counts = np.bincount(np.concatenate(texts), minlength=len(words))
        order = np.argsort(-counts, kind="stable")        # new number -> old
        order[FREQUENT:] = sorted(order[FREQUENT:].tolist(), key=words.__getitem__)
        number = np.empty(len(words), np.int32)
        number[order] = np.arange(len(words))
        packed = pack_parts(*(pack_numbers(number[t]) for t in texts))
        start = file.tell()
        file.write(packed)
        yield chunk, None, None, ids, file.name, start, len(packed)
        of = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int32, len(words))[order]
        by_bucket = np.argsort(of, kind="stable")
        for mine in np.split(by_bucket, np.flatnonzero(np.diff(of[by_bucket])) + 1):
            if len(mine):
                yield chunk, int(of[mine[0]]), pack_parts(
                    pack_numbers(np.diff(mine, prepend=-1)), b"\n".join([words[i] for i in order[mine]])
                ), None, None, None, None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        file = _SideFile(folder, f"words-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.bin")

        def rows_out() -> Iterator[tuple]:
            chunk = ctx.partitionId() << 24
            ids, texts, seen, size = [], [], {}, 0
            for batch in it:
                for doc_id, text in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1))):
                    words = (text or b"").split()
                    ids.append(doc_id)
                    texts.append(np.array([seen.setdefault(w, len(seen)) for w in words], np.int32))
                    size += len(text or b"")
                    if size >= CHUNK_BYTES or len(ids) >= CHUNK_ROWS:
                        yield from close(chunk, ids, texts, list(seen), file)
                        ids, texts, seen, size, chunk = [], [], {}, 0, chunk + 1
            if ids:
                yield from close(chunk, ids, texts, list(seen), file)

        yield from batches(rows_out(), _SPLIT, 256)
        file.close()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")
                       ).mapInArrow(run, _SPLIT_DDL)


class _SideFile:
    """A file of the shared folder, opened with its first byte."""

    def __init__(self, folder: str, name: str):
        self.folder, self.name, self.out = folder, name, None

    def tell(self) -> int:
        return self.out.tell() if self.out else 0

    def write(self, data: bytes) -> None:
        if self.out is None:
            fs, root = open_shared(self.folder)
            fs.create_dir(root, recursive=True)
            self.out = fs.open_output_stream(f"{root}/{self.name}", compression=None)
        self.out.write(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def read_side(folder: str, name: str, start: int, size: int) -> bytes:
    fs, root = open_shared(folder)
    with fs.open_input_file(f"{root}/{name}") as f:
        f.seek(start)
        return f.read(size)


def word_ids(table: DataFrame, vocab: str) -> DataFrame:
    """chunk, data (packed numbers, sizes, ids) per (chunk, bucket): the ids of
    the chunk's words, each distinct word of a bucket encoded once."""
    out = pa.schema([("chunk", pa.int64()), ("data", pa.binary())])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        rows = [unpack_parts(d) for d in t.column("data").to_pylist()]
        words = [body.split(b"\n") for _, body in rows]
        distinct = list(set().union(*words))
        ids = dict(zip(distinct, encoder(vocab)(distinct)))
        data = []
        for (gaps, _), part in zip(rows, words):
            mine = [ids[w] for w in part]
            sizes = np.fromiter((len(x) // 4 for x in mine), np.int64, len(mine))
            data.append(pack_parts(gaps, pack_numbers(sizes), planes(np.frombuffer(b"".join(mine), "<u4"))))
        return pa.table([t.column("chunk"), pa.array(data, pa.binary())], schema=out)

    return (table.filter("bucket IS NOT NULL").select("chunk", "bucket", "data").groupBy("bucket")
            .applyInArrow(run, "chunk long, data binary"))


def encode(docs: DataFrame, vocab: str | None = None, text_col: str = "text",
           id_col: str = "doc_id", decoded: bool = False) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) per row of ``docs``;
    with ``decoded`` also ``text``, the ids decoded as by ``decode`` but in the
    same Python worker."""
    spark = docs.sparkSession
    vocab = vocab or default_vocab()
    pieces = _shared_pieces(spark, vocab) if decoded else None
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = tasks_for(spark, size, BUCKET_BYTES)
    folder = scratch_path(spark, "bpe-words")
    table = materialize(split(docs, buckets, folder, text_col, id_col), "bpe-split")
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
    full = out.append(pa.field("text", pa.string())) if decoded else out

    def join_back(chunk: dict, words: pa.Table) -> Iterator[tuple]:
        parts = []
        for gaps, sizes, ids in map(unpack_parts, words.column("data").to_pylist()):
            parts.append((np.cumsum(unpack_numbers(gaps)) - 1, unpack_numbers(sizes), from_planes(ids)))
        n = sum(len(p[0]) for p in parts)
        size, start = np.zeros(n, np.int32), np.zeros(n, np.int32)
        base = 0
        for number, sizes, ids in parts:
            size[number] = sizes
            start[number] = base + np.cumsum(sizes) - sizes
            base += len(ids)
        flat = np.concatenate([p[2] for p in parts] or [np.zeros(0, "<u4")])
        texts = unpack_parts(read_side(folder, chunk["file"], chunk["start"], chunk["size"]))
        for doc_id, data in zip(chunk["ids"], texts):
            at = unpack_numbers(data)
            reps = size[at]
            pos = np.arange(int(reps.sum())) + np.repeat(start[at] - (np.cumsum(reps) - reps), reps)
            yield doc_id, flat[pos].tobytes()

    def one(_: tuple, chunks: pa.Table, words: pa.Table) -> pa.Table:
        rows = (row for chunk in chunks.to_pylist() for row in join_back(chunk, words))
        done = batches(rows, out, DECODE_ROWS)
        if decoded:
            table = pa.array(pieces.value, pa.string())
            done = (pa.RecordBatch.from_arrays([*b.columns, texts_of(b.column(1), table)], schema=full)
                    for b in done)
        return pa.Table.from_batches(list(done), schema=full)

    left = table.filter("bucket IS NULL").select("chunk", "ids", "file", "start", "size").groupBy("chunk")
    return left.cogroup(word_ids(table, vocab).groupBy("chunk")).applyInArrow(
        one, "doc_id long, ids binary" + ", text string" * decoded)


def piece_table(vocab: str) -> list[str | None]:
    """Piece of each id of a vocabulary file (None for unused ids)."""
    tok = load_tokenizer(vocab)
    return [tok.id_to_token(i) for i in range(tok.get_vocab_size(with_added_tokens=True))]


def _shared_pieces(spark: SparkSession, vocab: str):
    """The piece table for all tasks; its size is fixed by the vocabulary."""
    if load_tokenizer(vocab).decoder is not None:
        raise ValueError("only vocabularies without a decoder are supported")
    return spark.sparkContext.broadcast(piece_table(vocab))


def texts_of(ids: pa.Array, table: pa.Array) -> pa.Array:
    """Rows of packed ids joined with the piece table by id: a row's pieces,
    one space between them."""
    blobs = ids.to_pylist()
    sizes = np.array([0] + [len(b or b"") // 4 for b in blobs])
    flat = np.frombuffer(b"".join(b or b"" for b in blobs), "<u4").astype(np.int64)
    parts = table.take(pa.array(flat, mask=flat >= len(table)))
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), parts)
    if parts.null_count:                # ids without a piece
        lists = pa.array([[p for p in row if p is not None] for row in lists.to_pylist()], pa.list_(pa.string()))
    return pc.binary_join(lists, " ")


def decode(encoded: DataFrame, vocab: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``text``: the decoded ids (packed unsigned
    32-bit integers; null counts as none)."""
    pieces = _shared_pieces(encoded.sparkSession, vocab or default_vocab())
    names = [c for c in encoded.columns if c != "text"]
    schema = encoded.select(*names).schema.add("text", "string")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(pieces.value, pa.string())
        for b in it:
            for at in range(0, b.num_rows, DECODE_ROWS):
                part = b.slice(at, DECODE_ROWS)
                texts = texts_of(part.column(names.index(ids_col)), table)
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*names, "text"])

    return encoded.select(*names).mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of (doc_id, ids, text)."""
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
