"""Phrase collocations from FM-indexes over word ids.

Lower-cased texts are cut into pieces at punctuation and line ends, and pieces
into words; a phrase lies within a piece.  Everything is per language.

1. ``split``: a task turns chunks of texts into sequences of the chunk's own
   word numbers (side files of the shared folder) and counts its words.  The
   counts go, packed, to the owners of the words' hashes, which sum them and
   send back a global id for every word that occurs ``min_count`` times over all
   chunks (``settle_words``).
2. ``build``: a chunk is a shard.  Its frequent words, with a separator between
   stretches of them, are indexed in both directions (``Index``): rows in the
   order of the words that follow and, for the second index, that precede, each
   with its step to the next row.  Rows are sorted by as many words as the
   longest phrase has, which is all that interval extension up to that length
   looks at.  What is stored is the sequence of frequent words and, once the
   frequent pairs are known, the index of the words in these.
3. ``extend``: bidirectional interval extension.  A phrase is an interval in
   both indexes.  From the intervals of the phrases of k words that are
   frequent over all shards, the backward steps give every phrase with one word
   more on the left, the steps of the other index every phrase with one more on
   the right, each with its interval in both.  A phrase found by both has two
   frequent parts; it goes, with its count and the ids of these parts, to the
   owner of its hash.  So a shard sends no phrase with a rare part.
4. An owner sums the shards' counts.  Phrases of at least ``min_count`` get an
   id, and every shard that sent one gets the id back, for the next length.
   What a shard sends an owner, and gets back, is one packed row (``messages``,
   ``settle``), as most of its phrases are rare in all shards together.
5. The parts' ids chain every phrase to its prefixes and suffixes, which gives
   the counts at every cut; longer phrases that contain it give the drops.

Every step is a sum or join over shards, words or phrases; no language or hot
word is gathered in one task.  Ids are exact: no hash stands for a phrase.

Edge cases: null or empty text has no words; a null language is ``und``, as is a
language of that name; repeated rows count each; equal scores are ordered by
count, then by the phrase's bytes; memory follows a chunk and the longest text;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.bpe import (_SideFile, from_planes, pack_numbers, pack_parts, planes, read_side, unpack_numbers,
                            unpack_parts)
from tarmac.llm.common import materialize, tasks_for
from tarmac.session import delete_scratch, scratch_path

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
PARTS = 64                  # parts of a language that are ranked first
CHUNK_BYTES = 16 << 20      # text of a shard
CHUNK_ROWS = 200_000
CHUNKS_PER_TASK = 2
OWNER_BYTES = 24 << 20      # text behind one owner of words and phrases
HOT_WORD = 1 << 22          # pairs of a word that occurs so often go to many owners

_SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x2E if b in _SEPARATORS else 0x20 if b == 9 else b
                  for b in range(256))

_SPLIT = pa.schema([("chunk", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("size", pa.int64()),
                    ("owner", pa.int32()), ("lang", pa.string()), ("data", pa.binary())])
_SPLIT_DDL = "chunk long, file string, start long, size long, owner int, lang string, data binary"
_WORDS = pa.schema([("gid", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("f", pa.int64()),
                    ("chunk", pa.int64()), ("data", pa.binary())])
_WORDS_DDL = "gid long, lang string, word string, f long, chunk long, data binary"
_SENT_DDL = "chunk long, file string, size long, nodes string, nodes_size long, owner int, data binary"
_SENT = pa.schema([("chunk", pa.int64()), ("file", pa.string()), ("size", pa.int64()), ("nodes", pa.string()),
                   ("nodes_size", pa.int64()), ("owner", pa.int32()), ("data", pa.binary())])
_OWNED_DDL = "gid long, p long, s long, f long, chunk long, owner int, data binary"
_OWNED = pa.schema([(c, pa.int64()) for c in ("gid", "p", "s", "f", "chunk")] + [("owner", pa.int32()),
                                                                                 ("data", pa.binary())])


# --- the index of a shard --------------------------------------------------------

def _ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank of each position: equal keys share one)."""
    order = np.argsort(key, kind="stable")
    step = np.concatenate([[0], np.diff(key[order]) != 0])
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(step)
    return order, rank


def steps(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Rows of the positions in the order of their next ``depth`` symbols, as the
    step from each row to the row of the position after it.  0 separates; each
    separator counts as a symbol of its own, below all words.  The last symbol
    is a separator."""
    n = len(symbols)
    zero = symbols == 0
    one = np.where(zero, np.cumsum(zero) - 1, symbols + zero.sum() - 1).astype(np.int64)
    width = max(n, int(one.max(initial=0))) + 1         # symbols may be numbered beyond n
    ahead = lambda rank, by: np.concatenate([rank[by:], np.zeros(min(by, n), np.int64)])
    rank, known = one, 1
    while known < depth:
        by = min(known, depth - known)
        # known symbols, then the first of those after them
        other = rank if by == known else one if by == 1 else steps_rank(one, by, width)
        order, rank = _ordered(rank * width + ahead(other, known))
        known += by
    if depth == 1:
        order = np.argsort(one, kind="stable")
    row = np.empty(n, np.int64)
    row[order] = np.arange(n)
    return row[np.minimum(order + 1, n - 1)].astype(np.int32)


def steps_rank(one: np.ndarray, depth: int, width: int) -> np.ndarray:
    """Rank of each position by its next ``depth`` symbols, all below ``width``."""
    rank = one
    for k in range(1, depth):
        rank = _ordered(rank * width + np.concatenate([one[k:], np.zeros(min(k, len(one)), np.int64)]))[1]
    return rank


def trimmed(words: np.ndarray) -> np.ndarray:
    """Words that stand beside another one, with one 0 between their stretches."""
    words = np.concatenate([[0], words, [0]])
    word = words > 0
    beside = word & (np.roll(word, 1) | np.roll(word, -1))          # a word alone is in no phrase
    return words[beside | (~word & np.roll(beside, 1))]


def pack_steps(step: np.ndarray) -> bytes:
    """Steps by their differences (they ascend within a word), the sign in the low bit."""
    d = np.diff(step.astype(np.int64), prepend=0)
    return planes(np.where(d < 0, -2 * d - 1, 2 * d))


def unpack_steps(raw: bytes) -> np.ndarray:
    z = from_planes(raw).astype(np.int64)
    return np.cumsum(np.where(z & 1, -(z + 1) // 2, z // 2)).astype(np.int32)


class Index:
    """Both indexes of a shard: ``forward`` and ``backward`` steps, the first
    row of each word (``starts``; the same in both) and the words' global ids."""

    def __init__(self, forward: np.ndarray, backward: np.ndarray, starts: np.ndarray, ids: np.ndarray):
        self.forward, self.backward, self.starts, self.ids = forward, backward, starts, ids

    @classmethod
    def of(cls, words: np.ndarray, ids: np.ndarray, depth: int) -> "Index":
        """From a shard's words: numbers from 1 into ``ids``, 0 for anything else."""
        kept = np.concatenate([[0], trimmed(words), [0]]).astype(np.int64)
        counts = np.bincount(kept, minlength=len(ids) + 1)
        return cls(steps(kept, depth), steps(kept[::-1], depth), np.cumsum(counts), ids)

    def extend_words(self) -> tuple[np.ndarray, ...]:
        """``extend`` from the words alone; prefix and suffix number them."""
        return self.extend(*self.words())

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first row, first row of the other index, size) of every word."""
        lo = self.starts[:-1]
        return lo, lo, np.diff(self.starts)

    def pack(self) -> bytes:
        return pack_parts(pack_steps(self.forward), pack_steps(self.backward), *(
            long_planes(x) for x in (self.starts, self.ids)))

    @classmethod
    def unpack(cls, blob: bytes) -> "Index":
        forward, backward, *rest = unpack_parts(blob)
        return cls(unpack_steps(forward), unpack_steps(backward), *map(from_long_planes, rest))

    def _one_side(self, step: np.ndarray, first: np.ndarray, other: np.ndarray, size: np.ndarray
                  ) -> tuple[np.ndarray, ...]:
        """Phrases with one word more before the steps' direction: (parent, first
        row, first row in the other index, size)."""
        label = np.full(len(step), -1, np.int32)
        rows = np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)
        label[rows] = np.repeat(np.arange(len(size), dtype=np.int32), size)
        base = int(self.starts[0])                  # separators come first
        parent = label[step[base:]]
        new = np.ones(len(parent), bool)
        new[1:] = parent[1:] != parent[:-1]
        new[self.starts[:-1][np.diff(self.starts) > 0] - base] = True
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(parent)))
        real = parent[heads] >= 0
        heads, sizes = heads[real], sizes[real]
        parent = parent[heads]
        # in the other index a phrase's rows stand in the order of the new word,
        # those next to a separator first
        order = np.argsort(parent, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        whole = np.bincount(parent, weights=sizes, minlength=len(size)).astype(np.int64)
        before -= (np.cumsum(whole) - whole)[parent[order]]
        there = np.empty(len(heads), np.int64)
        there[order] = before
        return parent, heads + base, there + (other + size - whole)[parent], sizes

    def extend(self, lo: np.ndarray, rlo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """From phrases of k words (by ``lo`` ascending) to those of k + 1 whose
        first k and last k words are among them: (lo, rlo, size, prefix, suffix)."""
        suffix, left_lo, left_rlo, left_n = self._one_side(self.forward, lo, rlo, size)
        prefix, right_rlo, right_lo, _ = self._one_side(self.backward, rlo, lo, size)
        _, a, b = np.intersect1d(left_lo, right_lo, assume_unique=True, return_indices=True)
        return left_lo[a], left_rlo[a], left_n[a], prefix[b], suffix[a]


# --- phrases between shards and owners -------------------------------------------

def long_planes(x: np.ndarray) -> bytes:
    """64-bit integers byte plane by byte plane, which compresses better."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_long_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def dealt(p: np.ndarray, s: np.ndarray, owners: int, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases by owner: (order, first place of each owner and the end).  Phrases
    with the same first part go to one owner, next to each other, unless they
    are to go ``alone``: their first part may have any number of phrases."""
    mixed = p.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.where(alone, s, 0).astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    owner = ((mixed >> np.uint64(32)) % np.uint64(owners)).astype(np.int64)
    return np.argsort(owner, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=owners))])


def messages(p: np.ndarray, s: np.ndarray, n: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(owner, packed phrases) of phrases in the order of their owners."""
    for owner in np.flatnonzero(np.diff(at)).tolist():
        mine = slice(at[owner], at[owner + 1])
        yield owner, pack_parts(*pack_pairs(p[mine], s[mine]), pack_numbers(n[mine]))


def pack_pairs(p: np.ndarray, s: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Pairs as runs of equal ``p`` and the steps of ``s`` within a run."""
    heads = np.flatnonzero(np.r_[True, np.diff(p) != 0])
    step = np.diff(s, prepend=0)
    step[heads] = s[heads]
    return long_planes(p[heads]), pack_numbers(np.diff(np.append(heads, len(p)))), long_planes(step)


def unpack_pairs(p: bytes, runs: bytes, steps: bytes) -> tuple[np.ndarray, np.ndarray]:
    runs, steps = unpack_numbers(runs), from_long_planes(steps)
    heads = np.cumsum(runs) - runs
    upto = np.cumsum(steps)
    return np.repeat(from_long_planes(p), runs), upto - np.repeat(upto[heads] - steps[heads], runs)


def settle(sent: DataFrame, min_count: int) -> DataFrame:
    """Frequent phrases (gid, p, s, f) and, per message, which of its phrases
    they are (chunk, owner, data)."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        owner = key[0].as_py()
        parts = [unpack_parts(d) for d in rows.column("data").to_pylist()]
        p, s = (np.concatenate(x) for x in zip(*(unpack_pairs(*x[:3]) for x in parts)))
        n = [unpack_numbers(x[3]) for x in parts]
        sizes, n = [len(x) for x in n], np.concatenate(n)
        order = np.lexsort((s, p))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(p[order]) != 0) | (np.diff(s[order]) != 0)
        heads = np.flatnonzero(new)
        f = np.add.reduceat(n[order], heads)
        enough = f >= min_count
        gid = np.where(enough, (np.int64(owner) << 40) + np.cumsum(enough) - 1, -1)
        of = np.empty(len(order), np.int64)
        of[order] = gid[np.cumsum(new) - 1]
        first = order[heads[enough]]
        k = len(first)
        found = pa.RecordBatch.from_arrays(
            [pa.array(gid[enough]), pa.array(p[first]), pa.array(s[first]), pa.array(f[enough]),
             pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=_OWNED)
        replies = []
        for chunk, mine in zip(rows.column("chunk").to_pylist(), np.split(of, np.cumsum(sizes)[:-1])):
            where = np.flatnonzero(mine >= 0)
            if len(where):
                replies.append({"chunk": chunk, "owner": owner, "data": pack_parts(
                    pack_numbers(np.diff(where, prepend=0)), long_planes(mine[where]))})
        return pa.Table.from_batches([found, pa.RecordBatch.from_pylist(replies, schema=_OWNED)])

    return sent.groupBy("owner").applyInArrow(run, _OWNED_DDL)


def known_gids(replies: pa.Table, at: np.ndarray) -> np.ndarray:
    """Ids of a chunk's phrases in the order of their owners (-1: not frequent)."""
    out = np.full(int(at[-1]), -1, np.int64)
    for owner, data in zip(replies.column("owner").to_pylist(), replies.column("data").to_pylist()):
        gaps, gid = unpack_parts(data)
        out[at[owner] + np.cumsum(unpack_numbers(gaps))] = from_long_planes(gid)
    return out


# --- Spark -----------------------------------------------------------------------

def split(docs: DataFrame, folder: str, owners: int, text_col: str, lang_col: str | None) -> DataFrame:
    """Rows with the place of a chunk's sequence of word numbers and rows (chunk,
    owner, lang, data: words in the order of their numbers, the first number and
    the counts).  To be written once."""

    def close(chunk: int, by_lang: dict[str, list[bytes]], file) -> Iterator[pa.RecordBatch]:
        parts, rows, base = [], [], 1
        for lang, texts in by_lang.items():
            flat = pc.ascii_split_whitespace(
                pa.array([b" . ".join(texts)], pa.binary()).cast(pa.string())).flatten().dictionary_encode()
            number, names = flat.indices.to_numpy(), flat.dictionary.cast(pa.binary()).to_pylist()
            counts = np.bincount(number, minlength=len(names))
            seed = zlib.crc32(lang.encode())
            owner = np.fromiter((zlib.crc32(w, seed) % owners if w and w != b"." else -1 for w in names),
                                np.int64, len(names))
            # an owner's words in alphabetical order, which compresses better
            order = pc.sort_indices(pa.table({"owner": owner, "word": flat.dictionary}), sort_keys=[
                ("owner", "ascending"), ("word", "ascending")]).to_numpy().astype(np.int64)
            order = order[np.count_nonzero(owner < 0):]         # separators and empty words have no number
            new = np.zeros(len(names), np.int64)
            new[order] = base + np.arange(len(order))
            filled = np.array([bool(w) for w in names], bool)
            parts += [new[number[filled[number]]], np.zeros(1, np.int64)]
            cuts = np.flatnonzero(np.diff(owner[order])) + 1
            for mine in np.split(order, cuts):
                if len(mine):
                    rows.append({"chunk": chunk, "owner": int(owner[mine[0]]), "lang": lang, "data": pack_parts(
                        b" ".join([names[i] for i in mine]), np.int64(new[mine[0]]).tobytes(), pack_numbers(counts[mine]))})
            base += len(order)
        # the sequence by frequency, which compresses better, and the words' numbers
        text = np.concatenate(parts)
        counts = np.bincount(text)
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        blob = pack_parts(planes(place[text]), planes(order))
        rows.append({"chunk": chunk, "file": file.name, "start": file.tell(), "size": len(blob)})
        file.write(blob)
        yield pa.RecordBatch.from_pylist(rows, schema=_SPLIT)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        file = _SideFile(folder, f"words-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.bin")
        chunk, held, rows, size = ctx.partitionId() << 24, {}, 0, 0
        for batch in it:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if not text:
                    continue
                held.setdefault(lang, []).append(text.translate(_TO_WORDS).replace(b".", b" . "))
                rows, size = rows + 1, size + len(text)
                if size >= CHUNK_BYTES or rows >= CHUNK_ROWS:
                    yield from close(chunk, held, file)
                    chunk, held, rows, size = chunk + 1, {}, 0, 0
        if held:
            yield from close(chunk, held, file)
        file.close()

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")) if lang_col else F.lit("und")
    return docs.select(lang, F.col(text_col).cast("string")).mapInArrow(run, _SPLIT_DDL)


def settle_words(sent: DataFrame, min_count: int, owners: int) -> DataFrame:
    """Frequent words (gid, lang, word, f), the words of a language in all (lang,
    f) and, per message, the numbers of its frequent words (chunk, data)."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        out, owner, held = [], key[0].as_py(), []
        for lang in pc.unique(rows.column("lang")).to_pylist():
            mine = rows.filter(pc.equal(rows.column("lang"), lang))
            parts = [unpack_parts(d) for d in mine.column("data").to_pylist()]
            words = [x[0].split(b" ") for x in parts]
            coded = pa.array([w for same in words for w in same], pa.binary()).dictionary_encode()
            number = coded.indices.to_numpy()
            f = np.zeros(len(coded.dictionary), np.int64)
            np.add.at(f, number, np.concatenate([unpack_numbers(x[2]) for x in parts]))
            out.append({"lang": lang, "f": int(f.sum())})
            held.append((lang, mine.column("chunk").to_pylist(), [x[1] for x in parts], [len(w) for w in words],
                         number, coded.dictionary, f))
        # the owner's frequent words by frequency; owners deal their numbers out in
        # turn, so a number is about the word's rank, and ids of one phrase compress well
        counts = np.concatenate([x[-1] for x in held])
        ids = np.full(len(counts), -1, np.int64)
        first = np.argsort(-counts, kind="stable")[:np.count_nonzero(counts >= min_count)]
        ids[first] = np.arange(len(first)) * owners + owner
        at = 0
        for lang, chunks, bases, sizes, number, names, f in held:
            gid = ids[at:at + len(f)]
            at += len(f)
            enough = np.flatnonzero(gid >= 0)
            out += [{"gid": g, "lang": lang, "word": w.decode("utf-8", "replace"), "f": k} for g, w, k in zip(
                gid[enough].tolist(), names.take(pa.array(enough)).to_pylist(), f[enough].tolist())]
            for chunk, base, mine in zip(chunks, bases, np.split(number, np.cumsum(sizes)[:-1])):
                where = np.flatnonzero(gid[mine] >= 0)
                if len(where):
                    hot = gid[mine][where][f[mine][where] >= HOT_WORD]
                    out.append({"chunk": chunk, "data": pack_parts(
                        base, pack_numbers(np.diff(where, prepend=0)), long_planes(gid[mine][where]), long_planes(hot))})
        return pa.Table.from_pylist(out, schema=_WORDS)

    return sent.groupBy("owner").applyInArrow(run, _WORDS_DDL)


def build(chunks: DataFrame, words: DataFrame, texts: str, folder: str, depth: int, owners: int) -> DataFrame:
    """The frequent words of every chunk (a side file) and, by an index of them,
    its pairs of frequent words, packed for their owners."""

    def run(key: tuple, place: pa.Table, known: pa.Table) -> pa.Table:
        rows = place.to_pylist()
        if not rows or not known.num_rows:
            return _SENT.empty_table()
        raw, order = unpack_parts(read_side(texts, rows[0]["file"], rows[0]["start"], rows[0]["size"]))
        text = from_planes(order)[from_planes(raw)]
        replies = [unpack_parts(d) for d in known.column("data").to_pylist()]
        no = np.concatenate([np.frombuffer(x[0], np.int64)[0] + np.cumsum(unpack_numbers(x[1])) for x in replies])
        gid = np.concatenate([from_long_planes(x[2]) for x in replies])
        hot = np.concatenate([from_long_planes(x[3]) for x in replies])
        order = np.argsort(gid)
        gid, no = gid[order], no[order]
        to_word = np.zeros(int(max(text.max(initial=0), no.max(initial=0))) + 1, np.int64)
        to_word[no] = 1 + np.arange(len(no))
        kept = trimmed(to_word[text])
        _, _, n, prefix, suffix = Index.of(kept, gid, depth).extend_words()
        p, s = gid[prefix], gid[suffix]
        order, at = dealt(p, s, owners, np.isin(p, hot))
        n, p, s = n[order], p[order], s[order]
        blob = pack_parts(planes(kept), long_planes(gid), long_planes(hot))
        name = _put(folder, f"frequent-{rows[0]['chunk']}", blob)
        return _sent(rows[0]["chunk"], name, len(blob), None, 0, messages(p, s, n, at))

    return chunks.groupBy("chunk").cogroup(words.groupBy("shard")).applyInArrow(run, _SENT_DDL)


def _indexed_pairs(blob: bytes, known: pa.Table, owners: int, depth: int) -> tuple:
    """From the words of ``build`` and the owners' replies: an index of the words
    in frequent pairs and these pairs (lo, rlo, n, gid)."""
    kept, ids, hot = unpack_parts(blob)
    kept, ids, hot = from_planes(kept).astype(np.int64), from_long_planes(ids), from_long_planes(hot)
    width = len(ids) + 1
    ok = (kept[:-1] > 0) & (kept[1:] > 0)
    # the pairs in the order of ``build``: by first and second word
    pairs, which = np.unique((kept[:-1] * width + kept[1:])[ok], return_inverse=True)
    p, s = ids[pairs // width - 1], ids[pairs % width - 1]
    order, at = dealt(p, s, owners, np.isin(p, hot))
    gid = np.empty(len(pairs), np.int64)
    gid[order] = known_gids(known, at)
    frequent = np.zeros(len(ok), bool)
    frequent[ok] = gid[which] >= 0
    used = np.concatenate([frequent, [False]]) | np.concatenate([[False], frequent])
    index = Index.of(np.where(used, kept, 0), ids, depth)
    lo, rlo, n, prefix, suffix = index.extend_words()
    gid = gid[np.searchsorted(pairs, (prefix + 1) * width + suffix + 1)]
    rows = gid >= 0
    return index, lo[rows], rlo[rows], n[rows], gid[rows]


def _put(folder: str, name: str, blob: bytes) -> str:
    """Write a file of the shared folder that belongs to one task attempt."""
    from pyspark import TaskContext

    file = _SideFile(folder, f"{name}-{TaskContext.get().taskAttemptId()}.bin")
    file.write(blob)
    file.close()
    return file.name


def _sent(chunk: int, file: str, size: int, nodes: str | None, nodes_size: int, parts: Iterator[tuple[int, bytes]]
          ) -> pa.Table:
    rows = [{"chunk": chunk, "file": file, "size": size, "nodes": nodes, "nodes_size": nodes_size}]
    rows += [{"chunk": chunk, "owner": owner, "data": data} for owner, data in parts]
    return pa.Table.from_pylist(rows, schema=_SENT)


def longer(places: DataFrame, replies: DataFrame, folder: str, owners: int, depth: int) -> DataFrame:
    """From the phrases of k words in every shard, whose ids have come back, to
    those of k + 1 words: their intervals in a side file and packed rows for
    their owners, like ``build``.  The index that is stored for these lengths
    holds the words of frequent pairs alone."""

    def run(key: tuple, place: pa.Table, known: pa.Table) -> pa.Table:
        if not place.num_rows or not known.num_rows:
            return _SENT.empty_table()
        (row,) = place.to_pylist()
        blob = read_side(folder, row["file"], 0, row["size"])
        if row["nodes"] is None:
            index, lo, rlo, n, gid = _indexed_pairs(blob, known, owners, depth)
            blob = index.pack()
            row["file"], row["size"] = _put(folder, f"index-{row['chunk']}", blob), len(blob)
        else:
            index = Index.unpack(blob)
            lo, rlo, n, at = (from_long_planes(x) for x in unpack_parts(
                read_side(folder, row["nodes"], 0, row["nodes_size"])))
            gid = known_gids(known, at)
            rows = np.flatnonzero(gid >= 0)
            rows = rows[np.argsort(lo[rows])]
            lo, rlo, n, gid = lo[rows], rlo[rows], n[rows], gid[rows]
        lo, rlo, n, prefix, suffix = index.extend(lo, rlo, n)
        p, s = gid[prefix], gid[suffix]
        order, at = dealt(p, s, owners, np.ones(len(p), bool))
        blob = pack_parts(*map(long_planes, (lo[order], rlo[order], n[order], at)))
        name = _put(folder, f"nodes-{row['chunk']}", blob)
        return _sent(row["chunk"], row["file"], row["size"], name, len(blob),
                     messages(p[order], s[order], n[order], at))

    return places.groupBy("chunk").cogroup(replies.groupBy("shard")).applyInArrow(run, _SENT_DDL)


def phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, text_col: str = "text",
            lang_col: str | None = "lang") -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n of all words; one table per length: gid, f and, for one word,
    lang and word, else the ids ``p`` and ``s`` of the first and last k - 1 words)."""
    spark = docs.sparkSession
    folder, texts, path = (scratch_path(spark, f"phrase-{x}") for x in ("index", "texts", "words"))
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    owners = max(spark.sparkContext.defaultParallelism, -(-size // OWNER_BYTES))
    split(docs, texts, owners, text_col, lang_col).write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(_SPLIT_DDL).parquet(path)
    chunks = table.filter("owner IS NULL").select("chunk", "file", "start", "size")
    words = materialize(settle_words(table.filter("owner IS NOT NULL").select("chunk", "owner", "lang", "data")
                                     .repartition(owners, "owner"), min_count, owners), "phrase-1")
    totals = words.filter("chunk IS NULL AND word IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    level = [words.filter("word IS NOT NULL").select("gid", "lang", "word", "f")]
    known = words.filter("chunk IS NOT NULL").select(F.col("chunk").alias("shard"), "data")
    tasks = tasks_for(spark, chunks.count(), CHUNKS_PER_TASK)
    sent = build(chunks.repartition(tasks, "chunk"), known.repartition(tasks, "shard"), texts, folder, max_words, owners)
    for k in range(2, max_words + 1):
        sent = materialize(sent, f"phrase-sent-{k}")
        if k == 2:
            delete_scratch(spark, texts, path)          # nothing reads them any more
        owned = materialize(settle(sent.filter("owner IS NOT NULL").select("chunk", "owner", "data")
                                   .repartition(owners, "owner"), min_count), f"phrase-{k}")
        level.append(owned.filter("chunk IS NULL").select("gid", "p", "s", "f"))
        if k < max_words:
            replies = owned.filter("chunk IS NOT NULL").select(F.col("chunk").alias("shard"), "owner", "data")
            places = sent.filter("owner IS NULL").select("chunk", "file", "size", "nodes", "nodes_size")
            sent = longer(places.repartition(tasks, "chunk"), replies.repartition(tasks, "shard"), folder, owners,
                          max_words)
    return totals, level


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, text_col: str = "text",
                 lang_col: str | None = "lang") -> DataFrame:
    """lang, phrase, a, l, r, n, score of every candidate that no longer one of
    the same count contains (the extension counts are ``left`` and ``right``: the
    most frequent phrase with one word more on that side, null if none)."""
    totals, level = phrases(docs, min_count, max_words, text_col, lang_col)
    held = level[0].select("gid", "lang", "f", F.array("word").alias("words"),
                           F.array().cast("array<long>").alias("first"), F.array().cast("array<long>").alias("rest"))
    out = None
    for k, table in enumerate(level[1:], start=2):
        a, b = held.alias("a"), held.alias("b")
        held = (table.join(a, F.col("p") == F.col("a.gid")).join(b, F.col("s") == F.col("b.gid")).select(
            table["gid"], F.col("a.lang").alias("lang"), table["f"],
            F.concat("a.words", F.slice("b.words", -1, 1)).alias("words"),
            F.concat("a.first", F.array("a.f")).alias("first"), F.concat(F.array("b.f"), "b.rest").alias("rest")))
        rows = held
        if k < len(level):
            held = materialize(held, f"phrase-parts-{k}")
            rows = held
            for side, part in (("right", "p"), ("left", "s")):
                grown = level[k].groupBy(F.col(part).alias("gid")).agg(F.max("f").alias(side))
                rows = rows.join(grown, "gid", "left")
            rows = rows.filter(F.coalesce(F.greatest("left", "right"), F.lit(0)) < F.col("f"))
        else:
            rows = rows.select("*", F.lit(None).cast("long").alias("right"), F.lit(None).cast("long").alias("left"))
        rows = rows.select("lang", "words", "f", "first", "rest", "left", "right")
        out = rows if out is None else out.unionByName(rows)
    exact = lambda c: c.cast("decimal(19,0)")

    def cut(k: Column) -> Column:
        left, rest = F.element_at("first", k), F.element_at("rest", k)
        share = F.call_function("div", exact(1000 * F.col("f")) * exact(F.col("n")), exact(left) * exact(rest))
        return F.struct(share.alias("score"), k.alias("k"), left.alias("l"), rest.alias("r"))

    best = F.array_min(F.transform(F.sequence(F.lit(1), F.size("first")), cut))
    return (out.join(totals, "lang").withColumn("cut", best)
            .select("lang", F.concat_ws(" ", "words").alias("phrase"), F.col("f").alias("a"), F.col("cut.l").alias("l"),
                    F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"), "left", "right"))


def top(found: DataFrame, limit: int = TOP) -> DataFrame:
    """The first ``limit`` collocations of each language (of parts of a language
    first, so that no task ranks a whole one)."""
    order = (F.desc("score"), F.desc("a"), "phrase")
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    found = found.withColumn("rank", first).filter(F.col("rank") <= limit)
    return (found.withColumn("rank", best).filter(F.col("rank") <= limit)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
