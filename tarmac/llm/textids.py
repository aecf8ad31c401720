"""Token ids of whole texts, a block of texts at a time in Arrow and numpy.

For tokenizers whose pre-tokenizer never lets a piece cross ASCII white space
(``word_bpe_49k.json`` drops it).  Per block of texts:

1. the texts are cut at white space and their words numbered (Arrow dictionary);
2. a distinct word is cut before its last full stops and commas where the
   pre-tokenizer cuts too, and its first part lower-cased where that leaves the
   ids as they are (``_cut``), which leaves fewer distinct parts;
3. the distinct parts are encoded, many in one call of the library (``_encode``);
4. every position takes the ids of its word (numpy).

A text longer than a block is cut into blocks at white space, so memory follows
the block and the ids of the longest text.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tarmac.llm.words import byte_alphabet, load_tokenizer

BLOCK_BYTES = 8 << 20       # text that is encoded together
LINE_WORDS = 256            # words per text given to the library
KNOWN_PARTS = 300_000       # parts whose ids a worker remembers

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_MARK = "\x01"              # between words that are several pieces

_ALNUM = np.zeros(256, bool)
_ALNUM[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True


class Ragged:
    """Rows of numbers in one array: row i is ``flat[at[i]:at[i + 1]]``."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat, sizes
        self.at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> "Ragged":
        return cls(np.concatenate([np.zeros(0, np.uint32), *rows]), np.fromiter(map(len, rows), np.int64, len(rows)))

    @classmethod
    def joined(cls, parts: list["Ragged"]) -> "Ragged":
        return cls(np.concatenate([p.flat for p in parts]), np.concatenate([p.sizes for p in parts]))

    def __eq__(self, other) -> bool:
        return np.array_equal(self.flat, other.flat) and np.array_equal(self.sizes, other.sizes)

    def take(self, rows: np.ndarray) -> "Ragged":
        sizes = self.sizes[rows]
        first = np.cumsum(sizes, dtype=np.int64) - sizes
        where = np.arange(int(sizes.sum())) + np.repeat(self.at[rows] - first, sizes)
        return Ragged(self.flat[where], sizes)


def _bytes_of(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, data) of a binary array without nulls."""
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int32, len(a) + 1, a.offset * 4)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _cut(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(cores, tails) of distinct words: a tail of full stops and commas may be
    cut off after an ASCII letter or digit.  A word that may hold a special
    token keeps its case."""
    at, data = _bytes_of(words)
    if not len(data):
        return words, words
    tail_bytes = (data == ord(".")) | (data == ord(","))
    # last byte of each word that is neither: running maximum of such places
    last = np.maximum.accumulate(np.where(tail_bytes, -1, np.arange(len(data))))
    end = last[at[1:] - 1] + 1
    ok = (end > at[:-1]) & (end < at[1:])
    ok &= _ALNUM[data[np.maximum(end - 1, 0)]]
    end = np.where(ok, end, at[1:])
    size = end - at[:-1]
    core_at = np.concatenate([[0], np.cumsum(size)])
    keep = np.bincount(at[:-1], minlength=len(data) + 1) - np.bincount(end, minlength=len(data) + 1)
    in_core = np.cumsum(keep[:-1]) > 0
    base = slice(int(at[0]), int(at[-1]))
    core = pa.Array.from_buffers(pa.binary(), len(words), [
        None, pa.py_buffer(core_at.astype(np.int32).tobytes()), pa.py_buffer(data[base][in_core[base]].tobytes())])
    tail_at = np.concatenate([[0], np.cumsum(at[1:] - end)])
    tail = pa.Array.from_buffers(pa.binary(), len(words), [
        None, pa.py_buffer(tail_at.astype(np.int32).tobytes()), pa.py_buffer(data[base][~in_core[base]].tobytes())])
    core = core.cast(pa.string())
    special = pc.match_substring(core, "<|")
    return pc.if_else(special, core, pc.ascii_lower(core)), tail.cast(pa.string())


def _plain(parts: pa.Array) -> np.ndarray:
    """Which strings have Latin letters up to U+00FF alone, so that the
    pre-tokenizer keeps them whole."""
    at, data = _bytes_of(parts)
    lead = np.concatenate([[False], data[:-1] == 0xC3]) if len(data) else np.zeros(0, bool)
    good = _LETTER[data] | (data == 0xC3) | (lead & (data != 0x97) & (data != 0xB7) & (data >= 0x80))
    bad = np.concatenate([[0], np.cumsum(~good)])
    return (bad[at[1:]] == bad[at[:-1]]) & (at[1:] > at[:-1])


class TextIds:
    """ids of UTF-8 texts by a tokenizer file."""

    def __init__(self, vocab: str):
        from tokenizers import normalizers, pre_tokenizers

        self.tok = load_tokenizer(vocab)
        # the same model for words that are one piece: white space alone cuts
        self.whole = load_tokenizer(vocab)
        self.whole.normalizer = normalizers.Lowercase()
        self.whole.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        pieces = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(pieces.values(), default=0) + 1, bool)
        if suffix:
            self.ends[[i for p, i in pieces.items() if p.endswith(suffix)]] = True
        self.mark = pieces.get(byte_alphabet()[ord(_MARK)] + (suffix or ""), -1)
        probes = ["a", "É", "ß", "straße", "ÉTÉ", "the", "xÿer", "ÀÖØöøÞ", "internationalisation"]
        expect = self._one_by_one(probes)
        self.fast = bool(suffix) and self._words(probes) == expect
        self.marked = self.mark >= 0 and self._marked(probes) == expect
        # ids of frequent parts of earlier blocks
        self.known, self.known_ids = pa.array([], pa.string()), Ragged.of([])

    def _ids(self, tok, lines: list[str]) -> np.ndarray:
        done = tok.encode_batch_fast(lines, add_special_tokens=False)
        return np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in done)])

    def _one_by_one(self, words: list[str]) -> Ragged:
        return Ragged.of([np.array(self.tok.encode(w, add_special_tokens=False).ids, np.uint32) for w in words])

    def _words(self, words: list[str]) -> Ragged:
        """ids of words that are one piece each, told apart by the end-of-word pieces."""
        ids = self._ids(self.whole, [" ".join(words[i:i + LINE_WORDS]) for i in range(0, len(words), LINE_WORDS)])
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or (len(cuts) and cuts[-1] != len(ids)):
            return self._one_by_one(words)
        return Ragged(ids, np.diff(cuts, prepend=0))

    def _marked(self, words: list[str]) -> Ragged:
        """ids of any words without the mark, told apart by a mark after each."""
        sep = f" {_MARK} "
        ids = self._ids(self.tok, [sep.join(words[i:i + LINE_WORDS]) + sep for i in range(0, len(words), LINE_WORDS)])
        marks = ids == self.mark
        cuts = np.flatnonzero(marks)
        if len(cuts) != len(words):
            return self._one_by_one(words)
        return Ragged(ids[~marks], np.diff(cuts, prepend=-1) - 1)

    def _encode(self, parts: pa.Array) -> Ragged:
        """ids of distinct strings."""
        odd = pc.match_substring_regex(parts, "<\\||" + _MARK).to_numpy(zero_copy_only=False)
        plain = _plain(parts) & ~odd & self.fast
        marked = ~plain & ~odd & self.marked
        rows, got = [], []
        for mask, encode in ((plain, self._words), (marked, self._marked), (~plain & ~marked, self._one_by_one)):
            rows.append(np.flatnonzero(mask))
            got.append(encode(parts.take(pa.array(rows[-1])).to_pylist()))
        place = np.empty(len(parts), np.int64)
        place[np.concatenate(rows)] = np.arange(len(parts))
        return Ragged.joined(got).take(place)

    def _part_ids(self, parts: pa.Array, counts: np.ndarray) -> Ragged:
        """ids of distinct strings that occur so often in a block, by what
        earlier blocks knew; the most frequent ones are remembered."""
        at = pc.fill_null(pc.index_in(parts, value_set=self.known), -1).to_numpy()
        new = np.flatnonzero(at < 0)
        place = at.astype(np.int64)
        place[new] = len(self.known) + np.arange(len(new))
        ids = Ragged.joined([self.known_ids, self._encode(parts.take(pa.array(new)))])
        got = ids.take(place)
        keep = np.argsort(-counts, kind="stable")[:KNOWN_PARTS]
        unused = np.ones(len(self.known), bool)
        unused[at[at >= 0]] = False
        old = np.flatnonzero(unused)[:KNOWN_PARTS - len(keep)]
        self.known = pa.concat_arrays([parts.take(pa.array(keep)), self.known.take(pa.array(old))])
        self.known_ids = Ragged.joined([got.take(keep), self.known_ids.take(old)])
        return got

    def _block(self, texts: pa.Array) -> Ragged:
        """ids of each text of a block (strings without nulls)."""
        lists = pc.ascii_split_whitespace(texts)
        flat, ends = lists.flatten(), lists.offsets.to_numpy()
        ends = ends - ends[0]
        coded = pc.dictionary_encode(flat)
        number = coded.indices.to_numpy()
        core, tail = (pc.dictionary_encode(p) for p in _cut(coded.dictionary))
        cores, tails = core.dictionary, tail.dictionary
        core, tail = core.indices.to_numpy(), tail.indices.to_numpy()
        heads = self._part_ids(cores, np.bincount(core[number], minlength=len(cores)))
        marks = self._encode(tails)
        # ids of the distinct words: those of the core, then those of the tail
        both = Ragged.joined([heads, marks])
        pairs = np.empty(2 * len(core), np.int64)
        pairs[0::2], pairs[1::2] = core, len(heads.sizes) + tail
        joined = both.take(pairs)
        words = Ragged(joined.flat, joined.sizes[0::2] + joined.sizes[1::2])
        got = words.take(number)
        upto = np.concatenate([[0], np.cumsum(got.sizes, dtype=np.int64)])[ends]
        return Ragged(got.flat, np.diff(upto))

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """ids (unsigned 32-bit) of each text; null counts as empty."""
        texts = pc.fill_null(texts, "")
        sizes = pc.binary_length(texts).to_numpy()
        first = 0
        while first < len(texts):
            if sizes[first] > BLOCK_BYTES:
                yield self._long(texts[first].as_buffer().to_pybytes())
                first += 1
                continue
            upto = np.cumsum(sizes[first:], dtype=np.int64)
            n = max(1, int(np.searchsorted(upto, BLOCK_BYTES, "right")))
            got = self._block(texts.slice(first, n))
            for i in range(n):
                yield got.flat[got.at[i]:got.at[i + 1]]
            first += n

    def _long(self, text: bytes) -> np.ndarray:
        """ids of one text of more than a block, cut at white space."""
        out, at = [np.zeros(0, np.uint32)], 0
        while at < len(text):
            space = _SPACE.search(text, min(at + BLOCK_BYTES, len(text)))
            end = space.start() if space else len(text)
            out.append(self._block(pa.array([text[at:end].decode("utf-8", "replace")], pa.string())).flat)
            at = end
        return np.concatenate(out)


@lru_cache(maxsize=2)
def text_ids(vocab: str) -> TextIds:
    """One ``TextIds`` per worker process and vocabulary."""
    return TextIds(vocab)
