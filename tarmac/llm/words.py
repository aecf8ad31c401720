"""Token ids of whole texts, word by word.

A *word* here is a run of bytes without ASCII white space.  For tokenizers
whose pre-tokenizer never lets a piece cross white space (``word_bpe_49k.json``
drops it), the ids of a text are the ids of its words in order, so a word that
was seen before need not be encoded again.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from typing import Callable, Iterator

CACHE_WORDS = 200_000       # words in each of a cache's two generations
GROUP_BYTES = 1 << 20       # text whose new words are encoded together


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load_tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # Spark runs the tasks in parallel
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def byte_alphabet() -> dict[int, str]:
    """Character of each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the other bytes for U+0100 and on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(0x100 + i) for i, b in enumerate(rest)}}


_BYTES = byte_alphabet()
#: Words of these letters are one piece for the pre-tokenizer, and stay as they are but for case.
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


class Encoder:
    """ids of words by a tokenizer file.  Plain words go straight to the
    file's BPE model, if that gives the whole tokenizer's ids on probes; all
    others go through the whole tokenizer."""

    def __init__(self, vocab: str):
        self.tok = load_tokenizer(vocab)
        self.model = self.tok.model
        letters = [chr(c) for c in range(0x41, 0x100) if _PLAIN.fullmatch(chr(c))]
        probes = letters + ["x" + c + "er" for c in letters] + ["Straße", "ÉTÉ", "the"]
        try:
            self.plain = all(self._plain(p) == self.tok.encode(p, add_special_tokens=False).ids for p in probes)
        except Exception:       # a model without this interface
            self.plain = False

    def _plain(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.lower().encode().decode("latin-1").translate(_BYTES))]

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """ids of each word as packed unsigned 32-bit integers, little-endian."""
        out: list = [None] * len(words)
        rest = []
        for i, w in enumerate(words):
            text = w.decode("utf-8", "replace")
            if self.plain and _PLAIN.fullmatch(text):
                out[i] = array("I", self._plain(text)).tobytes()
            else:
                rest.append((i, text))
        done = self.tok.encode_batch([t for _, t in rest], add_special_tokens=False)
        for (i, _), e in zip(rest, done):
            out[i] = array("I", e.ids).tobytes()
        return out


@lru_cache(maxsize=2)
def encoder(vocab: str) -> Encoder:
    """One ``Encoder`` per worker process and vocabulary."""
    return Encoder(vocab)


class WordCache:
    """Values of words, computed in batches and remembered in two generations
    of bounded size, so that frequent words stay known."""

    def __init__(self, values_of: Callable[[list[bytes]], list], size: int = CACHE_WORDS):
        self.values_of, self.size = values_of, size
        self.known: dict = {}
        self.old: dict = {}

    def learn(self, words: set[bytes]) -> dict:
        """A mapping that holds (at least) the given words."""
        if len(self.known) > self.size:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        new = words.difference(known)
        if new:
            again = new.intersection(old)
            known.update([(w, old[w]) for w in again])
            rest = list(new.difference(again))
            known.update(zip(rest, self.values_of(rest)))
        return known


def groups(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    """The words of the texts, in groups of texts of about GROUP_BYTES."""
    held, size = [], 0
    for t in texts:
        held.append((t or b"").split())
        size += len(t or b"")
        if size >= GROUP_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def core_and_tail(word: bytes) -> tuple[bytes, bytes]:
    """A word cut before its last full stops and commas, its first part in
    lower case, if that leaves the ids as they are: the cut must follow an
    ASCII letter or digit, where the pre-tokenizer cuts too, and a word that
    may hold a special token keeps its case."""
    core = word.rstrip(b".,")
    if len(core) == len(word) or not core or not (core[-1:].isalnum()):
        core = word
    return (core if b"<|" in core else core.lower()), word[len(core):]


class WordIds:
    """ids of UTF-8 texts as packed unsigned 32-bit integers, little-endian."""

    def __init__(self, vocab: str):
        self.parts = WordCache(encoder(vocab))
        self.words = WordCache(self._ids)

    def _ids(self, words: list[bytes]) -> list[bytes]:
        cut = [core_and_tail(w) for w in words]
        part = self.parts.learn({p for pair in cut for p in pair if p})
        return [part[a] + part[b] if b else part[a] for a, b in cut]

    def __call__(self, texts: list[bytes | None]) -> Iterator[bytes]:
        for group in groups(texts):
            known = self.words.learn(set().union(*group))
            for words in group:
                yield b"".join([known[w] for w in words])


@lru_cache(maxsize=2)
def word_ids(vocab: str) -> WordIds:
    """One ``WordIds`` per worker process and vocabulary."""
    return WordIds(vocab)
