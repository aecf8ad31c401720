"""Greedy word-piece token counts by a linear longest-match automaton.

``Automaton`` is a trie over the vocabulary with failure links.  Suppose the
symbols read so far since the last popped token spell trie node u and the next
symbol has no edge from u.  Greedy longest-match would now pop one or more
tokens; which ones depends on u alone.  So for each node the build stores
``fail[u]`` (the node that spells what is left after those pops) and
``pops[u]`` (how many tokens were popped).  A scan then follows edges and
failure links, adds up ``pops`` and never builds a piece; each symbol is read
once.

Symbols are the characters of the vocabulary's byte alphabet; the last
character of a word is a symbol of its own (the vocabulary marks word ends), so
no token crosses a word end.  Every single symbol is a token of the vocabulary,
so each word can be cut.  Words come from the tokenizer file's own normaliser
and pre-tokenizer.  Counts of words seen before are remembered (bounded).

Edge cases: null or empty text has 0 words and 0 tokens; a word with a symbol
outside the vocabulary counts as one (unknown) token; a very long text is counted
whole; null doc_ids and repeated rows are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import utf8_rows
from tarmac.llm.words import WordCache, default_vocab, groups, load_tokenizer

WORD_END = "</w>"


def symbols(token: str, end: str = WORD_END) -> tuple[str, ...]:
    """Characters of a token or word; the end mark joins the last one."""
    if end and token.endswith(end) and len(token) > len(end):
        body = token[:-len(end)]
        return (*body[:-1], body[-1] + end)
    return tuple(token)


class Automaton:
    """Trie with failure links and popped-token counts."""

    def __init__(self, tokens: Iterable[tuple[str, ...]]):
        self.edges: list[dict[str, int]] = [{}]
        is_token = [False]
        for token in tokens:
            at = 0
            for s in token:
                if s not in self.edges[at]:
                    self.edges[at][s] = len(self.edges)
                    self.edges.append({})
                    is_token.append(False)
                at = self.edges[at][s]
            is_token[at] = bool(token)
        # breadth first: a failure link leads to a shorter string
        self.fail: list[int] = [-1] * len(self.edges)      # -1: what is left cannot be cut
        self.pops: list[int] = [0] * len(self.edges)
        level = [0]
        while level:
            below = []
            for u in level:
                for s, v in self.edges[u].items():
                    below.append(v)
                    if is_token[v]:
                        self.fail[v], self.pops[v] = 0, 1
                        continue
                    w, popped = self.fail[u], self.pops[u]
                    while w >= 0 and s not in self.edges[w]:
                        popped, w = popped + self.pops[w], self.fail[w]
                    if w >= 0:
                        self.fail[v], self.pops[v] = self.edges[w][s], popped
            level = below

    def count(self, word: Iterable[str]) -> int | None:
        """Number of greedy longest-match tokens, None if there is no cut."""
        u = total = 0
        edges, fail, pops = self.edges, self.fail, self.pops
        for s in word:
            while s not in edges[u]:
                total += pops[u]
                u = fail[u]
                if u < 0:
                    return None
            u = edges[u][s]
        while u > 0:
            total += pops[u]
            u = fail[u]
        return total if u == 0 else None


class TokenCounter:
    """(words, tokens) of a UTF-8 text."""

    def __init__(self, vocab: str):
        self.tok = load_tokenizer(vocab)
        special = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        self.automaton = Automaton(symbols(t) for t in self.tok.get_vocab() if t not in special)
        self.cache = WordCache(self._counts)

    def pre_words(self, word: str) -> list[str]:
        tok = self.tok
        return [w for w, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(word))]

    def _counts(self, words: list[bytes]) -> list[complex]:
        out = []
        for w in words:
            parts = self.pre_words(w.decode("utf-8", "replace"))
            tokens = sum(1 if (n := self.automaton.count(symbols(p + WORD_END))) is None else n
                         for p in parts)
            out.append(complex(len(parts), tokens))    # two counts that add up as one number
        return out

    def __call__(self, texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
        for group in groups(texts):
            known = self.cache.learn(set().union(*group))
            for words in group:
                total = sum([known[w] for w in words], 0j)
                yield int(total.real), int(total.imag)


@lru_cache(maxsize=2)
def token_counter(vocab: str) -> TokenCounter:
    """One counter per worker process and vocabulary."""
    return TokenCounter(vocab)


def token_counts(docs: DataFrame, vocab: str | None = None, text_col: str = "text",
                 id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_tokens per row of ``docs``."""
    vocab = vocab or default_vocab()
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(vocab)
        for batch in it:
            counts = np.array(list(counter(utf8_rows(batch.column(1)))), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts[:, 0]), pa.array(counts[:, 1])], schema=out)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")
                       ).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
