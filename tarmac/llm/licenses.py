"""License mentions: exact phrases and fuzzy short notices.

Texts are lower-cased (A-Z) and cut into words of 0-9, a-z and non-ASCII
characters; everything else separates words.  The words, joined by single
spaces, are the text that is searched, and a match always covers whole words.

* Base places: the phrase's words stand consecutively.
* Fuzzy search (``Phrase.edits`` > 0): a match within ``edits`` insertions,
  deletions and substitutions of characters leaves at least one of
  ``edits + 1`` pieces of the phrase untouched (pigeonhole).  The pieces are
  exact seeds for one Aho-Corasick scan; each seed found fixes a window that
  any match around it must lie in, windows that meet are merged, and the
  ``regex`` library's bounded-error matching verifies the window and gives the
  span and the edits.

``scan`` returns per row: doc_id, n_words, places (label, word), spans (label,
first word, number of words, edits) and the derived columns.  ``score`` is 1
with a base place, else the best 1 - edits / phrase length, else 0.

A text takes time in proportion to its length, however many notices it repeats:
word numbers come from the sorted places of the spaces, and a fuzzy match is
compared with the matches around it alone.

Edge cases: null or empty text has no words and score 0; null doc_ids and
repeated rows are kept; a very long text is searched whole; invalid UTF-8 is read with replacement characters; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import batches, utf8_rows


@dataclass(frozen=True)
class Phrase:
    text: str
    label: str
    edits: int = 0


#: Fixed values of the query: phrases and labels; edits are the method's.
PHRASES = (
    Phrase("gnu general public license", "gpl", 3),
    Phrase("apache license", "apache", 2),
    Phrase("cc by", "cc-by", 0),
    Phrase("mit license", "mit", 1),
)

_WORD = frozenset(range(0x30, 0x3A)) | frozenset(range(0x61, 0x7B)) | frozenset(range(0x80, 0x100))
#: Bytes to word bytes: A-Z lower-cased, separators to space.
_TO_WORDS = bytes(b if (b := c + 32 if 0x41 <= c <= 0x5A else c) in _WORD else 0x20 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


def seeds(phrase: Phrase) -> list[tuple[int, str]]:
    """(offset, piece) of the ``edits + 1`` pieces of a phrase."""
    n, k = len(phrase.text), phrase.edits + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, phrase.text[a:b]) for a, b in zip(cuts, cuts[1:])]


def _places(text: str, char: str) -> np.ndarray:
    """Where a character stands."""
    return np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == ord(char))


def _meets(a: int, b: int, longest: int, begins: list[int], ends: list[int]) -> bool:
    """Does [a, b) meet any of the spans, none of which is over ``longest``?"""
    at = bisect.bisect_left(begins, b)
    while at and begins[at - 1] > a - longest:
        at -= 1
        if ends[at] > a:
            return True
    return False


class Scanner:
    def __init__(self, phrases: tuple[Phrase, ...] = PHRASES):
        import ahocorasick
        import regex

        self.phrases = phrases
        self.automaton = ahocorasick.Automaton()
        held: dict[str, list[tuple[int, int]]] = {}
        for i, p in enumerate(phrases):
            for offset, piece in seeds(p):
                held.setdefault(piece, []).append((i, offset))
        for piece, uses in held.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()
        # fewest edits first: the first pattern that matches gives the distance
        self.patterns = [[regex.compile(rf"(?<![^ ])(?:{regex.escape(p.text)}){{e<={e}}}(?![^ ])"
                                        if e else rf"(?<![^ ]){regex.escape(p.text)}(?![^ ])")
                          for e in range(p.edits + 1)] for p in phrases]

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """phrase -> merged [from, to) parts of ``text`` that hold all matches."""
        found: dict[int, list[list[int]]] = {}
        for end, (size, uses) in self.automaton.iter(text):
            for i, offset in uses:
                p = self.phrases[i]
                start = end + 1 - size - offset
                low = max(0, start - p.edits)
                high = min(len(text), start + len(p.text) + p.edits)
                spans = found.setdefault(i, [])
                if spans and low <= spans[-1][1] + 1:
                    spans[-1][0] = min(spans[-1][0], low)
                    spans[-1][1] = max(spans[-1][1], high)
                else:
                    spans.append([low, high])
        return found

    def __call__(self, raw: bytes | None) -> tuple:
        words = words_of(raw)
        text = b" ".join(words).decode("utf-8", "replace")
        places: list[tuple[str, int]] = []
        spans: list[tuple[str, int, int, int]] = []
        best = 0.0
        windows = self.windows(text)
        spaces = _places(text, " ") if windows else None
        for i, parts in sorted(windows.items()):
            p = self.phrases[i]
            longest = len(p.text) + p.edits
            for low, high in parts:
                # (begins, ends) of the matches with 0, 1, ... edits, each in order
                taken: list[tuple[list[int], list[int]]] = []
                # some room, so that no match that is tried ends at the window's edge
                high = min(len(text), high + p.edits + 1)
                for edits, pattern in enumerate(self.patterns[i]):
                    taken.append(([], []))
                    for m in pattern.finditer(text, low, high, overlapped=True):
                        a, b = m.span()
                        # word ends of the text, not of the window
                        if (a and text[a - 1] != " ") or (b < len(text) and text[b] != " ") or a == b:
                            continue
                        if edits and any(_meets(a, b, longest, *held) for held in taken):
                            continue            # part of a closer match
                        taken[-1][0].append(a)
                        taken[-1][1].append(b)
                        first = int(spaces.searchsorted(a))
                        spans.append((p.label, first, text.count(" ", a, b) + 1, edits))
                        best = max(best, 1 - edits / len(p.text))
                        if not edits:
                            places.append((p.label, first))
        return len(words), sorted(places), sorted(spans), best


@lru_cache(maxsize=2)
def scanner(phrases: tuple[Phrase, ...]) -> Scanner:
    return Scanner(phrases)


_PLACE = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64()),
                            ("edits", pa.int32())]))


def scan(docs: DataFrame, phrases: tuple[Phrase, ...] = PHRASES, text_col: str = "text",
         id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, places, spans, score per row of ``docs``."""
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", _PLACE),
                     ("spans", _SPAN), ("score", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(phrases)

        def rows() -> Iterator[tuple]:
            for batch in it:
                for doc_id, text in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1))):
                    n, places, spans, score = find(text)
                    yield (doc_id, n, [{"label": a, "word": w} for a, w in places],
                           [{"label": a, "word": w, "words": k, "edits": e} for a, w, k, e in spans], score)

        yield from batches(rows(), out)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, n_words long, places array<struct<label:string,word:long>>, "
             "spans array<struct<label:string,word:long,words:long,edits:int>>, score double")


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of the query from ``scan``'s output."""
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.col(f"{c}.label"))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        names("places").alias("base_labels"), names("spans").alias("labels"), "score")
