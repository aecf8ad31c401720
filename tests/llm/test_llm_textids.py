"""ids of whole texts equal the tokenizers library's."""

import random

import numpy as np
import pyarrow as pa
import pytest
from cases import EDGE_TEXTS, SF

from tarmac.llm import textids
from tarmac.llm.words import default_vocab, load_tokenizer

TOK = load_tokenizer(default_vocab())
ODD = ["ΣΑΣ. foo!., a'S b's. x\x01y \x01 <|endoftext|>. É.É, ÷× a×b ﬁ İ ǅ ß. 1.2,3. ..., '. it's.",
       "a b c d\x1ce\x85f \x1f", "日本語。テスト, мир. 한국어", "<|startoftext|>. <|EndOfText|>,", "\x01", "..,", ". ,",
       "Ǆ. ñ́. x́., Ÿ. ÿ,", "E=mc2., (a.b.c.). [x]."]


def library(texts):
    return [TOK.encode(t or "", add_special_tokens=False).ids for t in texts]


def ids_of(texts):
    return [x.tolist() for x in textids.TextIds(default_vocab())(pa.array(texts, pa.string()))]


@pytest.mark.parametrize("block", [1, 200, textids.BLOCK_BYTES])
def test_edge_texts(monkeypatch, block):
    monkeypatch.setattr(textids, "BLOCK_BYTES", block)
    texts = [t for _, t in EDGE_TEXTS if t is None or len(t) < 1000] + ODD
    assert ids_of(texts) == library(texts)


def test_empty_columns():
    assert ids_of([]) == [] and ids_of([None, ""]) == [[], []] and ids_of([" \n"]) == [[]]


def test_long_text_in_blocks(monkeypatch):
    monkeypatch.setattr(textids, "BLOCK_BYTES", 10_000)
    text = " ".join(random.Random(1).choices(["the", "Größe.", "x1,", "it's", "é", "ab" * 700], k=8000))
    assert ids_of([text, "end."]) == library([text, "end."])


def test_random_words_and_what_a_worker_remembers(monkeypatch):
    monkeypatch.setattr(textids, "BLOCK_BYTES", 500)
    monkeypatch.setattr(textids, "KNOWN_PARTS", 20)
    rng = random.Random(3)
    letters = "abcdeéßÀΩ.,'<|>1 2\x01 \t"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(600)]
    assert ids_of(texts) == library(texts)


def test_without_fast_paths(monkeypatch):
    ids = textids.TextIds(default_vocab())
    ids.fast = ids.marked = False
    texts = [t for _, t in EDGE_TEXTS if t is None or len(t) < 1000] + ODD
    assert [x.tolist() for x in ids(pa.array(texts, pa.string()))] == library(texts)


def test_documents():
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()
    assert ids_of(texts) == library(texts)
    assert all(isinstance(x, np.ndarray) for x in textids.text_ids(default_vocab())(pa.array(texts)))
