import hashlib

import numpy as np
import pytest
from cases import edge_docs, rows_of, sf_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from tarmac.llm import bpe
from tarmac.llm.words import default_vocab, load_tokenizer, word_ids

TOK = load_tokenizer(default_vocab())


def expected(docs):
    out = []
    for doc_id, text in docs:
        ids = TOK.encode(text or "", add_special_tokens=False).ids
        out.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(TOK.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("make", [sf_docs, edge_docs])
def test_equals_the_library(spark, make):
    docs = make(spark)
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(rows_of(bpe.digests(bpe.decode(bpe.encode(docs)))), key=repr) == want
    assert sorted(rows_of(bpe.digests(bpe.encode(docs, decoded=True))), key=repr) == want


def test_many_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_ROWS", 3)
    docs = sf_docs(spark)
    got = sorted(rows_of(bpe.digests(bpe.decode(bpe.encode(docs)))), key=repr)
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark):
    assert rows_of(bpe.digests(bpe.decode(bpe.encode(edge_docs(spark, []))))) == []


def test_decode_unknown_and_null_ids(spark):
    ids = np.array([320, 10 ** 6, 49407], "<u4").tobytes()
    df = spark.createDataFrame([(1, bytearray(ids), "other"), (2, None, None)], "doc_id long, ids binary, text string")
    got = {r.doc_id: r.text for r in bpe.decode(df).collect()}
    assert got == {1: TOK.decode([320, 10 ** 6, 49407], skip_special_tokens=False), 2: ""}


@given(st.lists(st.integers(0, (1 << 28) - 1), max_size=100))
def test_packed_numbers(values):
    v = np.array(values, np.int64)
    assert bpe.unpack_numbers(bpe.pack_numbers(v)).tolist() == values


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]),
                                  st.sampled_from(" .,\t\n\r\x0b\x0c\x1c\x85 　'sret́AΣ<|endoftext|>")),
               max_size=40))
def test_words_cut_at_ascii_white_space_keep_the_ids(text):
    (got,) = word_ids(default_vocab())([text.encode()])
    assert np.frombuffer(got, "<u4").tolist() == TOK.encode(text, add_special_tokens=False).ids
