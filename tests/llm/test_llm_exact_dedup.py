import hashlib
import re

import numpy as np
from cases import edge_docs, rows_of
from hypothesis import given
from hypothesis import strategies as st

from tarmac.llm import exact_dedup


def expected(docs):
    groups = {}
    for row, (d, t) in enumerate(docs):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append((d is None, d or 0, row))
    out = []
    for text, members in groups.items():
        first = min(members)
        keep = None if first[0] else first[1]
        for null, d, row in members:
            out.append((None if null else d, keep, len(members), (null, d, row) == first,
                        hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edges(spark):
    docs = edge_docs(spark)
    got = sorted(rows_of(exact_dedup.exact_groups(docs)), key=repr)
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_copies_over_many_chunks(spark, monkeypatch):
    """Groups that span chunks, with few fingerprint bits, so that different
    texts become suspects."""
    monkeypatch.setattr(exact_dedup, "CHUNK_ROWS", 10)
    monkeypatch.setattr(exact_dedup, "SPARE_BITS", 1)
    rows = [(i, ["hot copy", f"text {i % 70}", f"only {i}"][i % 3]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted(rows_of(exact_dedup.exact_groups(docs)), key=repr)
    assert got == expected(rows)


def test_empty_table(spark):
    assert rows_of(exact_dedup.exact_groups(edge_docs(spark, []))) == []


@given(st.sets(st.integers(0, (1 << 40) - 1), max_size=200))
def test_rice_round_trip(values):
    v = np.array(sorted(values), np.uint64)
    assert exact_dedup.rice_decode(exact_dedup.rice_encode(v, 1 << 40), len(v)).tolist() == v.tolist()


def test_rice_is_compact():
    v = np.unique(np.random.default_rng(0).integers(0, 1 << 34, 5000).astype(np.uint64))
    assert len(exact_dedup.rice_encode(v, 1 << 34)) < 3.2 * len(v)


@given(st.text(alphabet=" \t\n\v\f\rab  ", max_size=20))
def test_normalise(text):
    assert exact_dedup.normalise(text.encode()).decode() == re.sub(r"[\x20\x09-\x0D]+", " ", text)
