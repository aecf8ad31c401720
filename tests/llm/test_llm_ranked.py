import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from cases import EXTRA, SF, _EXTRA_ROW, edge_docs, rows_of, sf_docs

from tarmac.llm import ranked

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n_docs, total = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, tf, n in held:
            m = 10 + 90 * n * n_docs // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(terms(text)) if t in tf)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item_id, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def pairs(df, key):
    return [(r[key], r["text"]) for r in df.collect()]


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, *_EXTRA_ROW) for i, t in rows], "item_id long, text string, " + EXTRA)


@pytest.mark.parametrize("shard", [20, 20_000])
def test_documents(spark, monkeypatch, shard):
    monkeypatch.setattr(ranked, "SHARD_ROWS", shard)
    docs, items = sf_docs(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert sorted(rows_of(ranked.search(docs, items)), key=repr) == brute(pairs(docs, "doc_id"), pairs(items, "item_id"))


def test_edges(spark):
    items = [(1, "the CAT sat"), (1, "the CAT sat"), (2, None), (3, ""), (None, "Ende mit license"), (4, "größe é x1 'MIT'"),
             (5, "nowhere"), (6, "lorem " * 50_000)]
    got = sorted(rows_of(ranked.search(edge_docs(spark), items_of(spark, items))), key=repr)
    assert got == brute(pairs(edge_docs(spark), "doc_id"), items)
    assert {r[2] for r in got if r[0] == 1} >= {4, 5, 6, 15, None}


def test_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranked, "ITEM_BYTES", 30)
    items = [(i, f"the cat {i} sat on mat") for i in range(20)] + [(50, "the mat " * 30)]
    got = sorted(rows_of(ranked.search(edge_docs(spark), items_of(spark, items))), key=repr)
    assert got == brute(pairs(edge_docs(spark), "doc_id"), items)


def test_empty_tables(spark):
    items = [(1, "the cat")]
    assert rows_of(ranked.search(edge_docs(spark, []), items_of(spark, items))) == []
    assert rows_of(ranked.search(edge_docs(spark), items_of(spark, []))) == []
    assert rows_of(ranked.search(edge_docs(spark, [(1, None), (2, "!?")]), items_of(spark, items))) == []


def test_nra_equals_full_sums():
    rng = np.random.default_rng(4)
    for trial in range(300):
        n_docs, k = int(rng.integers(1, 400)), int(rng.integers(1, 12))
        lists, whole = [], np.zeros(n_docs, np.int64)
        for _ in range(int(rng.integers(1, 8))):
            doc = rng.permutation(n_docs)[:int(rng.integers(1, n_docs + 1))]
            impact = np.sort(rng.integers(1, rng.choice([3, 50, 10**6]), len(doc)))[::-1]
            lists.append((doc, impact))
            whole[doc] += impact
        doc, score = ranked.nra(lists, n_docs, k)
        assert (whole[doc] == score).all()
        kth = np.sort(whole)[::-1][:k].min()
        assert set(np.flatnonzero(whole >= max(kth, 1))) == set(doc.tolist()) or set(
            np.flatnonzero(whole >= max(kth, 1))) <= set(doc.tolist())


def test_nra_does_not_read_hopeless_documents():
    """One list decides: the tail of the others is read for few documents only."""
    class Counted(np.ndarray):
        pass

    n = 100_000
    best = np.arange(n), np.concatenate([np.full(10, 10**9), np.ones(n - 10)]).astype(np.int64)
    other = np.arange(n)[::-1], np.full(n, 5, np.int64)
    doc, score = ranked.nra([best, other], n, 10)
    assert sorted(doc.tolist()) == list(range(10)) and (score == 10**9 + 5).all()


def test_lengths_beyond_64_bits():
    n = np.array([10, 1 << 40])
    assert ranked.lengths(n, 1 << 30, 1 << 60).tolist() == [10 + 90 * x * (1 << 30) // (1 << 60) for x in n.tolist()]


def test_random_texts(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    docs = [(i % 90, " ".join(rng.choices(words, weights=[2 ** -(j / 4) for j in range(40)], k=rng.randint(0, 60))))
            for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 6)))) for i in range(15)]
    got = rows_of(ranked.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                                spark.createDataFrame(items, "item_id long, text string"), k=5))
    assert sorted(got, key=repr) == brute(docs, items, 5)
