import random

import numpy as np
import pytest
import xxhash
from cases import edge_docs, rows_of, sf_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from tarmac.llm import simhash


def plain_fingerprint(text, n=3, seed=42):
    words = [w for w in (text or "").encode().lower().split() if w]
    if not words:
        return 0
    grams = [b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g, seed) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, bits=3):
    """doc rows (id, fingerprint) -> component id per row, by comparing all pairs."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= bits:
                parent[find(a)] = find(b)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[find(i)] = min(low.get(find(i), doc_id), doc_id)
    return [low.get(find(i)) for i in range(len(rows))]


def expected(docs):
    rows = [(d, plain_fingerprint(t)) for d, t in docs]
    return sorted(((d, f"{f:016x}", c) for (d, f), c in zip(rows, plain_components(rows))), key=repr)


def test_whole_table_matches_brute_force(spark):
    docs = sf_docs(spark)
    got = sorted(rows_of(simhash.near_duplicate_groups(docs)), key=repr)
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_edges(spark):
    docs = edge_docs(spark)
    got = sorted(rows_of(simhash.near_duplicate_groups(docs)), key=repr)
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark):
    assert rows_of(simhash.near_duplicate_groups(edge_docs(spark, []))) == []


@pytest.mark.parametrize("node_rows", [1, 7, 2048])
def test_links_connect_all_close_pairs(spark, node_rows):
    """Dense clusters, cut into blocks or not, give the same components."""
    rng = random.Random(3)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(30):
            f = centre
            for _ in range(rng.randrange(7)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    nodes = spark.createDataFrame(signed, "fp long, min_id long")
    found = simhash.components(nodes, simhash.linked(nodes, 3, node_rows))
    got = {i: i for i in range(len(fps))}
    at = dict(signed)
    got.update({at[f]: c for f, c in rows_of(found)})
    assert [got[i] for i in range(len(fps))] == plain_components(list(enumerate(fps)))


def test_long_chain_is_one_component(spark):
    f, fps = 0, []
    for i in range(60):
        f ^= 0b111 << i if i < 62 else 0
        fps.append(f)
    order = list(range(60))
    random.Random(1).shuffle(order)
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, order[i]) for i, x in enumerate(fps)],
                                  "fp long, min_id long")
    found = rows_of(simhash.components(nodes, simhash.linked(nodes)))
    assert len(found) == 60 and {c for _, c in found} == {0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, (1 << 64) - 1), st.integers(0, 9)), max_size=60),
       st.integers(0, 5))
def test_index_finds_exactly_the_close_pairs(rows, bits):
    """(unit, base pattern, flipped bit) rows against all pairs."""
    unit = np.array(sorted(u for u, _, _ in rows), np.int64)
    if len(unit):
        unit = np.unique(unit, return_inverse=True)[1]
    fps = np.array([(b & 0xFF00) | (1 << f) for _, b, f in rows], np.uint64)
    order = np.lexsort((simhash.gray_rank(fps), unit))
    fps = fps[order]
    got = set()
    for a, b in simhash.GrayIndex(unit, fps).pairs(bits, unit):
        got |= set(zip(a.tolist(), b.tolist()))
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps))
            if unit[i] == unit[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= bits}
    assert got == want


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
def test_stars(links):
    a, b = (np.array([x[i] for x in links], np.int64) for i in (0, 1))
    parent = list(range(31))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in links:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    assert simhash.stars(a, b, 31).tolist() == [find(i) for i in range(31)]
