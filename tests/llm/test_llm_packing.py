import itertools
import random
import zlib

import numpy as np
import pytest
from cases import edge_docs, rows_of, sf_docs

from tarmac.llm import packing
from tarmac.llm.words import default_vocab, load_tokenizer

TOK = load_tokenizer(default_vocab())


def plain_pieces(docs, capacity=4096):
    out = []
    for doc_id, text in docs:
        ids = TOK.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            part = ids[k:k + capacity]
            out.append((doc_id, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=repr)


def check_layout(rows, capacity):
    """Every sequence is gapless from 0 and within capacity; returns their number."""
    bins = {}
    for *_, length, _crc, seq, offset in rows:
        bins.setdefault(seq, []).append((offset, length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def first_fit_decreasing(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        for i, room in enumerate(bins):
            if n <= room:
                bins[i] -= n
                break
        else:
            bins.append(capacity - n)
    return len(bins)


def optimum(lengths, capacity):
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if lengths[i] <= room:
                rest = list(rooms)
                rest.remove(room)
                place(i + 1, [*rest, room - lengths[i]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best[0]


@pytest.mark.parametrize("make,capacity", [(sf_docs, 4096), (edge_docs, 4096), (sf_docs, 100)])
def test_pieces_and_layout(spark, make, capacity):
    docs = make(spark)
    rows = rows_of(packing.pack(docs, capacity=capacity))
    assert sorted((r[:5] for r in rows), key=repr) == plain_pieces([(r.doc_id, r.text) for r in docs.collect()], capacity)
    lengths = [r[3] for r in rows]
    n = check_layout(rows, capacity)
    assert -(-sum(lengths) // capacity) <= n <= first_fit_decreasing(lengths, capacity)


def test_hot_length_over_many_groups(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(3000)], "doc_id long, text string").repartition(5)
    rows = rows_of(packing.pack(docs))
    assert len(rows) == 3000 and len({(r[5], r[6]) for r in rows}) == 3000
    assert check_layout(rows, 4096) == -(-3000 * 4 // 4096)


def test_empty_table(spark):
    assert rows_of(packing.pack(edge_docs(spark, []))) == []


def _counts(lengths):
    return {n: lengths.count(n) for n in set(lengths)}


def _expand(bins):
    return [[n for n, per in pattern for _ in range(per)] for pattern, times in bins for _ in range(times)]


def test_plan_packs_every_piece_once():
    rng = random.Random(5)
    for _ in range(200):
        capacity = rng.choice([10, 50, 1000])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        bins = _expand(packing.plan(_counts(lengths), capacity))
        assert all(0 < sum(b) <= capacity for b in bins)
        assert sorted(itertools.chain(*bins)) == sorted(lengths)
        assert len(bins) <= first_fit_decreasing(lengths, capacity)


def test_reduction_keeps_the_optimum():
    """What is fixed plus an optimal packing of the rest is an optimal packing."""
    rng = random.Random(9)
    fixed_any = 0
    for _ in range(300):
        capacity = rng.choice([10, 20, 30])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        left = packing._Lengths(_counts(lengths))
        fixed = _expand(packing.reduce_instance(left, capacity))
        rest = [n for n, k in left.n.items() for _ in range(k)]
        fixed_any += bool(fixed)
        assert sorted([*itertools.chain(*fixed), *rest]) == sorted(lengths)
        assert len(fixed) + optimum(rest, capacity) == optimum(lengths, capacity)
    assert fixed_any > 200
