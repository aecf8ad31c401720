import random
import zlib

import numpy as np
import pytest
from cases import edge_docs, rows_of, sf_docs

from tarmac.llm import mixture
from tarmac.llm.words import default_vocab, load_tokenizer

TOK = load_tokenizer(default_vocab())


def library_ids(text, end=2):
    return TOK.encode(text or "", add_special_tokens=False).ids + [end]


def round_robin(tokens, shares, window, packet):
    """The stream (queue, token) of deficit round-robin, packet by packet."""
    rounds = mixture.Rounds(tokens, shares, window, packet)
    deficit, sent, stream = rounds.first.tolist(), [0] * len(tokens), []
    while sent != tokens:
        for q, n in enumerate(tokens):
            if sent[q] == n:
                continue
            deficit[q] += int(rounds.quantum[q])
            while deficit[q] >= packet * mixture.UNIT and sent[q] < n:
                deficit[q] -= packet * mixture.UNIT
                size = min(packet, n - sent[q])
                stream += [(q, sent[q] + i) for i in range(size)]
                sent[q] += size
    return rounds, stream


@pytest.mark.parametrize("seed", range(12))
def test_rounds_equal_the_loop(seed):
    rng = random.Random(seed)
    tokens = [rng.choice([1, 5, 60, 300, 900]) for _ in range(rng.randint(1, 6))]
    shares = [t / sum(tokens) if seed % 2 else rng.uniform(.01, 1) for t in tokens]
    capacity, packet = rng.choice([(16, 1), (64, 4), (128, 7), (32, 50)])
    rounds, stream = round_robin(tokens, shares, capacity, packet)
    first, n, queue = [], [], []
    for q, t in enumerate(tokens):
        at = 0
        while at < t:
            size = min(t - at, rng.randint(1, 80))
            first.append(at), n.append(size), queue.append(q)
            at += size
    first, n, queue = map(np.array, (first, n, queue))
    doc, start, length, seq, offset = mixture.cut(rounds, first, n, queue, capacity)
    full, rest = mixture.sequence_starts(len(stream), capacity)
    begins = [i * capacity for i in range(full)] + rest
    got = {}
    for d, s, size, sq, off in zip(doc, start, length, seq, offset):
        for i in range(size):
            got[begins[sq] + off + i] = (queue[d], first[d] + s + i)
        assert off + size <= begins[sq + 1] - begins[sq]
    assert [got[i] for i in range(len(stream))] == stream


def check(rows, docs, capacity):
    """Every id in one piece, sequences gapless and full or a power of two long."""
    ids = {}
    for d, t in docs:
        ids.setdefault(d, []).append(library_ids(t))
    seqs, covered = {}, {}
    for d, start, length, crc, n, seq, offset in rows:
        texts = [x for x in ids[d] if len(x) == n and
                 zlib.crc32(np.array(x[start:start + length], "<u4").tobytes()) == crc]
        assert texts and length > 0
        seqs.setdefault(seq, []).append((offset, length))
        covered.setdefault((d, n), []).append((start, length))
    for (d, n), parts in covered.items():
        copies = sum(len(x) == n for x in ids[d])
        count = np.zeros(n, int)
        for s, size in parts:
            count[s:s + size] += 1
        assert (count == copies).all()
    assert sum(r[2] for r in rows) == sum(len(x) for same in ids.values() for x in same)
    short = 0
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
        short += at != capacity
    assert short <= capacity.bit_length()


@pytest.mark.parametrize("make,capacity", [(sf_docs, 4096), (edge_docs, 4096), (sf_docs, 128)])
def test_pieces(spark, monkeypatch, make, capacity):
    monkeypatch.setattr(mixture, "CHUNK_TOKENS", 5000)
    docs = make(spark)
    rows = rows_of(mixture.pack(docs.repartition(3), capacity=capacity))
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], capacity)


def shares_by_window(rows, docs, capacity, window):
    source = {r.doc_id: r.source for r in docs.collect()}
    out = {}
    for d, _s, length, _c, _n, seq, _o in rows:
        w = out.setdefault(seq * capacity // window, {})
        w[source[d]] = w.get(source[d], 0) + length
    return out


def test_every_window_holds_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixture, "CHUNK_TOKENS", 20_000)
    docs = sf_docs(spark).repartition(4)
    rows = rows_of(mixture.pack(docs))
    per = shares_by_window(rows, docs, 4096, 4096)
    total = {}
    for w in per.values():
        for s, n in w.items():
            total[s] = total.get(s, 0) + n
    whole = sum(total.values())
    last = max(per)
    for w, held in per.items():
        if w < last - 12:               # the full sequences
            for s, n in total.items():
                assert abs(held.get(s, 0) - 4096 * n / whole) <= 3 * mixture.PACKET


def test_targets_until_a_queue_runs_dry(spark):
    docs = spark.createDataFrame([(i, "a " * 63, f"s{i % 3}") for i in range(600)],
                                 "doc_id long, text string, source string")
    rows = rows_of(mixture.pack(docs, targets={"s0": .5, "s1": .25, "s2": .25}, capacity=512))
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], 512)
    per = shares_by_window(rows, docs, 512, 512)
    for w in range(40):                 # s0 has 12,800 of 38,400 tokens, enough for 50 sequences at one half
        assert abs(per[w].get("s0", 0) - 256) <= 2 * mixture.PACKET
    assert "s0" not in per[60]


def test_sources_beyond_the_queues_share_one(spark, monkeypatch):
    monkeypatch.setattr(mixture, "MAX_QUEUES", 4)
    docs = spark.createDataFrame([(i, "a b c", None if i % 9 == 0 else f"s{i % 9}") for i in range(300)],
                                 "doc_id long, text string, source string")
    check(rows_of(mixture.pack(docs, capacity=64)), [(r.doc_id, r.text) for r in docs.collect()], 64)


def test_empty_table(spark):
    assert rows_of(mixture.pack(edge_docs(spark, []))) == []


def test_one_queue_without_a_source_column(spark):
    docs = spark.createDataFrame([(i, "x y") for i in range(100)], "doc_id long, text string")
    check(rows_of(mixture.pack(docs, capacity=32, source_col=None)), [(i, "x y") for i in range(100)], 32)
