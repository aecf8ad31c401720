import os

import numpy as np
import pytest
from cases import edge_docs, rows_of, sf_docs
from pyspark.sql import functions as F

from tarmac.llm import quality
from tarmac.llm.common import crc_bucket, read_table
from tarmac.llm.queries import score_quality

BIGGER = "/root/testdata/sf0.1"


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def plain_score(model, text):
    """Gated attention for one document, passage by passage."""
    rows = [np.clip((h - model.mean) / model.scale, -8, 8) for h in quality.encode_passages((text or "").encode())]
    p = model.p
    e = np.array([p["w"] @ (np.tanh(h @ p["V"]) * sigmoid(h @ p["U"])) for h in rows])
    a = np.exp(e - e.max())
    z = sum(w * h for w, h in zip(a / a.sum(), rows))
    return float(sigmoid(z @ p["c"] + p["b"]))


def test_scores_match_brute_force(spark):
    docs, labels = sf_docs(spark), read_table(spark, "/root/testdata/sf0.001", "labels")
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    model = quality.fit(docs, labels, ~held_out)
    got = {r.doc_id: r for r in quality.score(docs, model, held_out).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        assert got[r.doc_id].score == pytest.approx(plain_score(model, r.text), abs=1e-4)
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3)


def test_scores_do_not_use_other_columns_and_repeat(spark):
    docs, labels = sf_docs(spark), read_table(spark, "/root/testdata/sf0.001", "labels")
    a = sorted(rows_of(score_quality(docs, labels)))
    other = docs.select("doc_id", "text", F.lit("xx").alias("lang"), F.lit(None).cast("string").alias("source"))
    assert sorted(rows_of(score_quality(other.repartition(3), labels))) == a


@pytest.mark.skipif(not os.path.isdir(BIGGER), reason="test data not present")
def test_held_out_accuracy(spark):
    docs, labels = read_table(spark, BIGGER, "documents"), read_table(spark, BIGGER, "labels")
    rows = score_quality(docs, labels).filter("held_out").join(labels, "doc_id").select("quality", "predicted").collect()
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert len(bad) > 50
    assert sum(r.predicted == 1 for r in good) >= 0.98 * len(good)
    assert sum(r.predicted == 0 for r in bad) >= 0.9 * len(bad)


def test_edges_empty_and_one_class(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 1, 0), (5, None, 0), (None, 0, 0), (9, 0, 0), (14, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    rows = score_quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert {r.score for r in score_quality(docs, labels.filter("quality = 1")).collect()} == {1.0}
    assert {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert rows_of(score_quality(edge_docs(spark, []), labels)) == []


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    model = quality.AttentionModel(0, 1, {
        "V": rng.normal(size=(quality.DIM, 3)) * .2, "U": rng.normal(size=(quality.DIM, 3)) * .2,
        "w": rng.normal(size=3), "c": rng.normal(size=quality.DIM) * .2, "b": np.float64(0.1)})
    x, first, y = rng.normal(size=(9, quality.DIM)), np.array([0, 4, 5]), np.array([1., 0., 1.])

    def loss():
        p = model.forward(x, first)["y"]
        reg = sum((model.p[k] ** 2).sum() for k in ("V", "U", "w", "c")) * quality.DECAY / 2
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + reg

    g = model.gradients(x, first, y)
    for k, at in (("V", (5, 1)), ("U", (7, 2)), ("w", (0,)), ("c", (11,))):
        keep, eps = model.p[k][at], 1e-5
        model.p[k][at] = keep + eps
        up = loss()
        model.p[k][at] = keep - eps
        down = loss()
        model.p[k][at] = keep
        assert g[k][at] == pytest.approx((up - down) / (2 * eps), rel=1e-3, abs=1e-7)


def test_passages_cover_whole_texts(monkeypatch):
    text = b"word " * 1000 + b"\nEND!!"
    assert len(quality.encode_passages(text)) == 11
    monkeypatch.setattr(quality, "SEGMENT_BYTES", 997)
    assert b"".join(quality._segments(text)) == text
    assert b"".join(quality._segments(b"x" * 5000)) == b"x" * 5000


def test_sample_keeps_one_text_of_an_id_in_a_defined_order(spark):
    rows = [(i % 20, f"text {i} of many words " * (1 + i % 3)) for i in range(200)]
    docs = spark.createDataFrame(rows + rows[:50], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    got = [quality.labelled_sample(docs.repartition(n), labels.repartition(n), "text", "doc_id", "quality", 30)
           for n in (1, 4)]
    assert len(got[0][0]) == len(got[1][0]) <= 20
    assert all(np.array_equal(a, b) for a, b in zip(got[0][0], got[1][0])) and (got[0][1] == got[1][1]).all()
