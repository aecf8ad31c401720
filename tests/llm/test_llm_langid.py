import os
import random

import numpy as np
import pytest
from cases import edge_docs, rows_of, sf_docs
from pyspark.sql import functions as F

from tarmac.llm import langid
from tarmac.llm.common import crc_bucket, read_table
from tarmac.llm.queries import predict_language

BIGGER = "/root/testdata/sf0.01"


def plain_grams(text):
    """Counts of hashed grams, character by character."""
    text = "".join(c if ord(c) >= 128 or c.isalpha() else " " for c in text.lower())
    out = np.zeros(langid.BUCKETS, np.int64)
    m = (1 << 32) - 1
    for i, c in enumerate(map(ord, text)):
        one = c * 0x9E3779B1 & m
        out[one >> 16] += 1
        if i + 1 < len(text):
            two = (one ^ ord(text[i + 1]) * 0x85EBCA77 & m) * 0xC2B2AE3D & m
            out[two >> 16] += 1
            if i + 2 < len(text):
                out[((two ^ ord(text[i + 2]) * 0x27D4EB2F & m) * 0x165667B1 & m) >> 16] += 1
    return out


@pytest.mark.parametrize("block", [3, 7, 1 << 19])
def test_gram_counts(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK_CHARS", block)
    for text in ("", "a", "ab", "Größe, 12 Ça va?", "x" * 20, "𝒳y z"):
        assert (langid.gram_counts(text) == plain_grams(text)).all()


def test_document_counts_cover_all_rows(spark):
    docs = sf_docs(spark).repartition(5)
    n, df = langid.document_counts(docs, "text")
    want = sum((plain_grams(r.text or "") > 0).astype(int) for r in docs.collect())
    assert n == docs.count() and (df == want).all()


def test_predictions_match_brute_force(spark):
    docs = sf_docs(spark)
    held_out = crc_bucket(F.col("doc_id"), 3) == 1
    model = langid.fit(docs, ~held_out)
    got = {r.doc_id: r for r in langid.predict(docs, model, held_out).collect()}
    for r in docs.collect():
        counts = plain_grams(r.text or "")
        x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * model.idf
        p = langid.softmax((x / np.linalg.norm(x)) @ model.weights / model.temperature + model.bias / model.temperature)
        assert got[r.doc_id].lang_pred == model.languages[int(p.argmax())]
        assert got[r.doc_id].score == pytest.approx(float(p.max()), abs=1e-4)
    assert (model.weights == 0).mean() > 0.3          # the elastic net keeps the model sparse


@pytest.mark.skipif(not os.path.isdir(BIGGER), reason="test data not present")
def test_held_out_accuracy(spark):
    docs = read_table(spark, BIGGER, "documents")
    rows = predict_language(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 250
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.98 * len(rows)


def test_edges_and_empty(spark):
    docs = edge_docs(spark)
    rows = predict_language(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id in (1, 2, 3, 13):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        assert 0 <= r.score <= 1 and (r.doc_id is not None or not r.held_out)
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in predict_language(unknown).collect()} == {"und"}
    assert rows_of(predict_language(edge_docs(spark, []))) == []


def test_temperature_calibrates():
    rng = np.random.default_rng(3)
    logits = rng.normal(size=(4000, 3)) * 2
    labels = np.array([rng.choice(3, p=langid.softmax(x)) for x in logits])
    assert langid.fit_temperature(logits * 5, labels) == pytest.approx(5, rel=0.15)


def test_every_language_is_learned_from_a_sample_of_any_partitioning(spark, monkeypatch):
    """More languages than the sample has rows for, ids that several texts share."""
    rng = random.Random(6)
    rows = [(i, "".join(rng.choices("abcdefgh" + chr(0x100 + k), k=30)), f"l{k:02d}") for i, k in
            ((i, i % 60) for i in range(300))]
    rows += [(i, "another text", "l00") for i in range(20)]
    docs = spark.createDataFrame(rows + rows[:40] * 5, "doc_id long, text string, lang string")
    models = [langid.fit(docs.repartition(n), F.lit(True), sample_rows=30) for n in (1, 5)]
    assert models[0].languages == models[1].languages and len(models[0].languages) >= 55
    assert np.array_equal(models[0].weights, models[1].weights)


def test_sample_bytes(spark, monkeypatch):
    from tarmac.llm.common import first_bytes
    rows = spark.createDataFrame([(i, 1000 - i, b"x" * 10) for i in range(100)], "id long, order long, x binary")
    assert [r["id"] for r in sorted(first_bytes(rows, F.octet_length("x"), 35), key=lambda r: r["order"])] == [99, 98, 97]
    assert len(first_bytes(rows, F.octet_length("x"), 1)) == 1 and first_bytes(rows.filter("false"), F.lit(1), 9) == []
