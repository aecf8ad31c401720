"""Language identification: sparse multinomial logistic regression.

1. Features: character 1- to 3-grams of the lower-cased text, hashed into
   ``BUCKETS``; ASCII characters that are no letters count as spaces.  A text's
   vector holds (1 + ln count) * idf, scaled to length 1.
2. ``document_counts``: document frequencies over *all* documents that may be
   learned from, summed per bucket in two steps.
3. ``train``: follow-the-regularised-leader with per-coordinate rates and an
   elastic net (``L1``, ``L2``), so most weights stay exactly zero.  It sees a
   bounded sample of about ``SAMPLE_ROWS`` documents, as many of each language,
   picked by hash of id and text, one row per id, and in the order of the hash
   up to ``SAMPLE_BYTES`` of vectors; their whole texts are read.  Every language
   has a document in the sample, unless a text of another language shares its id
   (the driver holds a weight per bucket and language).
4. Calibration: a temperature, fitted on a fifth of the sample that training
   left out, divides the logits.
5. ``predict`` scores every document in one pass without a shuffle.

Edge cases: null text or a text without a letter is ``und`` with score 0, as is
every text when nothing can be learned; a very long text is read whole, a block
of characters at a time; equal probabilities go to the first language by name; a null doc_id is predicted, never
learned from, and not held out; repeated rows are predicted each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.common import first_bytes, materialize

BUCKETS = 1 << 16
SAMPLE_ROWS = 6000          # expected rows of the sample, the same number from each language
SAMPLE_BYTES = 256 << 20    # of the sample's vectors; the first in hash order are taken
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
BLOCK_CHARS = 1 << 19       # characters hashed at a time
PART_BUCKETS = 2048         # buckets per row while document counts are summed
PARTS = 256                 # task counts summed together in the first step
UNDETERMINED = "und"


def _fold_table() -> np.ndarray:
    t = np.arange(128, dtype=np.uint32)
    t[[c for c in range(128) if not chr(c).isalpha()]] = 32
    return t


_FOLD = _fold_table()


def gram_counts(text: str) -> np.ndarray:
    """Counts of the text's hashed 1- to 3-grams."""
    total = np.zeros(BUCKETS, np.int64)
    text = text.lower()
    for at in range(0, len(text), BLOCK_CHARS):
        # two more characters at the front, so that no gram is lost at a cut
        raw = text[max(0, at - 2):at + BLOCK_CHARS]
        c = np.frombuffer(raw.encode("utf-32-le", "replace"), "<u4")
        c = np.where(c < 128, _FOLD[np.minimum(c, 127)], c)
        new = min(at, 2)
        one = c * np.uint32(0x9E3779B1)
        grams = [one[new:] >> np.uint32(16)]
        if len(c) > 1:
            two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
            grams.append(two[max(0, new - 1):] >> np.uint32(16))
            if len(c) > 2:
                three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
                grams.append(three[max(0, new - 2):] >> np.uint32(16))
        total += np.bincount(np.concatenate(grams), minlength=BUCKETS)
    return total


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a text's TF-IDF vector of length 1."""
    counts = gram_counts(text)
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    return at, (x / max(1e-12, float(np.sqrt(x @ x)))).astype(np.float32)


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray,
                 temperature: float = 1.0):
        self.languages, self.idf, self.temperature = languages, idf, temperature
        self.weights, self.bias = weights, bias

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        p = softmax(self.logits(*vector(text, self.idf)) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = EPOCHS,
         seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by follow-the-regularised-leader with an elastic net;
    the bias (the last bucket) is not regularised."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == BUCKETS, 0.0, L1)[:, None]
        l2 = np.where(at == BUCKETS, 0.0, L2)[:, None]
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = np.r_[rows[i][0], BUCKETS], np.r_[rows[i][1], 1.0]
            w = weights(at)
            d = softmax(x @ w)
            d[labels[i]] -= 1
            g = x[:, None] * d
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1].astype(np.float32), w[-1].astype(np.float32)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Temperature of least log loss, by golden-section search over its log."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    a, b, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        if loss(c) <= loss(d):
            b = d
        else:
            a = c
    return float(np.exp((a + b) / 2))


def train(rows: list[tuple[np.ndarray, np.ndarray]], names: list[str], idf: np.ndarray) -> Model:
    languages = sorted(set(names))
    if not languages:
        return Model([], idf, np.zeros((BUCKETS, 0)), np.zeros(0))
    labels = np.array([languages.index(n) for n in names])
    check = np.arange(len(rows)) % 5 == 4
    keep = np.flatnonzero(~check)
    w, b = ftrl([rows[i] for i in keep], labels[keep], len(languages))
    model = Model(languages, idf, w, b)
    out = np.flatnonzero(check)
    if len(out):
        model.temperature = fit_temperature(np.array([model.logits(*rows[i]) for i in out]), labels[out])
    return model


# --- Spark --------------------------------------------------------------------------

def document_counts(docs: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """Number of documents and document frequency of every bucket."""
    schema = pa.schema([("part", pa.int64()), ("block", pa.int32()), ("n", pa.int64()), ("counts", pa.binary())])
    ddl = "part long, block int, n long, counts binary"

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in it:
            for text in batch.column(0).to_pylist():
                total += gram_counts(text or "") > 0
                n += 1
        if n:
            blocks = total.reshape(-1, PART_BUCKETS)
            part = TaskContext.get().partitionId() // PARTS
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(blocks)), pa.array(range(len(blocks)), pa.int32()),
                 pa.array([n] * len(blocks)), pa.array([b.tobytes() for b in blocks], pa.binary())], schema=schema)

    def add(key: tuple, t: pa.Table) -> pa.Table:
        counts = np.sum([np.frombuffer(b, np.int64) for b in t.column("counts").to_pylist()], axis=0)
        return pa.table([[key[-1].as_py() * 0], [key[0].as_py()], [pa.compute.sum(t.column("n")).as_py()],
                         [counts.tobytes()]], schema=schema)

    rows = (docs.select(F.col(text_col).cast("string")).mapInArrow(count, ddl)
            .groupBy("block", "part").applyInArrow(add, ddl)
            .groupBy("block").applyInArrow(add, ddl).collect())       # BUCKETS / PART_BUCKETS rows
    out = np.zeros((BUCKETS // PART_BUCKETS, PART_BUCKETS), np.int64)
    for r in rows:
        out[r["block"]] = np.frombuffer(r["counts"], np.int64)
    return (rows[0]["n"] if rows else 0), out.ravel()


def fit(docs: DataFrame, learn: Column, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang",
        sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model learned from the rows with a language for which ``learn`` holds."""
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()
                       & F.col(lang_col).isNotNull() & learn)
    n, df = document_counts(rows, text_col)
    idf = np.log((1 + n) / (1 + df)) + 1
    spark = docs.sparkSession
    span = 1 << 30
    at = F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")), F.lit(span))
    sizes = (rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("rows"), F.min(at).alias("first"))
             .orderBy("lang").collect())                       # one row per language
    if not sizes:
        return train([], [], idf)
    # at least the first row of each language
    below = spark.createDataFrame([(r["lang"], min(span, max(r["first"] + 1, span * sample_rows // (
        len(sizes) * r["rows"])))) for r in sizes], "lang string, below long")
    at = F.pmod(F.xxhash64("id", "text"), F.lit(span))
    picked = (rows.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"),
                          F.col(text_col).cast("string").alias("text"))
              .join(F.broadcast(below), "lang")               # one row per language
              .filter(at < F.col("below")).groupBy("id").agg(F.min(F.struct(at.alias("order"), "lang", "text")).alias("m"))
              .select("id", "m.order", "m.lang", "m.text"))
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    schema = pa.schema([("id", pa.int64()), ("order", pa.int64()), ("lang", pa.string()), ("at", pa.binary()),
                        ("x", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            got = [vector(t, shared.value) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([a.astype("<u2").tobytes() for a, _ in got], pa.binary()),
                 pa.array([x.astype("<f4").tobytes() for _, x in got], pa.binary())], schema=schema)

    vectors = materialize(picked.mapInArrow(run, "id long, order long, lang string, at binary, x binary"),
                          "langid-sample")
    sample = first_bytes(vectors, F.octet_length("at") + F.octet_length("x"), SAMPLE_BYTES)
    sample.sort(key=lambda r: (r["id"], r["lang"], r["at"]))
    return train([(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["x"], "<f4")) for r in sample],
                 [r["lang"] for r in sample], idf)


def predictor(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A column function: struct of lang_pred and score of a text column."""
    shared = spark.sparkContext.broadcast(model)

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            got = [shared.value.predict(t) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=["lang_pred", "score"])

    return F.arrow_udf(run, "lang_pred string, score double")


def predict(docs: DataFrame, model: Model, held_out: Column, text_col: str = "text",
            id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score per row of ``docs``."""
    of_text = predictor(docs.sparkSession, model)(F.col(text_col).cast("string"))
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.coalesce(held_out, F.lit(False)).alias("held_out"), of_text.alias("found"))
            .select("doc_id", "held_out", "found.lang_pred", "found.score"))
