"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (``PASSAGE_WORDS`` words each; the whole text,
cut anew every ``SEGMENT_BYTES`` so that memory stays bounded).

1. ``encode_passages`` turns every passage into a vector: shares of character
   classes, word shape, words and lines that repeat, and a hashed histogram of
   byte pairs (square roots of shares).
2. ``train`` learns, from document labels alone, gated attention weights
   ``a_k ~ exp(w . (tanh(V h_k) * sigmoid(U h_k)))`` over a bag and a logistic
   score of the weighted representation ``sum_k a_k h_k``, by Adam on the mean
   log loss.  It sees a bounded sample of labelled documents (``TRAIN_ROWS``,
   picked by hash of the id); their whole texts are read.
3. ``score`` encodes and scores every document in one pass without a shuffle.

Edge cases: null or empty text is a bag of one empty passage; a null doc_id is
scored, never learned from, and not held out; a doc_id with several labels
learns from the largest; without labels of both classes the score is their
share (0.5 without labels); repeated rows are scored each; a very long text is a
bag of all its passages; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from operator import eq
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.common import first_bytes, hash_sample, materialize, utf8_rows

PASSAGE_WORDS = 100
SEGMENT_BYTES = 1 << 20
TRAIN_ROWS = 6000           # bound of the labelled sample
TRAIN_BYTES = 256 << 20     # of its passages; the first ids in hash order are taken
PAIR_BUCKETS = 96
HIDDEN = 24
EPOCHS = 30
BATCH_BAGS = 128
RATE = 5e-3
DECAY = 1e-4
THRESHOLD = 0.3

_CLASSES = ("upper", "lower", "digit", "space", "newline", "stop", "symbol", "high")


def _class_table() -> np.ndarray:
    t = np.full(256, _CLASSES.index("symbol"), np.uint8)
    for name, chars in (("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)),
                        ("space", b" \t\r\v\f"), ("newline", b"\n"), ("stop", b".,;:!?'\"()-"),
                        ("high", range(128, 256))):
        t[list(chars)] = _CLASSES.index(name)
    return t


_CLASS = _class_table()
_STATS = 11
DIM = len(_CLASSES) + _STATS + PAIR_BUCKETS


def _segments(text: bytes) -> Iterator[bytes]:
    """Parts of at most SEGMENT_BYTES, cut at white space where there is any."""
    at = 0
    while len(text) - at > SEGMENT_BYTES:
        cut = max(text.rfind(b" ", at, at + SEGMENT_BYTES), text.rfind(b"\n", at, at + SEGMENT_BYTES))
        cut = at + SEGMENT_BYTES if cut <= at else cut + 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def _line_share(text: bytes) -> float:
    """Distinct share of the text's lines."""
    lines = text.split(b"\n")
    return len(set(lines)) / len(lines)


def encode_passages(text: bytes | None) -> np.ndarray:
    """One row per passage of a UTF-8 text."""
    text = text or b""
    lines = _line_share(text)
    return np.concatenate([_encode_segment(s, lines) for s in _segments(text)])


def _encode_segment(text: bytes, lines: float) -> np.ndarray:
    words = text.split()
    n = max(1, -(-len(words) // PASSAGE_WORDS))
    out = np.zeros((n, DIM), np.float32)
    if not words:
        return out
    b = np.frombuffer(text, np.uint8)
    kind = _CLASS[b]
    blank = (kind == _CLASSES.index("space")) | (kind == _CLASSES.index("newline"))
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    first = np.r_[0, starts[PASSAGE_WORDS::PASSAGE_WORDS]][:n]
    size = np.diff(np.r_[first, len(b)])
    passage = np.repeat(np.arange(n), size)
    shares = np.bincount(passage * len(_CLASSES) + kind, minlength=n * len(_CLASSES))
    shares = shares.reshape(n, -1) / size[:, None]
    pair = (b[:-1].astype(np.int32) * 31 + b[1:]) % PAIR_BUCKETS
    pairs = np.bincount(passage[:-1] * PAIR_BUCKETS + pair, minlength=n * PAIR_BUCKETS).reshape(n, -1)
    out[:, :len(_CLASSES)] = shares
    out[:, len(_CLASSES) + _STATS:] = np.sqrt(pairs / np.maximum(1, size - 1)[:, None])
    stat = out[:, len(_CLASSES):len(_CLASSES) + _STATS]
    for k in range(n):
        part = words[k * PASSAGE_WORDS:(k + 1) * PASSAGE_WORDS]
        stat[k, 0] = len(set(part)) / len(part)
        stat[k, 1] = len(part) / PASSAGE_WORDS
        stat[k, 2] = sum(map(len, part)) / len(part) / 10
        again = sum(map(eq, part, part[1:])) / len(part)
        stat[k, 8], stat[k, 9] = again, np.sqrt(again)
        stat[k, 10] = part.count(b"|") / len(part)
    stat[:, 3] = lines
    letters = shares[:, 0] + shares[:, 1]
    stat[:, 4] = shares[:, 0] / np.maximum(letters, 1e-3)
    stat[:, 5] = np.log1p(size / np.maximum(1, shares[:, _CLASSES.index("newline")] * size)) / 8
    stat[:, 6] = np.sqrt(shares[:, _CLASSES.index("symbol")])
    stat[:, 7] = np.sqrt(shares[:, _CLASSES.index("digit")])
    return out


# --- the model --------------------------------------------------------------------

def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Gated attention over a bag's passages and a logistic score."""

    NAMES = ("V", "U", "w", "c", "b")

    def __init__(self, mean, scale, params: dict):
        self.mean, self.scale, self.p = mean, scale, params

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        """x: standardised passages of all bags; first: first passage per bag."""
        p = self.p
        t, g = np.tanh(x @ p["V"]), _sigmoid(x @ p["U"])
        e = (t * g) @ p["w"]
        n = np.diff(np.r_[first, len(x)])
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, first), n))
        a /= np.repeat(np.add.reduceat(a, first), n)
        z = np.add.reduceat(a[:, None] * x, first, axis=0)
        return {"t": t, "g": g, "a": a, "z": z, "n": n, "y": _sigmoid(z @ p["c"] + p["b"])}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        x = np.clip((np.concatenate(bags) - self.mean) / self.scale, -8, 8)
        first = np.cumsum([0] + [len(b) for b in bags[:-1]])
        return self.forward(x, first)["y"]

    def gradients(self, x: np.ndarray, first: np.ndarray, labels: np.ndarray) -> dict:
        p, f = self.p, self.forward(x, first)
        d = (f["y"] - labels) / len(labels)
        per = np.repeat(np.arange(len(labels)), f["n"])
        # through the weighted sum to the attention logits
        hc = x @ p["c"]
        de = f["a"] * d[per] * (hc - (f["z"] @ p["c"])[per])
        dtg = de[:, None] * p["w"]
        dv = x.T @ (dtg * f["g"] * (1 - f["t"] ** 2))
        du = x.T @ (dtg * f["t"] * f["g"] * (1 - f["g"]))
        return {"V": dv + DECAY * p["V"], "U": du + DECAY * p["U"], "w": (f["t"] * f["g"]).T @ de + DECAY * p["w"],
                "c": f["z"].T @ d + DECAY * p["c"], "b": d.sum()}


class Constant:
    """The score when the labels hold no two classes."""

    def __init__(self, value: float):
        self.value = value

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        return np.full(len(bags), self.value)


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7):
    """Fit the model to bags with labels 0 or 1."""
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        return Constant(float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 1e-3
    flat = [np.clip((b - mean) / scale, -8, 8).astype(np.float32) for b in bags]
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    model = AttentionModel(mean, scale, {"V": draw(DIM, HIDDEN), "U": draw(DIM, HIDDEN), "w": draw(HIDDEN),
                                         "c": np.zeros(DIM, np.float32), "b": np.float32(0)})
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(flat))
        rate = RATE * (1 - epoch / epochs) + 1e-4
        for at in range(0, len(order), BATCH_BAGS):
            rows = order[at:at + BATCH_BAGS]
            x = np.concatenate([flat[i] for i in rows])
            first = np.cumsum([0] + [len(flat[i]) for i in rows[:-1]])
            step += 1
            for k, g in model.gradients(x, first, labels[rows]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                model.p[k] = model.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


# --- Spark --------------------------------------------------------------------------

def labelled_sample(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str,
                    label_col: str, train_rows: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Bags and labels of at most ``train_rows`` labelled ids, picked by hash, and
    of at most ``TRAIN_BYTES`` in the order of the hash.  Of the texts that share
    an id the one with the smallest hash counts."""
    known = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
             .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).alias("label")))
    known = materialize(known, "quality-labels")
    picked = hash_sample(known, F.xxhash64("id"), known.count(), train_rows)
    texts = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
             .join(F.broadcast(picked), "id").groupBy("id")
             .agg(F.max("label").alias("label"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m"))
             .select("id", F.xxhash64("id").alias("order"), "label", "m.text"))
    out = pa.schema([("id", pa.int64()), ("order", pa.int64()), ("label", pa.int32()), ("bag", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            bags = [encode_passages(t).astype("<f4").tobytes() for t in utf8_rows(batch.column(3))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2).cast(pa.int32()), pa.array(bags, pa.binary())], schema=out)

    bags = materialize(texts.mapInArrow(run, "id long, order long, label int, bag binary"), "quality-bags")
    rows = first_bytes(bags, F.octet_length("bag"), TRAIN_BYTES)
    rows.sort(key=lambda r: r["id"])
    return ([np.frombuffer(r["bag"], "<f4").reshape(-1, DIM) for r in rows],
            np.array([r["label"] for r in rows]))


def scorer(spark: SparkSession, model) -> Callable[[Column], Column]:
    """A column function: the model's score of a text column."""
    shared = spark.sparkContext.broadcast(model)

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            yield pa.array([shared.value.score([encode_passages(t)])[0] for t in utf8_rows(texts)], pa.float64())

    return F.arrow_udf(run, "double")


def score(docs: DataFrame, model, held_out: Column, threshold: float = THRESHOLD, text_col: str = "text",
          id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``."""
    of_text = scorer(docs.sparkSession, model)(F.col(text_col).cast("string"))
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.coalesce(held_out, F.lit(False)).alias("held_out"), of_text.alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, text_col: str = "text", id_col: str = "doc_id",
        label_col: str = "quality", train_rows: int = TRAIN_ROWS):
    """A model learned from the ``labels`` rows for which ``learn`` holds."""
    return train(*labelled_sample(docs, labels.filter(learn), text_col, id_col, label_col, train_rows))
