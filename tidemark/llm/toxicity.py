"""Toxicity scores by FTRL-proximal logistic regression.

Features are hashed word n-grams (one and two words) and skip-grams (two words with one
between). Per-coordinate learning rates and an L1 term leave few non-zero weights, which
travel to the scoring tasks as a broadcast. Training uses a sample of the labelled rows
bounded by ``max_train`` (rows with the smallest hash of their id); scoring covers all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import U64, alnum_words, lean_worker, mix64, prefix_hash, span_hash

BITS = 20
MAX_TRAIN = 8192
EPOCHS = 10
#: Bytes of a word's head that also count as its unigram.
STEMS = (4, 6, 8)
#: FTRL-proximal: learning rate, smoothing, L1, L2.
RATE, SMOOTH, L1, L2 = 1.0, 1.0, 10.0, 0.1


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Distinct feature numbers of a text, sorted; none for null, empty and word-less texts."""
    data = b" ".join(alnum_words(text))
    if not data:
        return np.empty(0, np.int32)
    raw = np.frombuffer(data, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
    prefix = prefix_hash(raw)
    h = span_hash(prefix, starts, ends)
    parts = [h, mix64(h[:-1] * U64(3) + h[1:]), mix64(h[:-2] * U64(5) + h[2:])]
    for n in STEMS:                       # the head of each longer word, so that inflected forms share weight
        long = ends - starts > n
        parts.append(mix64(span_hash(prefix, starts[long], starts[long] + n) + U64(7)))
    return np.unique((np.concatenate(parts) >> U64(64 - bits)).astype(np.int32))


class Ftrl:
    """Weights of a logistic regression over binary features; the last coordinate is the bias."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == len(self.z) - 1, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((SMOOTH + np.sqrt(n)) / RATE + L2))

    def learn(self, x: np.ndarray, y: float) -> None:
        at = np.append(x, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / RATE * w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_train: int = MAX_TRAIN, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero coordinates and their weights (coordinate 2**bits is the bias).

    Null labels are left out; an id labelled twice is toxic if any label says so. Without
    labelled rows there are no weights and every score is 0.5. At most ``max_train`` ids are
    used (broadcast: 16 bytes each); their feature numbers, not their texts, meet in one task."""
    ids = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("double").alias("_y"))
           .orderBy(F.xxhash64(id_col), id_col).limit(max_train))
    rows = docs.select(id_col, F.col(text_col).alias("_text")).join(F.broadcast(ids), id_col)

    def extract(batches):
        lean_worker()
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([features(t, bits) for t in b.column(2).to_pylist()], pa.list_(pa.int32()))],
                ["k", "y", "x"])

    feats = rows.select(F.xxhash64(id_col).alias("k"), "_y", "_text").mapInArrow(extract, "k long, y double, x array<int>")

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        lean_worker()
        pdf = pdf.sort_values("k", kind="stable").drop_duplicates("k")
        model = Ftrl(bits)
        for _ in range(EPOCHS):
            for x, y in zip(pdf["x"], pdf["y"]):
                model.learn(np.asarray(x, np.int64), y)
        w = model.weights(np.arange(len(model.z)))
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": at.astype(np.int64), "w": w[at]})

    got = feats.groupBy(F.lit(0).alias("one")).applyInPandas(train, "at long, w double").toPandas().sort_values("at")
    return got["at"].to_numpy(np.int64), got["w"].to_numpy(float)


def scorer(model, bits: int = BITS):
    """Function text -> score; the model is expanded once per task."""
    w = np.zeros((1 << bits) + 1)
    w[model[0]] = model[1]
    return lambda t: float(1 / (1 + np.exp(-np.clip(w[features(t, bits)].sum() + w[-1], -35, 35))))


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and ``score``. Null and empty texts get the bias' score; only
    the two columns are read; an empty table gives none. No shuffle."""
    share = docs.sparkSession.sparkContext.broadcast(model)       # 16 bytes for each of 2**BITS weights at most
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        lean_worker()
        f = scorer(share.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f(t) for t in b.column(1).to_pylist()], pa.float64())], [id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, score double")


def reject(docs: DataFrame, model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``limit`` or more."""
    share = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        lean_worker()
        f = scorer(share.value)
        for b in batches:
            yield b.filter(pa.array([f(t) < limit for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted; learnt only from labels outside the held-out fifth."""
    model = fit(docs, labels.where(~F.coalesce(held_out(id_col), F.lit(True))), id_col)
    return score(docs, model, id_col).select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score",
                                             (F.col("score") >= 0.5).cast("int").alias("predicted"))
