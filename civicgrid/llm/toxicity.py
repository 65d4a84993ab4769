"""Toxicity by FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

A text's features are the different words, pairs of neighbours and pairs with one
word between them, hashed to ``BITS`` bits. Each coordinate has a learning rate of
its own; the L1 term leaves few weights, which go to the executors.

Fitting takes the first ``MAX_TRAIN`` labelled documents by a hash of the id, in
that order, ``EPOCHS`` times, in one task; only the weights leave it. Scoring
reads whole texts of all documents.

A null or empty text has only the bias for a score. Rows of a null label or id
don't teach; repeated labels and documents teach as often as they occur, within
the bound. Without labels every score is 0.5 less a hair, predicted 0. An empty
table gives no rows. Only the named columns are read, so further columns can't
clash.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicgrid.llm.common import BASE, WordBatch, add_by_text, chunks, mix, ready

MAX_TRAIN = 8000
EPOCHS = 5
BITS = 20
#: The bias where nothing was learned.
UNSURE = -1e-9


def hashed_grams(words: WordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of each word, pair and skip-gram; features repeat as they occur."""
    feature, text = [words.hash], [words.doc]
    for gap, salt in ((1, 3), (2, 5)):
        n = len(words.hash) - gap
        if n > 0:
            same = words.doc[:n] == words.doc[gap:]
            pair = mix(words.hash[:n] * BASE + words.hash[gap:] + np.uint64(salt))
            feature.append(pair[same])
            text.append(words.doc[:n][same])
    return np.concatenate(feature) >> np.uint64(64 - BITS), np.concatenate(text)


class FtrlProximal:
    """Follow the regularised leader: weights come from sums of gradients, each coordinate at its own rate."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias_z = self.bias_n = 0.0

    def _solve(self, z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def bias(self) -> float:
        return float(self._solve(self.bias_z, self.bias_n, 0.0))

    def learn(self, features: np.ndarray, label: int) -> None:
        w = self._solve(self.z[features], self.n[features], self.l1)
        g = 1 / (1 + np.exp(-np.clip(w.sum() + self.bias(), -35, 35))) - label
        old = self.n[features]
        self.z[features] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / self.alpha * w
        self.n[features] += g * g
        b = self.bias()
        self.bias_z += g - (np.sqrt(self.bias_n + g * g) - np.sqrt(self.bias_n)) / self.alpha * b
        self.bias_n += g * g

    def weights(self) -> tuple[np.ndarray, np.ndarray, float]:
        """(features, weights) that aren't 0, and the bias."""
        w = self._solve(self.z, self.n, self.l1)
        kept = np.flatnonzero(w)
        return kept, w[kept], self.bias()


def text_features(encoded: list[bytes]) -> list[np.ndarray]:
    """The different features of each text, in order."""
    feature, text = hashed_grams(WordBatch(encoded))
    pairs = np.unique(text.astype(np.uint64) << np.uint64(32) | feature)
    cuts = np.searchsorted(pairs >> np.uint64(32), np.arange(1, len(encoded)))
    return np.split((pairs & np.uint64(0xFFFFFFFF)).astype("<u4"), cuts)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, limit: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray, float]:
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter(usable & F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    chosen = chosen.withColumn("turn", F.xxhash64(F.col("doc_id"), F.lit(3))).orderBy("turn", "doc_id", "label").limit(limit)
    # at most ``limit`` rows of three numbers; where a doc_id is repeated the bound is kept once more
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    order = ["turn", "doc_id", "label", "tie"]
    sample = joined.withColumn("tie", F.xxhash64("text")).orderBy(*order).limit(limit)

    def featured(texts: list[str | None]) -> tuple[list[bytes], ...]:
        return ([x.tobytes() for _, _, encoded in chunks(texts) for x in text_features(encoded)],)

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        model, ordered = FtrlProximal(), rows.sort_values(order)
        for _ in range(EPOCHS):
            for label, x in zip(ordered["label"], ordered["x"], strict=True):
                model.learn(np.frombuffer(x, "<u4"), int(label == 1))
        return pd.DataFrame({"model": [pickle.dumps(model.weights())]})

    ready(docs.sparkSession)
    rows = add_by_text(sample, featured, "x binary", order, 2000).withColumn("sample", F.lit(0))
    fitted = rows.groupBy("sample").applyInPandas(train, "model binary").collect()
    return pickle.loads(fitted[0]["model"]) if fitted else (np.empty(0, np.int64), np.empty(0), UNSURE)


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, score and predicted for every row of ``docs``."""
    sent = ready(docs.sparkSession).sparkContext.broadcast(weights)  # at most 2**BITS weights; L1 leaves some thousand
    dense: list[np.ndarray] = []

    def scored(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        kept, values, bias = sent.value
        if not dense:
            dense.append(np.zeros(1 << BITS))
            dense[0][kept] = values
        sums = [np.array([dense[0][x].sum() for x in _weighted(encoded, dense[0])]) for _, _, encoded in chunks(texts)]
        value = 1 / (1 + np.exp(-np.clip(np.concatenate(sums or [np.empty(0)]) + bias, -500, 500)))
        return value, (value >= 0.5).astype(np.int32)

    return add_by_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scored, "score double, predicted int", ["doc_id"])


def _weighted(encoded: list[bytes], dense: np.ndarray) -> list[np.ndarray]:
    """The different features of each text that have a weight."""
    feature, text = hashed_grams(WordBatch(encoded))
    some = np.flatnonzero(dense[feature])
    pairs = np.unique(text[some].astype(np.uint64) << np.uint64(32) | feature[some])
    cuts = np.searchsorted(pairs >> np.uint64(32), np.arange(1, len(encoded)))
    return np.split((pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), cuts)
