"""Toxicity score: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

A text's features are the distinct 64-bit hashes of its words, word pairs and pairs with one word between them. The model
is fitted on at most ``SAMPLE`` labelled rows, the first in the order of a hash of their ids, equal texts once; features
of fewer than ``LEAST_TEXTS`` sampled texts are left out. Each coordinate has its own rate, and the L1 term leaves
few weights: a sorted array of hashes with their weights, small whatever the corpus, which goes to the tasks that score.

Scale: the sample is picked from the labels alone and broadcast (its size is its bound); the texts are read twice and only
the sampled ones are shuffled. All tasks compute features of their own part of the sample, which is written; one task then
fits on that table. Scoring is a map.

Defined results: a null or empty text has no features and gets the score of the bias; rows are scored one by one, so
repeated rows get the same score; an id with several labels counts as toxic if one says so, and of several rows with a
sampled id the text that comes first is learned; null ids and null labels aren't learned; without any label of either kind
the score is 0 for all; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, stage
from .words import alphanumeric_words, chained, hashes

SAMPLE = 8000
LEAST_TEXTS = 5
PASSES = 4
ALPHA, BETA, L1, L2 = 10.0, 1.0, 20.0, 0.01
POSITIVE = 3.0  # weight of a toxic row
CUTOFF = 0.7


def grams(text: bytes) -> np.ndarray:
    """Hashes of all words, pairs and skip-grams of a text, with repeats."""
    w = hashes(alphanumeric_words(text))
    pair = chained([w[:-1], w[1:]]) if len(w) > 1 else w[:0]
    skip = chained([w[:-2], np.full(max(0, len(w) - 2), 1, np.uint64), w[2:]]) if len(w) > 2 else w[:0]
    return np.concatenate([w, pair, skip])


class Model:
    """Sparse weights by feature hash, and the bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.keys, self.weights, self.bias = keys, weights, bias
        self.near = np.zeros(1 << 16, bool)
        self.near[(keys >> np.uint64(48)).astype(np.int64)] = True

    def score(self, text: bytes) -> float:
        g = grams(text)
        g = np.unique(g[self.near[(g >> np.uint64(48)).astype(np.int64)]])
        if len(g) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
            total = float(self.weights[at[self.keys[at] == g]].sum())
        else:
            total = 0.0
        return float(1 / (1 + np.exp(-np.clip(self.bias + total, -50, 50))))


def fit_rows(rows: list[tuple[np.ndarray, int]], passes: int = PASSES, seed: int = 7) -> Model:
    """FTRL-proximal over (distinct feature hashes, label) rows; the order depends on the seed and the rows only."""
    rows = list({r[0].tobytes() + bytes([r[1]]): r for r in rows}.values())
    if len({y for _, y in rows}) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -50.0)
    keys, counts = np.unique(np.concatenate([x for x, _ in rows]), return_counts=True)
    keys = keys[counts >= LEAST_TEXTS]
    index = []
    for x, _ in rows:
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1) if len(keys) else np.zeros(0, np.int64)
        index.append(np.r_[at[keys[at] == x] if len(keys) else at, len(keys)])
    z, n = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    l1 = np.full(len(keys) + 1, L1)
    l1[-1] = 0  # the bias
    def weights(i):
        return np.where(np.abs(z[i]) <= l1[i], 0, -(z[i] - np.sign(z[i]) * l1[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for k in order.permutation(len(rows)):
            i = index[k]
            w = weights(i)
            y = rows[k][1]
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -50, 50))) - y) * (POSITIVE if y else 1.0)
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weights(np.arange(len(keys) + 1))
    some = np.flatnonzero(w[:-1])
    return Model(keys[some], w[some], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on at most ``sample`` rows of ``labels`` (id, 0 or 1)."""
    some = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).dropna().groupBy("_id").agg(F.max("_y").alias("_y"))
    some = first_by_hash(some, "_id", sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(grams(t.as_py() or b"")).tobytes() for t in batch.column(0)]
            yield pa.record_batch([batch.column(1), pa.array(found, pa.binary())], ["y", "x"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(x, np.uint64), y) for b in batches for y, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        m = fit_rows(sorted(rows, key=lambda r: (len(r[0]), r[0].tobytes(), r[1])))
        yield pa.record_batch([[m.keys.tobytes()], [m.weights.tobytes()], [m.bias]], ["keys", "weights", "bias"])

    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("binary").alias("_text"))
    texts = rows.join(F.broadcast(some), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_y").alias("_y"))
    sampled = stage(texts.select("_text", "_y").mapInArrow(features, "y int, x binary"), "features")
    found = sampled.coalesce(1).mapInArrow(fitted, "keys binary, weights binary, bias double").first()
    if found is None:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -50.0)
    return Model(np.frombuffer(found.keys, np.uint64), np.frombuffer(found.weights), found.bias)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score of 0 to 1 under ``name``, in place of a column of that name."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
            found = [shared.value.score(t.as_py() or b"") for t in texts]
            yield batch.append_column(name, pa.array(found, pa.float64()))

    return docs.mapInArrow(scored, docs.withColumn(name, F.lit(0.0)).schema)


def held_out(doc_id: str = "doc_id"):
    """Rows whose label the model never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
