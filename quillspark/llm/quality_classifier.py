"""A quality classifier of supervised subword embeddings.

Words and character n-grams are hashed into buckets; each bucket has a learned vector. A document is the average of
its words' vectors plus the average of its n-grams' vectors (plus a vector for words said twice in a row, by
their share), and a softmax layer reads the class from it. Vectors and layer are trained on the driver by
stochastic gradient descent in numpy, on at most ``max_rows`` labelled documents and ``max_bytes`` of their text, chosen
by hash.

As the layer is linear, scoring needs one number per bucket: the vectors' inner products with the difference of
the two class weights. Scoring reads every whole text, in blocks, inside map tasks; nothing is shuffled.

Defined edge cases: null and empty texts have no features and score by the bias alone; rows with a null label
are not learned from; an id with two labels is learned from with each; with fewer than two classes among the labels the score is the share of label 1 (0.5
without labels); repeated rows each get a score; only id and text columns are read. Very long texts are hashed ``BLOCK``
characters at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import labelled_sample, small_batches

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
NGRAMS = (1, 2, 3, 4)
SAME = 2 * BUCKETS  # the feature "equals the word before"
FEATURES = 2 * BUCKETS + 1
BLOCK = 1 << 20
#: Odd multiplier between the characters of an n-gram.
MIX = np.uint32(0x01000193)
MAX_ROWS, MAX_BYTES = 4000, 32 << 20


def _hash(values: np.ndarray, salt: int) -> np.ndarray:
    mixed = (values + np.uint32(salt)) * np.uint32(2654435761)
    return (mixed ^ (mixed >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(32 - BUCKET_BITS)


def _word_codes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "replace").split()
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def _ngram_blocks(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all character n-grams, block by block."""
    for at in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[at : at + BLOCK + max(NGRAMS) - 1].encode("utf-32-le", "replace"), "<u4")
        for n in NGRAMS:
            size = min(BLOCK, len(codes) - n + 1)
            if size > 0:
                value = codes[:size].copy()
                for k in range(1, n):
                    value = value * MIX + codes[k : size + k]
                yield _hash(value, n)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their weights in the document's average."""
    words = _word_codes(text)
    counts = np.zeros(FEATURES, dtype=np.float32)
    if len(words):
        counts[:BUCKETS] = np.bincount(_hash(words, 0), minlength=BUCKETS) / len(words)
        counts[SAME] = np.count_nonzero(words[1:] == words[:-1]) / len(words)
    total = 0
    grams = np.zeros(BUCKETS, dtype=np.int64)
    for block in _ngram_blocks(text):
        grams += np.bincount(block, minlength=BUCKETS)
        total += len(block)
    if total:
        counts[BUCKETS : 2 * BUCKETS] = grams / total
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at]


@dataclass
class Model:
    """One number per feature, and the bias, of the log odds of label 1."""

    weights: np.ndarray
    bias: float

    def log_odds(self, text: str) -> float:
        w = self.weights
        words, out = _word_codes(text), self.bias
        if len(words):
            out += w[_hash(words, 0)].sum(dtype=np.float64) / len(words)
            out += float(w[SAME]) * np.count_nonzero(words[1:] == words[:-1]) / len(words)
        total, found, grams = 0.0, 0, w[BUCKETS : 2 * BUCKETS]
        for block in _ngram_blocks(text):
            total += grams[block].sum(dtype=np.float64)
            found += len(block)
        return float(out + total / max(found, 1))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = 8, epochs: int = 12, rate: float = 2.0, seed: int = 1) -> Model:
    """Stochastic gradient descent on the softmax loss, one document at a time, with a falling rate.

    Classes weigh the same whatever their share, so a rare class is learned too; the bias then takes the share.
    """
    if len(set(labels.tolist())) < 2:
        p = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
        return Model(np.zeros(FEATURES, np.float32), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (FEATURES, dim)).astype(np.float32)
    layer = rng.uniform(-1, 1, (dim, 2)).astype(np.float32)
    bias = np.zeros(2)
    share = np.array([(labels == c).mean() for c in (0, 1)])
    weight = np.minimum(0.5 / share, 10)
    steps, done = epochs * len(labels), 0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            at, x = rows[i]
            lr = rate * (1 - done / steps)
            done += 1
            mine = vectors[at]
            hidden = x @ mine
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= weight[labels[i]]
            back = layer @ p
            layer -= (lr * 0.1) * np.outer(hidden, p).astype(np.float32)
            bias -= (lr * 0.05) * p
            vectors[at] = mine - lr * np.outer(x, back).astype(np.float32)
    diff = layer[:, 1] - layer[:, 0]
    return Model((vectors @ diff).astype(np.float32), float(bias[1] - bias[0] + np.log(weight[0] / weight[1])))


def fit(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Learns from at most ``max_rows`` labelled documents that ``usable`` (over the id) lets through, ``max_bytes`` of text in all."""
    small_batches(docs.sparkSession)
    rows = labelled_sample(docs, labels, label_col, usable, id_col, text_col, max_rows, max_bytes)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, label, text in zip(b["id"].to_pylist(), b["label"].to_pylist(), b["text"].to_pylist(), strict=True):
                at, x = features(text or "")
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([label], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], ["id", "label", "at", "x"])

    got = rows.select(F.xxhash64("id").alias("id"), "label", "text").mapInArrow(extract, "id long, label int, at binary, x binary").collect()
    got.sort(key=lambda r: (r.id, r.label, bytes(r.at)))
    return train([(np.frombuffer(bytes(r.at), np.int32), np.frombuffer(bytes(r.x), np.float32)) for r in got], np.array([r.label for r in got], dtype=np.int64))


def score_column(model: Model, text: Column) -> Column:
    weights, bias = model.weights, model.bias

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        own = Model(weights, bias)
        z = np.array([own.log_odds(t or "") for t in texts], dtype=np.float64)
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return score(text)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id, score (probability of label 1) and predicted per document."""
    scored = docs.select(id_col, score_column(model, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
