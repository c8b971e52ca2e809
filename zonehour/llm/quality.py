"""Quality scores by supervised subword embeddings.

Hashed words, word pairs and character n-grams have learned vectors; a
document is the mean of its vectors, and a softmax over that says how likely
each label is. Trained by stochastic gradient descent in numpy. Since the output
layer is linear, each bucket's vector counts in a score by one number only, so
scoring gathers a number per n-gram and averages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonehour.llm.common import Words, blocks, mix64, text_bytes

#: Buckets of hashed words and word pairs, and as many of character n-grams.
BUCKETS = 1 << 16
#: Sizes of the character n-grams, in bytes.
GRAMS = (3, 5)
#: Labelled rows that the vectors are learned from at most.
SAMPLE_ROWS = 6_000


def _buckets(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per kind of feature: the bucket of each, and where each document's begin and end in it. None reaches into the next document."""
    words = Words(texts)
    top = np.uint64(48)
    yield (words.hash >> top).astype(np.int64), words.first[:-1], words.first[1:]
    pair = mix64(words.hash[:-1] * np.uint64(3) + words.hash[1:]) if len(words.hash) else words.hash
    pair[words.hash[:-1] == words.hash[1:]] = 0  # any word twice running is one feature
    inside = np.ones(len(pair), bool)
    inside[[x - 1 for x in words.first[1:-1] if 0 < x <= len(pair)]] = False
    place = np.concatenate([[0], np.cumsum(inside)])
    place = place[np.minimum(words.first, len(pair))]
    yield (pair >> top).astype(np.int64)[inside], place[:-1], place[1:]
    buf = np.frombuffer(words.raw, np.uint8).astype(np.uint32)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    for n in GRAMS:
        if len(buf) < n:
            continue
        h = np.zeros(len(buf) - n + 1, np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) + buf[k : len(buf) - n + 1 + k]
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
        yield h.astype(np.int64) + BUCKETS, begin * (size >= n), (begin + size - n + 1) * (size >= n)


@dataclass
class Model:
    """What each bucket adds to the log odds of label 1, on average over a document, and their prior."""

    weight: np.ndarray
    prior: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for bucket, a, b in _buckets(texts):
            run = np.concatenate([[0.0], np.cumsum(self.weight[bucket], dtype=np.float64)])
            total += run[b] - run[a]
            n += b - a
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.prior, -40, 40)))


def fit(texts: list[bytes], labels: np.ndarray, dim: int = 16, epochs: int = 6, rate: float = 1.5, seed: int = 11) -> Model:
    """Vectors and output layer by stochastic gradient descent, one document at a time. The bias is the labels' log odds."""
    labels = np.asarray(labels).astype(int)
    prior = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)) if len(labels) else 0.0
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(2 * BUCKETS, np.float32), float(prior))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (2 * BUCKETS, dim)).astype(np.float32)
    out = np.zeros((dim, 2), np.float32)
    bias = np.array([0, prior], np.float32)
    docs = []
    for a, b in blocks([len(t) for t in texts]):
        kinds = list(_buckets(texts[a:b]))
        for d in range(b - a):
            ids, n = np.unique(np.concatenate([x[lo[d] : hi[d]] for x, lo, hi in kinds]), return_counts=True)
            docs.append((ids, (n / max(n.sum(), 1)).astype(np.float32)))
    steps, k = epochs * len(docs), 0
    for _ in range(epochs):
        for d in rng.permutation(len(docs)):
            ids, share = docs[d]
            lr = rate * (1 - k / steps)
            k += 1
            if not len(ids):
                continue
            hidden = share @ vectors[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[d]] -= 1
            back = out @ p
            out -= lr * np.outer(hidden, p)
            # Shares are small; a row of the mean moves by the rate over the document's own weight.
            vectors[ids] -= (lr / max(float(share @ share), 1e-6) * 0.05 * share)[:, None] * back
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(prior))


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the learnable labelled rows of the least id hashes, sample_rows at most.

    An id with one label counts once, one with several texts by the least of them. Null ids, labels and texts teach nothing.
    Without any row, every text scores 0.5.
    """
    h = F.xxhash64(F.col(id_col).cast("string"))
    picked = labels.where(learnable & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"), h.alias("h"))
    picked = picked.distinct().orderBy("h", "id", "label").limit(sample_rows)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    # At most sample_rows short rows; copies of an id are one before they meet.
    sample = F.broadcast(picked).join(texts, "id").groupBy("h", "id", "label").agg(F.min("text").alias("text"))

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "id", "label", "text"]).head(sample_rows)
        m = fit(part["text"].tolist(), part["label"].to_numpy())
        return pd.DataFrame({"weight": [m.weight.tobytes()], "prior": [m.prior]})

    r = sample.groupBy().applyInPandas(train, "weight binary, prior double").first()
    return Model(np.frombuffer(r.weight, np.float32), r.prior) if r else Model(np.zeros(2 * BUCKETS, np.float32), 0.0)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) of every row: score is the belief in label 1, predicted whether it reaches the threshold.

    A null text counts as empty and gets the score of the bias alone. Repeated
    rows have a result each, an empty table gives an empty one, very long texts are
    scored whole, other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b.column(1))
            score = np.empty(len(texts))
            for i, j in blocks([len(t) for t in texts]):
                score[i:j] = model.score(texts[i:j])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], ["id", "score"])

    x = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    x = x.mapInArrow(run, f"id {x.schema['id'].dataType.simpleString()}, score double")
    return x.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
