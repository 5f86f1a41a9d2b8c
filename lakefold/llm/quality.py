"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors of its features: hashed words, hashed
character n-grams of four widths, and word pairs of one word twice (all such pairs
have one bucket, other pairs another; both lie beside the hashed ones). Two output vectors and a softmax give the
probability of label 1; both layers are trained together by stochastic gradient
descent in numpy. For scoring, the output layer is folded into the embedding
(the average of vectors times a vector is the average of products), so each
feature costs one lookup and the broadcast model is one number per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakefold.llm import textkernel as tk
from lakefold.llm.classify import FIT_SLICE, SAMPLE_PER_CLASS, labelled_sample, probability
from lakefold.llm.shared import held_out

BUCKET_BITS = 16
WIDTHS = (1, 2, 3, 4)
DIM, EPOCHS, RATE = 12, 6, 0.4
THRESHOLD = 0.7


def features(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each feature, first feature of each row and the end) for words, for word pairs, then for each width of n-grams.

    n-grams of a row stay inside it.
    """
    words, rows = tk.word_hashes(buf, offs)
    yield (words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), rows
    again = np.zeros(words.size, dtype=np.int64)
    again[1:] = words[1:] == words[:-1]
    again[rows[:-1][rows[:-1] < words.size]] = 0
    yield again + (1 << BUCKET_BITS), rows
    wide = buf.astype(np.uint32)
    for n in WIDTHS:
        if buf.size < n:
            continue
        h = np.full(buf.size - n + 1, n, dtype=np.uint32)
        for k in range(n):
            h = (h * np.uint32(0x01000193)) ^ (wide[k : buf.size - n + 1 + k] * np.uint32(0x9E3779B1))
        h *= np.uint32(0x85EBCA6B)
        keep = np.ones(h.size, dtype=bool)
        for k in range(1, n):  # an n-gram that begins within n - 1 bytes before a row's end crosses it
            at = offs[1:-1] - k
            keep[at[(at >= 0) & (at < keep.size)]] = False
        first = np.concatenate(([0], np.cumsum(keep)))[np.minimum(offs, h.size)]
        yield (h[keep] >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), first


class SubwordModel:
    """Embedding and output layer."""

    def __init__(self, seed: int = 3):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.embedding = rng.normal(0, 0.05, ((1 << BUCKET_BITS) + 2, DIM)).astype(np.float32)
        self.output = rng.normal(0, 0.05, (DIM, 2)).astype(np.float32)
        self.bias = np.zeros(2, dtype=np.float32)
        self.shift = 0.0

    def fit(self, texts: pa.Array, y: np.ndarray, share: float, seed: int = 5) -> SubwordModel:
        """SGD over the sample, each class with equal weight. share is not used: the score is that of equally frequent classes."""
        bags: list[tuple[np.ndarray, np.ndarray]] = []
        for lo, hi, buf, offs in tk.slices(texts, FIT_SLICE):
            parts = list(features(buf, offs))
            for i in range(hi - lo):
                ids, n = np.unique(np.concatenate([b[r[i] : r[i + 1]] for b, r in parts]), return_counts=True)
                bags.append((ids.astype(np.uint32), (n / max(1, n.sum())).astype(np.float32)))
        counts = np.bincount(y, minlength=2)
        if counts.min() == 0:  # one class or none: a constant
            self.embedding[:] = 0
            self.bias[:] = (0, 4 if counts[1] else -4 if counts[0] else 0)
            return self
        weight = y.size / (2 * counts)
        rng = np.random.Generator(np.random.PCG64(seed))
        scale = np.float32(len(WIDTHS) * 8)
        for epoch in range(EPOCHS):
            rate = np.float32(RATE * (1 - epoch / EPOCHS))
            for i in rng.permutation(y.size):
                ids, share_of = bags[i]
                rows = self.embedding[ids]
                hidden = share_of @ rows
                z = hidden @ self.output + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[i]] -= 1
                g = (p * np.float32(min(3.0, weight[y[i]]))).astype(np.float32)
                back = self.output @ g
                self.output -= rate * np.outer(hidden, g)
                self.bias -= rate * np.float32(0.1) * g
                self.embedding[ids] = rows - (rate * scale) * share_of[:, None] * back[None, :]
        return self

    def folded(self) -> tuple[np.ndarray, float]:
        """Logit of label 1 per bucket, and the constant part."""
        return (self.embedding @ (self.output[:, 1] - self.output[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0] + self.shift)


def logits(texts: pa.Array, folded: tuple[np.ndarray, float]) -> np.ndarray:
    """Logit of label 1 for each text; a text without features has the constant."""
    table, constant = folded
    out = np.full(len(texts), constant)
    for lo, hi, buf, offs in tk.slices(texts):
        total, n = np.zeros(hi - lo), np.zeros(hi - lo)
        for bucket, rows in features(buf, offs):
            sums = np.concatenate(([0.0], np.cumsum(table.take(bucket))))
            total += sums[rows[1:]] - sums[rows[:-1]]
            n += rows[1:] - rows[:-1]
        out[lo:hi] += total / np.maximum(n, 1)
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> SubwordModel:
    """A model of the labels, fitted on a bounded sample of rows that are not held out."""
    texts, y, _, share = labelled_sample(docs, labels, label, per_class, id_col, text_col)
    return SubwordModel().fit(texts, y, share)


def score_quality(docs: DataFrame, model: SubwordModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column `out`, the probability of label 1. Null texts score as empty ones; a column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model.folded())
    return docs.withColumn(out, probability(F.col(text_col).cast("string"), sent, logits, docs))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row (id, held_out, score, predicted) per row of docs.

    Null ids are not held out. Null and empty texts get the score of a text
    without features. Without usable labels the score is 0.5; with labels of one
    class it is a constant. Repeated rows score alike; other columns are ignored.
    """
    model = fit_quality(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col, 4).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return score_quality(rows, model).select("id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
