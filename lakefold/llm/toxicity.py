"""Toxicity: a convolutional text classifier.

Hashed embeddings of words (a word's vector is the sum of those of the whole
word and of its first bytes, so that inflected forms share), filters over one, two and three neighbouring words,
rectified and max-pooled over the whole text, and one logistic output; trained
in numpy by stochastic gradient descent over all labelled rows, in shards whose
changes are averaged after each round. Only the words that win a maximum get
a gradient. Thresholds are calibrated for each language on labelled rows that the
calibrating network was not fitted on; the score itself never sees a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold.llm import textkernel as tk
from lakefold.llm.classify import FIT_SLICE, Shards, fit_rounds, labelled_shards, probability
from lakefold.llm.shared import forget, held_out

BUCKET_BITS = 17
DIM, FILTERS, WIDTHS = 12, 8, (1, 2, 3)
EPOCHS, RATE, STEP = 6, 0.05, np.float32(0.1)
#: Of so many labelled rows, one is set aside to calibrate the thresholds.
ASIDE = 6
#: Bytes of texts scored at once.
SCORE_SLICE = 1 << 18
#: First bytes of a word that have a vector of their own.
PREFIXES = (4, 6)
THRESHOLD = 0.3
#: Thresholds that are tried for a language.
TRIED = np.unique(np.concatenate((np.linspace(0.05, 0.95, 19), [THRESHOLD])))


class ConvModel:
    """Embedding, filters by width and output weights."""

    def __init__(self, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.embedding = rng.normal(0, 0.03, (1 << BUCKET_BITS, DIM)).astype(np.float32)
        self._seen = np.zeros(1 << BUCKET_BITS, dtype=np.float32)  # squared gradients of each bucket
        self.filters = [rng.normal(0, (1 / (w * DIM)) ** 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.cuts = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
        self.output = rng.normal(0, 0.5, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.float32(0)
        self.shift = 0.0
        #: Thresholds by language, calibrated on rows that are set aside.
        self.thresholds: dict[str | None, float] = {}

    def fit(self, texts: pa.Array, y: np.ndarray, langs: list, share: float, seed: int = 13) -> ConvModel:
        """All rows are fitted on. Thresholds come from a model of the same seed that has not seen every ASIDE-th row of a class, over those rows."""
        aside = np.zeros(y.size, dtype=bool)
        for label in (0, 1):
            aside[np.flatnonzero(y == label)[ASIDE - 1 :: ASIDE]] = True
        if aside.any():
            trial = ConvModel()._fit(texts.filter(pa.array(~aside)), y[~aside], share, seed)
            self._calibrate(_tally(trial.logits(texts.filter(pa.array(aside))), y[aside], [x for x, a in zip(langs, aside, strict=True) if a]), share)
        return self._fit(texts, y, share, seed)

    def _fit(self, texts: pa.Array, y: np.ndarray, share: float, seed: int) -> ConvModel:
        """SGD with word dropout; then a shift of the logit to the true share."""
        counts = np.bincount(y, minlength=2)
        if counts.min() == 0:
            return self._constant(counts)
        bags = _bags(texts)
        rng = np.random.Generator(np.random.PCG64(seed))
        for epoch in range(EPOCHS):
            self._learn(bags, y, epoch, rng)
        p = counts[1] / y.size
        share = min(max(share, 1e-3), 1 - 1e-3)
        self.shift = float(np.log(share / (1 - share)) - np.log(p / (1 - p)))
        return self

    def fit_shards(self, spark: SparkSession, shards: Shards) -> ConvModel:
        """fit over all rows of the shards, in tasks. Every ASIDE-th row is one by the hash of its id."""
        if shards.counts.min() == 0:
            return self._constant(shards.counts)
        trial = ConvModel()
        fit_rounds(spark, [self, trial], shards, EPOCHS, _learn_both)
        return self._calibrate(_tally_shards(spark, trial, shards), shards.counts[1] / shards.counts.sum())

    def tables(self) -> list[np.ndarray]:
        return [self.embedding, self._seen]

    def dense(self) -> np.ndarray:
        return np.concatenate([*(f.ravel() for f in self.filters), *self.cuts, self.output, [self.bias]])

    def set_dense(self, values: np.ndarray) -> None:
        at = 0
        for part in (*self.filters, *self.cuts, self.output):
            part[...] = values[at : at + part.size].reshape(part.shape)
            at += part.size
        self.bias = values[at]

    def _constant(self, counts: np.ndarray) -> ConvModel:
        """The model of rows of one class, or of none."""
        self.output[:] = 0
        self.bias = np.float32(4 if counts[1] else -4 if counts[0] else 0)
        return self

    def _learn(self, bags: list[np.ndarray], y: np.ndarray, epoch: int, rng: np.random.Generator) -> None:
        """A step for each document, in random order."""
        rate = np.float32(RATE * (1 - 0.8 * epoch / EPOCHS))
        for i in rng.permutation(y.size):
            words = bags[i]
            if len(words) > 4:  # dropout: a maximum must not hang on one word alone
                words = words[rng.random(len(words)) > 0.1]
            self._step(words, y[i], rate)

    def _step(self, words: np.ndarray, label: int, rate: np.float32) -> None:
        """One document: forward, then Adagrad on the vectors of the winning words, plain steps on the rest."""
        e = self.embedding[words].sum(axis=1)
        pooled, won = [], []
        for f, cut, w in zip(self.filters, self.cuts, WIDTHS, strict=True):
            n = len(words) - w + 1
            if n <= 0:
                pooled.append(np.zeros(FILTERS, np.float32))
                won.append(None)
                continue
            a = sum(e[k : n + k] @ f[k] for k in range(w)) + cut
            at = a.argmax(axis=0)
            pooled.append(np.maximum(a[at, np.arange(FILTERS)], 0))
            won.append(at)
        h = np.concatenate(pooled)
        z = float(h @ self.output + self.bias)
        g = np.float32(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))) - label)
        if abs(g) < 1e-3:
            return
        back = g * self.output * (h > 0)
        self.output -= rate * g * h
        self.bias -= rate * g
        for j, (f, cut, w) in enumerate(zip(self.filters, self.cuts, WIDTHS, strict=True)):
            b = back[j * FILTERS : (j + 1) * FILTERS]
            if won[j] is None or not b.any():
                continue
            at = won[j][:, None] + np.arange(w)[None, :]
            grad = b[:, None, None] * f.transpose(2, 0, 1)
            f -= rate * (b[:, None, None] * e[at]).transpose(1, 2, 0)
            cut -= rate * b
            rows = words[at].reshape(-1)
            grad = np.repeat(grad.reshape(-1, DIM), words.shape[1], axis=0)
            np.add.at(self._seen, rows, (grad * grad).mean(axis=1))
            np.subtract.at(self.embedding, rows, (STEP / np.sqrt(self._seen[rows] + 1e-6))[:, None] * grad)

    def logits(self, texts: pa.Array) -> np.ndarray:
        """Logit of label 1 for each text, over all its words; a text without words has the constant part."""
        out = np.full(len(texts), float(self.bias) + self.shift)
        for lo, hi, buf, offs in tk.slices(texts, SCORE_SLICE):
            words, rows = word_buckets(buf, offs)
            e = sum(self.embedding.take(part, axis=0) for part in words.T)
            for j, (f, cut, w) in enumerate(zip(self.filters, self.cuts, WIDTHS, strict=True)):
                n = len(words) - w + 1
                first, end = rows[:-1], rows[1:] - w + 1
                full = np.flatnonzero(end > first)
                if not full.size:
                    continue
                a = sum(e[k : n + k] @ f[k] for k in range(w))
                pairs = np.stack([first[full], end[full]], axis=1).ravel()
                if pairs[-1] == n:
                    pairs = pairs[:-1]
                top = np.maximum.reduceat(a, pairs, axis=0)[::2]
                out[lo + full] += np.maximum(top + cut, 0) @ self.output[j * FILTERS : (j + 1) * FILTERS]
        return out

    def _calibrate(self, tallies: dict[str | None, np.ndarray], share: float) -> ConvModel:
        """For each language the threshold with the best F1 on rows set aside, nearest to THRESHOLD among equals.

        tallies has the rows of a class (0, 1) by how many of TRIED they reach. Rows given to fit may have
        another share of label 1 than the corpus, so each class weighs as its share there.
        """
        all_of = sum(tallies.values(), np.zeros((2, TRIED.size + 1))).sum(axis=1)
        weight = np.array([1 - share, share]) / np.maximum(1, all_of)
        for lang, tally in sorted(tallies.items(), key=lambda x: str(x[0])):
            if tally[1].sum() < 5 or not tally[0].sum():
                continue
            false, true = (tally * weight[:, None])[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
            f1 = 2 * true / (false + true + tally[1].sum() * weight[1])
            best = TRIED[f1 >= f1.max() - 1e-12]
            self.thresholds[lang] = float(best[np.abs(best - THRESHOLD).argmin()])
        return self


def word_buckets(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and its prefixes, and the index of each row's first word (n + 1)."""
    starts, last, rows = tk.word_bounds(buf, offs)
    sums, q = tk.byte_sums(buf, True)
    ends = last + 1
    out = np.empty((1 + len(PREFIXES), starts.size), dtype=np.int64)
    for k, n in enumerate((None, *PREFIXES)):
        h = tk.span_hashes(sums, q, starts, ends if n is None else np.minimum(ends, starts + n))
        out[k] = (h * np.uint64(2 * k + 1)) >> np.uint64(64 - BUCKET_BITS)
    return out.T, rows


def _words(buf: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    words, rows = word_buckets(buf, offs)
    for i in range(offs.size - 1):
        yield words[rows[i] : rows[i + 1]]


def _bags(texts: pa.Array) -> list[np.ndarray]:
    return [b.astype(np.int32) for lo, hi, buf, offs in tk.slices(texts, FIT_SLICE) for b in _words(buf, offs)]


def _aside(batch: pa.RecordBatch) -> np.ndarray:
    return (batch.column("h").to_numpy() >> 8) % ASIDE == 0


def _learn_both(models: list[ConvModel], batch: pa.RecordBatch, epoch: int, rngs: list[np.random.Generator]) -> None:
    """The model learns from all rows, the trial from those that are not set aside."""
    bags, y = _bags(batch.column("text")), batch.column("y").to_numpy()
    own = np.flatnonzero(~_aside(batch))
    models[0]._learn(bags, y, epoch, rngs[0])
    models[1]._learn([bags[i] for i in own], y[own], epoch, rngs[1])


def _tally(z: np.ndarray, y: np.ndarray, langs: list) -> dict[str | None, np.ndarray]:
    """For each language the rows of each class by how many of TRIED their score reaches."""
    reached, out = np.searchsorted(TRIED, 1 / (1 + np.exp(-np.clip(z, -40, 40))), "right"), {}
    for lang, label, k in zip(langs, y, reached, strict=True):
        out.setdefault(lang, np.zeros((2, TRIED.size + 1), dtype=np.int64))[label, k] += 1
    return out


def _tally_shards(spark: SparkSession, trial: ConvModel, shards: Shards) -> dict[str | None, np.ndarray]:
    """_tally of all rows set aside."""
    sent, n = spark.sparkContext.broadcast((trial, shards)), len(shards.files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, own = sent.value
            for shard in batch.column(0).to_pylist():
                for part in own.read(shard):
                    part = part.filter(pa.array(_aside(part)))
                    found = _tally(model.logits(part.column("text")), part.column("y").to_numpy(), part.column("lang").to_pylist())
                    rows = [(lang, label, k, tally[label, k]) for lang, tally in found.items() for label, k in zip(*np.nonzero(tally), strict=True)]
                    cols = list(zip(*rows, strict=True)) or [()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["lang", "y", "k", "n"])

    out: dict[str | None, np.ndarray] = {}
    for r in spark.range(0, n, 1, n).mapInArrow(run, "lang string, y int, k int, n long").groupBy("lang", "y", "k").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r["lang"], np.zeros((2, TRIED.size + 1), dtype=np.int64))[r["y"], r["k"]] = r["n"]
    sent.destroy()
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ConvModel:
    """A model of the labels, fitted on all labelled rows that are not held out."""
    spark = docs.sparkSession
    shards = labelled_shards(docs, labels, label, id_col, text_col, lang_col)
    model = ConvModel().fit_shards(spark, shards)
    forget(spark, [shards.path])
    return model


def score_toxicity(docs: DataFrame, model: ConvModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column `out`, the probability of label 1. Null texts score as empty ones; a column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn(out, probability(F.col(text_col).cast("string"), sent, lambda texts, own: own.logits(texts), docs))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """One row (id, held_out, score, predicted, lang_threshold, flagged) per row of docs.

    predicted applies the one threshold, flagged the threshold of the row's
    language (languages without enough labels, and null, use the one). Null ids
    are not held out; null and empty texts get the score of a text without
    words. Without usable labels the score is 0.5; with labels of one class it
    is a constant. Repeated rows score alike; other columns are ignored.
    """
    model = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col)
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col, 4).alias("held_out"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    by_lang = F.lit(threshold)
    for lang, t in model.thresholds.items():
        if lang is not None:
            by_lang = F.when(F.col("lang") == lang, F.lit(t)).otherwise(by_lang)
    scored = score_toxicity(rows, model).withColumn("lang_threshold", by_lang.cast("double"))
    return scored.select("id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "lang_threshold", (F.col("score") >= F.col("lang_threshold")).alias("flagged"))
