"""The classifiers against plain scorers, ties at their thresholds, texts longer than a slice, and the whole-collection construction."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from lakefold.llm import decontaminate, lm_scoring, near_dedup, quality, suffix_dedup, toxicity
from lakefold.llm import textkernel as tk

SCHEMA = "doc_id long, text string"
LONG = 1_500_000


def texts_of(seed=4, n=60):
    rng = random.Random(seed)
    words = ["one", "two two", "Drei", "quatre", "vilely", "é", "x###"]
    return [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 30]))) for _ in range(n)] + ["", " \n ", "a"]


def of_text(text):
    buf = np.frombuffer(text.encode(), dtype=np.uint8)
    return buf, np.array([0, buf.size])


def test_quality_against_a_plain_network():
    """The folded output layer and the batches give the softmax of the averaged vectors, text by text."""
    texts = texts_of()
    model = quality.SubwordModel().fit(pa.array(texts), np.array([k % 2 for k in range(len(texts))]), 0.5)
    got = quality.logits(pa.array(texts), model.folded())
    for text, logit in zip(texts, got):
        ids = np.concatenate([b[r[0] : r[1]] for b, r in quality.features(*of_text(text))])
        hidden = model.embedding[ids].astype(float).mean(axis=0) if ids.size else np.zeros(quality.DIM)
        z = hidden @ model.output.astype(float) + model.bias
        assert 1 / (1 + math.exp(-logit)) == pytest.approx(math.exp(z[1]) / (math.exp(z[0]) + math.exp(z[1])), rel=1e-4)


def test_toxicity_against_a_plain_network():
    """Sums of word vectors, every filter at every place, the largest answer, a logistic."""
    texts = texts_of()
    model = toxicity.ConvModel().fit(pa.array(texts), np.array(["vilely" in t for t in texts]).astype(int), ["en"] * len(texts), 0.4)
    got = model.logits(pa.array(texts))
    for text, logit in zip(texts, got):
        words, _ = toxicity.word_buckets(*of_text(text))
        e = [model.embedding[w].astype(float).sum(axis=0) for w in words]
        z = float(model.bias) + model.shift
        for j, (f, cut, w) in enumerate(zip(model.filters, model.cuts, toxicity.WIDTHS)):
            for k in range(toxicity.FILTERS):
                answers = [sum(e[p + i] @ f[i, :, k] for i in range(w)) + cut[k] for p in range(len(e) - w + 1)]
                z += max([0.0, *answers]) * model.output[j * toxicity.FILTERS + k]
        assert logit == pytest.approx(z, abs=1e-3)


def test_calibration_uses_rows_set_aside():
    """A threshold of a language comes from rows that the calibrating model has not seen; few positives leave the common one."""
    texts = texts_of(n=400)
    y = np.array(["vilely" in t for t in texts]).astype(int)
    langs = ["en" if k % 2 else "de" for k in range(len(texts))]
    model = toxicity.ConvModel().fit(pa.array(texts), y, langs, y.mean())
    assert set(model.thresholds) == {"en", "de"} and all(0 < t < 1 for t in model.thresholds.values())
    assert toxicity.ConvModel().fit(pa.array(texts[:40]), y[:40], langs[:40], 0.5).thresholds == {}


def test_ties_at_the_threshold(spark):
    """A score that equals the threshold counts as reaching it."""
    docs = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "c")], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in quality.quality_scores(docs, labels, threshold=0.5).collect()] == [1] * 4
    docs = docs.selectExpr("*", "'en' AS lang")
    assert [r.predicted for r in toxicity.toxicity_scores(docs, labels, threshold=0.5).collect()] == [1] * 4


@pytest.fixture(scope="module")
def long_words():
    assert LONG > tk.SLICE_BYTES
    return [f"w{k}" for k in range(LONG // 6)]


def test_long_texts_are_searched_whole(spark, long_words):
    """Near copies, an item at the very end and a repeated passage in texts above a slice."""
    words = " ".join(long_words)
    passage = " ".join(f"p{k}" for k in range(150))
    docs = spark.createDataFrame([(1, words + " " + passage), (2, words + " changed at the end"), (3, "other things " + passage + " and more")], SCHEMA)
    assert {(r.id, r.component_id) for r in near_dedup.near_duplicates(docs).collect()} == {(1, 1), (2, 1), (3, 3)}
    items = spark.createDataFrame([(7, " ".join(f"p{k}" for k in range(120, 150)))], "item_id long, text string")
    assert {r.id for r in decontaminate.contaminated(docs, items).collect()} == {1, 3}
    got = {r.id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    shared = len(words) + 1  # the two long ones share all up to the blank after the last word
    assert got[1].n_removed == shared + len(passage) and got[2].n_removed == shared and got[3].n_removed == 1 + len(passage)
    assert bytes(got[2].kept) == b"changed at the end" and got[2].kept_sha256 == hashlib.sha256(b"changed at the end").hexdigest()


def test_long_texts_are_scored_whole(spark, long_words):
    words = " ".join(long_words)
    docs = spark.createDataFrame([(1, words), (2, words + " vilely"), (3, "w1 w2")], SCHEMA)
    scored = {r.id: r for r in lm_scoring.score_texts(docs, block_bytes=1 << 20).collect()}
    assert scored[1].n_tokens == len(long_words) + 1 and scored[2].n_bytes == len(words) + 7 and scored[2].score < scored[1].score < scored[3].score < 0
    texts = texts_of(n=300)
    model = toxicity.ConvModel().fit(pa.array(texts), np.array(["vilely" in t for t in texts]).astype(int), ["en"] * len(texts), 0.4)
    pair = model.logits(pa.array([words, words + " vilely"]))
    assert pair[1] > pair[0] + 1  # the last word of a long text decides
    rated = quality.SubwordModel().fit(pa.array(texts), np.array(["###" not in t for t in texts]).astype(int), 0.5)
    assert np.isfinite(quality.logits(pa.array([words, words * 2]), rated.folded())).all()


class Collection:
    """The transform of a whole collection, one symbol of every text a round, from the right: its order and common prefixes.

    Each round inserts the suffixes that begin one symbol earlier between those that are there: a new suffix's place follows
    from its symbol and the place of the one that it extends. What is there streams from one file and goes to the next.
    """

    def __init__(self, texts, folder):
        self.texts, self.paths, self.turn, self.moved = texts, [folder / "a", folder / "b"], 0, 0

    def run(self, rounds=None):
        """(text, place) of all suffixes, sorted, and each one's common prefix with the one before."""
        order, common = [], []
        for back in range(1, min(max(map(len, self.texts)), rounds or 1 << 60) + 1):
            rank = {x: r for r, x in enumerate(order)}
            new = sorted(((t[len(t) - back], rank.get((i, len(t) - back + 1), -1), i) for i, t in enumerate(self.texts) if len(t) >= back))
            marks = [(self.texts[i][p], rank.get((i, p + 1), -1)) for i, p in order]
            out, k = [], 0
            for x, mark in zip(order, marks):  # one pass over what is there, new ones in between
                while k < len(new) and new[k][:2] < mark:
                    out.append((new[k][2], len(self.texts[new[k][2]]) - back))
                    k += 1
                out.append(x)
            out += [(i, len(self.texts[i]) - back) for _, _, i in new[k:]]
            order = out
            np.array(order, dtype=np.int32).tofile(self.paths[self.turn])
            self.turn ^= 1
            self.moved += 8 * len(order)
        for a, b in zip([None, *order], order):
            n = 0
            if a is not None:
                x, y = self.texts[a[0]][a[1] :], self.texts[b[0]][b[1] :]
                n = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            common.append(n)
        return order, common


def test_aligned_construction_finds_what_the_whole_collections_does(spark, tmp_path):
    rng = random.Random(6)
    words = ["alpha ", "beta ", "gamma ", "delta "]
    texts = ["".join(rng.choices(words, k=12)) for _ in range(25)]
    order, common = Collection([t.encode() for t in texts], tmp_path).run()
    gone = [np.zeros(len(t), bool) for t in texts]
    for k, (i, p) in enumerate(order):
        if max(common[k], common[k + 1] if k + 1 < len(common) else 0) >= 30:
            gone[i][p : p + 30] = True
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), SCHEMA), length=30, passage=20, anchor=8).collect()
    assert {r.id: r.n_removed for r in got} == {i: int(g.sum()) for i, g in enumerate(gone)}
