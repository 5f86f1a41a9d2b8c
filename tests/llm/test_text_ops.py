"""Near-dedup, decontamination, suffix dedup and LM scoring against brute force, and their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest

from lakefold.llm import decontaminate, lm_scoring, near_dedup, suffix_dedup
from lakefold.llm import textkernel as tk

LOWER = {c: c + 32 for c in range(65, 91)}
WORDS = [f"w{k}" for k in range(400)] + ["É", "ñu", "A\x1cB"]
SCHEMA = "doc_id long, text string, h long, id string, key string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def frame(spark, rows):
    """Rows (doc_id, text) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for k in range(40):
        words = rng.choices(WORDS, k=rng.choice([3, 8, 60, 300]))
        out.append(" ".join(words))
        for _ in range(rng.choice([0, 1, 4])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = "edited"
            out.append("\t".join(copy) if rng.random() < 0.3 else " ".join(copy))
    base = rng.choices(WORDS, k=200)
    for _ in range(60):  # near copies of one text, most of them linked through others only
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(200)] = "z"
        out.append(" ".join(copy))
    out += ["", None, None, "one", "ONE", " \n ", "a b c d", "a b c d"]
    return list(enumerate(out)) + [(None, out[0]), (3, out[3])]


def classes(rows, percent):
    rows = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in rows}


@pytest.mark.parametrize("block", [4_000_000, 900])
def test_near_duplicates(spark, rows, block):
    found = near_dedup.near_duplicates(frame(spark, rows), percent=85, block_shingles=block).collect()
    assert len(found) == len(rows)
    want = classes(rows, 85)
    assert {r.id: (r.n_shingles, r.component_id) for r in found if r.id is not None} == want
    assert all(r.kept == (r.id is not None and r.id == r.component_id) for r in found)
    assert [r.component_id for r in found if r.id is None] == [None]


def test_near_duplicates_of_one_id_with_several_texts(spark):
    """Its texts tie their groups together, a text without words among them."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    near = lambda t: t + " and more"
    own = [(1, a), (2, b), (3, near(a)), (3, near(b)), (3, near(b)), (4, ""), (4, near(c)), (5, c), (6, None), (6, ""), (7, "x")]
    for block in (4_000_000, 50):
        got = {(r.id, r.component_id) for r in near_dedup.near_duplicates(frame(spark, own), percent=80, block_shingles=block).collect()}
        assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7)}


def test_near_duplicates_empty(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    for share in (0.95, 0.85):
        b = np.concatenate((a[: int(1000 * share)], rng.integers(0, 1 << 63, 40, dtype=np.uint64)))
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        s = near_dedup.odd_sketches(np.stack([near_dedup.min_samples(np.sort(x)) for x in (a, b)]))
        z = int(np.bitwise_count((s[0] ^ s[1]).view(np.uint64)).sum())
        bits, samples = near_dedup.SKETCH_BITS, near_dedup.BANDS * near_dedup.ROWS
        assert abs(1 + bits / (4 * samples) * math.log(1 - 2 * z / bits) - truth) < 0.12


def test_contaminated(spark, rows):
    rng = random.Random(9)
    items = [(k, " ".join(rng.choices(WORDS, k=n))) for k, n in enumerate([3, 5, 6, 9, 40, 80])] + [(6, None), (7, ""), (None, "w1 w2 w3 w4 w5"), (1, "w9 w8 w7 w6 w5 w4")]
    docs = list(rows)
    for k, (_, t) in enumerate(x for x in items if x[1]):
        docs.append((1000 + k, " ".join(rng.choices(WORDS, k=900)) + " " + t + " " + " ".join(rng.choices(WORDS, k=500))))
        words = t.split()
        words[len(words) // 2] = "other"
        docs.append((2000 + k, "lead " * 50 + " ".join(words) + " tail"))
    want = Counter()
    for i, t in docs:
        d = shingles(t)
        want.update((i, k) for k, q in items if k is not None and (s := shingles(q)) and 100 * len(s & d) >= 80 * len(s))
    it = spark.createDataFrame(items, "item_id long, text string")
    assert any(s < decontaminate.SHORT_ITEM for s in map(len, map(shingles, (q for _, q in items)))) and max(len(shingles(q)) for _, q in items) > decontaminate.SHORT_ITEM
    for block in (1_000_000, 30):
        got = Counter((r.id, r.item_id) for r in decontaminate.contaminated(frame(spark, docs), it, block_shingles=block).collect())
        assert got == want
    kept = decontaminate.without_contaminated(frame(spark, docs), it)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in docs if i not in {i for i, _ in want})
    assert decontaminate.contaminated(frame(spark, []), it).count() == 0
    assert decontaminate.contaminated(frame(spark, docs), it.limit(0)).count() == 0


def repeated_bytes(texts, length):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=int)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = 1
        out.append(gone)
    return out


def without_repeats(rows, length, passage):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), t, gone, shared in zip(rows, texts, repeated_bytes(texts, length), repeated_bytes(texts, passage)):
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = int((np.diff(np.concatenate(([0], gone))) == 1).sum())
        out.append((i, len(t), int(gone.sum()), runs, int(shared.sum()), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batch, group", [(4096, 2048), (40, 5), (40, 1)])
def test_remove_repeats(spark, rows, batch, group):
    """With small groups, anchors are split into single windows."""
    rng = random.Random(3)
    around = [" ".join(rng.choices(WORDS, k=9)) + " one passage that a good share of the documents has, a line of it " * rng.choice([1, 1, 2]) + " ".join(rng.choices(WORDS, k=9)) for _ in range(40)]
    own = rows[:80] + [(900, "ab" * 200), (901, "x" * 70), (902, "x" * 41), (903, around[0]), (903, around[0])] + [(910 + k, t) for k, t in enumerate(around)]
    found = suffix_dedup.remove_repeats(frame(spark, own), length=40, passage=24, anchor=8, batch_rows=batch, group_rows=group).collect()
    assert sorted(((r.id, r.n_bytes, r.n_removed, r.n_spans, r.n_shared, r.kept_sha256, bytes(r.kept)) for r in found), key=repr) == without_repeats(own, 40, 24)
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_anchors_of_a_long_text_in_pieces(monkeypatch):
    """Pieces give the runs of windows of the whole text, each once and whole."""
    text = np.frombuffer(" ".join(random.Random(1).choices(WORDS, k=900)).encode(), dtype=np.uint8)

    def runs(piece):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        run = suffix_dedup._anchor_batches(60, 30, 8)
        batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([8]), pa.array([text.tobytes().decode()])], ["id", "th", "text"])
        return sorted(tuple(r.values()) for out in run(iter([batch])) for r in out.to_pylist())

    whole = runs(1 << 20)
    assert sum(r[5] + 1 for r in whole) == text.size - 29
    assert all(runs(piece) == whole for piece in (100, 200, 331))


def test_lm_scores(spark, rows):
    found = lm_scoring.score_texts(frame(spark, rows), block_bytes=5000).collect()
    assert len(found) == len(rows)
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None] for i, t in rows}
    held = {r.id: r.held_out for r in found}
    counts = Counter(w for i, t in rows if not held[i] for w in words[i])
    n, v = sum(counts.values()), len(counts)
    for r in found:
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words[r.id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words[r.id]), sum(w in counts for w in words[r.id]), n)
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert lm_scoring.score_texts(frame(spark, [])).count() == 0


@pytest.mark.parametrize("chunk", [1 << 16, 20])
def test_lm_scores_mix_five_bytes_of_context(spark, chunk):
    """Against context trees of depth five, built node by node; upper case counts as lower."""
    rng = random.Random(7)
    own = [(k, " ".join(rng.choices(("green", "Grown", "greener", "OWN", "é", "É"), k=rng.choice((0, 3, 9))))) for k in range(25)] + [(30, None)]
    found = lm_scoring.score_texts(frame(spark, own), block_bytes=100, chunk=chunk).collect()
    held = {r.id: r.held_out for r in found}
    seen, kids = Counter(), defaultdict(set)

    def decisions(text):
        s = b"\xfe" * 5 + (text or "").translate(LOWER).encode() + b"\xff"
        return [(s[p - 5 : p], 1 << k | s[p] >> 8 - k, s[p] >> 7 - k & 1) for p in range(5, len(s)) for k in range(8)]

    for context, node, bit in (x for i, t in own if not held[i] for x in decisions(t)):
        for d in range(6):
            seen[context[5 - d :], node, bit] += 1
            if d < 5:
                kids[context[5 - d :], node].add(context[4 - d :])

    def estimate(context, node):
        a, b = seen[context, node, 0], seen[context, node, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    @cache
    def below(context, node):
        return sum(estimate(k, node) if len(k) == 5 else np.logaddexp(estimate(k, node), below(k, node)) - math.log(2) for k in kids[context, node])

    @cache
    def chance(context, node, bit):
        p = None
        for d in range(5, -1, -1):
            c = context[5 - d :]
            one = (seen[c, node, bit] + 0.5) / (seen[c, node, 0] + seen[c, node, 1] + 1)
            share = 1 if p is None else 1 / (1 + math.exp(below(c, node) - estimate(c, node)))
            p = share * one + (1 - share) * (p or 0)
        return p

    assert len(found) == len(own) and any(held.values())
    for r in found:
        assert r.score == pytest.approx(sum(math.log10(chance(*x)) for x in decisions(dict(own)[r.id])), rel=1e-6)


def test_symbol_probabilities_sum_to_one(spark):
    """Over all 256 symbols after a context, seen or not."""
    rng = np.random.default_rng(3)
    seen = np.unique((rng.integers(0, 1 << 30, 500) & ~0xFFFF00) | (0x6162 << 8))
    context = int(seen[0]) >> 8
    asked = {int(k): 0 for k in (context << 8) + np.arange(256)} | {int(k): int(n) for k, n in zip(seen, rng.integers(1, 9, seen.size))}
    found = lm_scoring._string_values(spark.createDataFrame(list(asked.items()), "key long, n long"), 3).collect()
    assert sorted(r.key for r in found) == sorted(asked)
    assert sum(10**r.value for r in found if r.key >> 8 == context) == pytest.approx(1)


def test_kt_and_lookup():
    a, b = np.array([0.0, 3.0, 500.0]), np.array([0.0, 1.0, 20.0])
    want = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(x + y + 1) for x, y in zip(a, b)]
    assert lm_scoring.kt_log(a, b) == pytest.approx(want, abs=1e-7)
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 48, 3000, dtype=np.uint64))
    assert (lm_scoring.Lookup(keys, keys.astype(float)).get(keys) == keys).all()


def test_slices_of_nulls_and_long_rows():
    texts = pa.array(["a" * 50, None, "", "b b", "c"])[1:]
    got = [(lo, hi, bytes(b)) for lo, hi, b, _ in tk.slices(texts, 2)]
    assert b"".join(b for *_, b in got) == b"b bc" and got[-1][1] == 4
