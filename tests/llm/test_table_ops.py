"""Mixing, sharding, WARC, embeddings, classifiers and components: brute force, round trips, held-out accuracy."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakefold.llm import classify, embedding_dedup, mixing, quality, sharding, shared, toxicity, warc
from lakefold.llm.shared import connected_components

SCHEMA = "doc_id long, text string, source string, lang string, size long, bucket int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", 7, 7) for i, t, s in rows], SCHEMA)


@pytest.mark.parametrize("hub", [1000, 3])
def test_components(spark, hub, monkeypatch):
    """With hubs of few edges, their edges meet the least neighbour by broadcast."""
    monkeypatch.setattr(shared, "HUB_EDGES", hub)
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 440)] + [(5, None), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in parent}


@pytest.mark.parametrize("local", [0, 100, None])
def test_components_of_small_graphs_take_few_jobs(spark, local, monkeypatch):
    """A graph that one task holds takes no rounds; rounds, with hubs and until few edges are left, give the same."""
    monkeypatch.setattr(shared, "HUB_EDGES", 3)
    edges = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1030)] + [(-5, -9), (-9, 1 << 62)]
    spark.sparkContext.setJobGroup(f"components {local}", "")
    try:
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), *[local] * (local is not None)).collect()}
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert got == {k: 0 for k in range(301)} | {k: 1000 for k in range(1000, 1030)} | {-5: -9, -9: -9, 1 << 62: -9}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components {local}"))
    assert jobs <= 8 if local is None else jobs > 8
    assert connected_components(spark.createDataFrame([], "src long, dst long"), *[local] * (local is not None)).count() == 0


def test_least_of_components():
    rng = np.random.default_rng(3)
    for n, m in ((50, 20), (400, 400), (3000, 1500)):
        hi, lo = rng.integers(0, n, m), rng.integers(0, n, m)
        label = {x: x for x in {*hi.tolist(), *lo.tolist()}}
        while any(label[a] != label[b] for a, b in zip(hi.tolist(), lo.tolist(), strict=True)):
            for a, b in zip(hi.tolist(), lo.tolist(), strict=True):
                label[a] = label[b] = min(label[a], label[b])
        nodes, least = shared.least_of_components(hi, lo)
        assert dict(zip(nodes.tolist(), least.tolist(), strict=True)) == label


def test_mix(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.randrange(0, 30)), rng.choice(["a"] * 12 + ["b", "c", "é", None])) for k in range(400)] + [(None, "x y", "a"), (3, None, "b"), (3, None, "b"), (900, "", "empty")]
    found = mixing.mix_sources(docs(spark, rows), bucket_rows=16).collect()
    assert len(found) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and (r.source_size, r.target) == (r.source_size, target[r.source])
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: [1, 2, 3][k % 3] for k, s in enumerate(names)}
    capped = {s for s in names if sizes[s] == 0}
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        share = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / w for s in names}
        over = {s for s in names if s not in capped and share[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in names:
        assert target[s] == pytest.approx(share[s]) and abs(taken[s] - share[s]) <= 0.5
    again = mixing.mix_sources(docs(spark, rows).repartition(7), bucket_rows=16).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    assert mixing.mix_sources(docs(spark, [])).count() == 0


def test_mixed_rows_repeat(spark):
    rows = [(k, "a b c", "small") for k in range(5)] + [(10 + k, "a b c", "large") for k in range(200)]
    got = Counter(r.doc_id for r in mixing.mixed_rows(docs(spark, rows)).collect())
    assert all(got[k] == 3 for k in range(5)) and max(got.values()) == 3


@pytest.mark.parametrize("at_once", [100_000, 25])
def test_shards(spark, at_once):
    rng = random.Random(6)
    rows = [(k, rng.choice(["x", "same " * 20, None, ""]) if rng.random() < 0.3 else f"{k} " * rng.randrange(1, 60), "s") for k in range(500)] + [(None, "n", "s"), (901, "r", "s"), (901, "r", "s")]
    found = sharding.shard_documents(docs(spark, rows), shards=7, groups_at_once=at_once, bucket_rows=4).collect()
    assert len(found) == len(rows)
    slots, size, where = defaultdict(list), Counter(), defaultdict(set)
    text = {i: t for i, t, _ in rows}
    for r in found:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
        where[text[r.id]].add(r.shard)
        assert r.size == 8 + len((text[r.id] or "").encode()) and r.text_crc32 == (None if text[r.id] is None else zlib.crc32(text[r.id].encode()))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for v in where.values())
    from pyspark.sql import functions as F

    groups = docs(spark, rows).select(F.xxhash64(F.lit(1), "text", F.col("text").isNull()).alias("h"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("n")).groupBy("h").agg(F.sum("n").alias("n")).orderBy("h").collect()
    assert max(size.values()) == sharding.least_capacity([g.n for g in groups], 7)
    assert sharding.shard_documents(docs(spark, [])).count() == 0


def test_capacity_is_least():
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 12))]
        shards = rng.randrange(1, 5)
        best = min_max(tuple(sizes), shards)
        c = sharding.least_capacity(sizes, shards)
        assert c == best
        cuts = [0, *sharding.even_cuts(sizes, c, shards), len(sizes)]
        assert cuts == sorted(cuts) and len(cuts) == shards + 1 and max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:])) <= c


def min_max(sizes, shards):
    if shards == 1 or len(sizes) <= 1:
        return sum(sizes)
    return min(max(sum(sizes[:k]), min_max(sizes[k:], shards - 1)) for k in range(len(sizes) + 1))


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 200_000 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/1 2", "x" * 1000), (2, "http://a/2", "x" * 1000), (3, None, "x" * 999), (4, "u", "x" * 999), (5, "u", None), (6, "u", ""), (7, "u", big), (8, "u", big), (8, "u", big), (None, "u", big), (None, "u", "short")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, sha1 string")
    got = sorted((repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in warc.archive_round_trip(pages).collect()))
    largest = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            largest[h] = max(i, largest.get(h, i))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = largest.get(h, i)
        want.append(repr((i, len(b), hashlib.sha1(b).hexdigest(), "response" if to == i else "revisit", None if to == i else to)))
    assert got == sorted(want)
    folder = f"file://{tmp_path}/w"
    from pyspark.sql import functions as F

    own = pages.withColumn("sha1", F.sha1(F.coalesce(F.col("html").cast("binary"), F.lit(b""))))
    copies = warc.numbered_copies(own.union(own.where("page_id = 4")))
    manifest = warc.write_archives(copies.withColumn("response_id", F.lit(None).cast("long")), folder)
    chunks = warc.read_archives(spark, manifest).collect()
    assert len({c.record_id for c in chunks}) == len(rows) + 1
    assert all(c.running_digest == c.block_digest == c.payload_digest for c in chunks if c.last)
    chunks = [c for c in chunks if c.record_id != warc.record_id(4, hashlib.sha1(b"x" * 999).hexdigest(), 1)]
    assert max(c.chunk_bytes for c in chunks) <= warc.CHUNK and sum(c.last for c in chunks) == len(rows)
    parts = defaultdict(dict)
    for c in chunks:
        parts[(c.path, c.record_no)][c.chunk_no] = bytes(c.chunk)
    assert sorted(b"".join(p[k] for k in sorted(p)) for p in parts.values()) == sorted((h or "").encode() for _, _, h in rows)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("tile, block", [(1024, 1 << 21), (5, 1 << 21), (5, 16 * 12), (3, 1)])
def test_embeddings(spark, tile, block):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    rows = []
    for k in range(240):
        v = centres[k % 12] * rng.uniform(0.5, 2) + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.2])
        rows.append((k, [float(np.float32(x)) for x in v], int(k % 3) if k % 17 else None))
    rows += [(300 + k, rows[1][1], rows[1][2]) for k in range(30)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [None] + [1.0] * 15, 1), (404, [], 1), (None, rows[1][1], 1), (405, [1.0, 2.0], 1), (406, [2.0, 4.0], 1)]
    df = spark.createDataFrame([(*r, 3, 4) for r in rows], "vec_id long, embedding array<float>, label int, gid int, n int")
    found = embedding_dedup.embedding_duplicates(df, tile=tile, block_values=block).collect()
    good = [(i, np.array(v, dtype=float), l) for i, v, l in rows if i is not None and v and l is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links, parent = Counter(), {i: i for i, _, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a, x) in enumerate(good):
        for j, b, y in good[:k]:
            if x == y and a.size == b.size and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98:
                links[i] += 1
                links[j] += 1
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    assert {r.id: (r.n_links, r.component_id, r.kept) for r in found if r.id is not None} == {i: (links[i], root(i), root(i) == i) for i in parent}
    assert len(found) == len(rows)
    assert embedding_dedup.embedding_duplicates(df.limit(0)).count() == 0


def labelled(spark, seed=3, n=900):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfgklm" for b in ("ala", "eno", "iru", "oto")]
    rows = []
    for k in range(n):
        w = rng.choices(words, k=rng.randrange(5, 80))
        bad, junk = rng.random() < 0.2, rng.random() < 0.3
        if bad:
            w[rng.randrange(len(w))] = "vile" + rng.choice(["s", "ly", "r."])
        if junk:
            w = [x + "###" for x in w]
        rows.append((k, " ".join(w), rng.choice(["en", "fr", None]), int(not junk), int(bad)))
    d = spark.createDataFrame([r[:3] + (0.5,) for r in rows] + [(9001, None, "en", 0.1), (9002, "", None, 0.1), (None, "bala", "en", 0.1)], "doc_id long, text string, lang string, score double")
    y = spark.createDataFrame([(r[0], r[3], r[4]) for r in rows] + [(None, 1, 1), (9001, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    return d, y, {r[0]: r[3:] for r in rows}


def test_quality(spark):
    d, y, truth = labelled(spark)
    found = quality.quality_scores(d, y).collect()
    assert len(found) == 903 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    held = [r for r in found if r.held_out and r.id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in found if r.id is not None)
    assert sum(r.predicted == truth[r.id][0] for r in held) >= 0.97 * len(held)
    assert {r.score for r in quality.quality_scores(d, y.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(d.limit(0), y).count() == 0


def test_toxicity(spark):
    d, y, truth = labelled(spark)
    found = toxicity.toxicity_scores(d, y).collect()
    assert len(found) == 903 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    held = [r for r in found if r.held_out and r.id in truth]
    assert sum(r.predicted == truth[r.id][1] for r in held) >= 0.95 * len(held)
    assert {r.score for r in toxicity.toxicity_scores(d, y.limit(0)).collect()} == {0.5}


def past_a_sample(spark, word, usual):
    """Documents and labels with over 1,500 training rows of label 1; `word` marks those that are not among the 1,500 of least hash, `usual` the others."""
    ids = spark.range(2300).where("crc32(cast(id AS string)) % 4 <> 2").orderBy(F.xxhash64("id"), "id").collect()
    late = {r.id for r in ids[1500:]}
    rng = random.Random(5)
    plain = [" ".join(rng.choices("bala beno firu goto kala leno miru doto".split(), k=rng.randrange(5, 12))) for _ in range(3200)]
    d = [(k, f"{word if k in late else usual} {t}" if k < 2300 else t, "en") for k, t in enumerate(plain)]
    return spark.createDataFrame(d, "doc_id long, text string, lang string"), spark.createDataFrame([(k, int(k < 2300)) for k in range(3200)], "doc_id long, label int"), late


def test_labels_are_all_learned_from(spark, monkeypatch):
    """Every labelled row that is not held out is in one shard; an id labelled twice or on two documents is there once."""
    monkeypatch.setattr(classify, "SHARD_ROWS", 700)
    d, y, _ = past_a_sample(spark, "zorply", "vilely")
    again = spark.createDataFrame([(0, "other"), (None, "none"), (9000, "not labelled")], "doc_id long, text string").selectExpr("*", "'en' AS lang")
    more = spark.createDataFrame([(3199, 1), (None, 1), (1, None), (9999, 1)], "doc_id long, label int")
    shards = classify.labelled_shards(d.union(again), y.union(more), "label", lang_col="lang")
    parts = [b for k in range(len(shards.files)) for b in shards.read(k)]
    train = [k for k in range(3200) if zlib.crc32(str(k).encode()) % 4 != 2]
    want = [r.h for r in spark.createDataFrame([(k,) for k in train], "k long").select(F.xxhash64("k").alias("h")).collect()]
    assert len(shards.files) > 2 and sorted(h for b in parts for h in b.column("h").to_pylist()) == sorted(want)
    ones = sum(k < 2300 or k == 3199 for k in train)
    assert shards.counts.tolist() == [len(train) - ones, ones]
    assert sum(sum(b.column("y").to_pylist()) for b in parts) == ones


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """A word that no sample of 1,500 rows of least hash would hold is learned, whatever the shard that has it; reruns agree."""
    monkeypatch.setattr(classify, "SHARD_ROWS", 700)
    d, y, late = past_a_sample(spark, "zorply", "vilely")
    y = y.withColumnRenamed("label", "toxic")
    found = {r.id: r.score for r in toxicity.toxicity_scores(d, y).collect()}
    assert len(late) > 100 and min(found[k] for k in late) >= 0.5 > max(found[k] for k in range(2300, 3200))
    assert found == {r.id: r.score for r in toxicity.toxicity_scores(d, y).collect()}


def test_mixed_rows_keep_rows_without_words(spark):
    rows = [(k, "w " * 10, "abc"[k % 3]) for k in range(60)] + [(100 + k, "", "c") for k in range(5)]
    got = Counter(r.doc_id for r in mixing.mixed_rows(docs(spark, rows)).collect())
    assert all(got[100 + k] in (1, 2) for k in range(5))  # c's target is 1.5 times its words


def test_embeddings_of_a_repeated_id(spark):
    rows = [(1, [1.0, 0.0, 0.0], "x"), (1, [0.0, 1.0, 0.0], "x"), (2, [1.0, 0.01, 0.0], "x"), (3, [0.01, 1.0, 0.0], "x"), (4, [0.02, 1.0, 0.0], "x")]
    got = embedding_dedup.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()
    assert sorted((r.id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1)]
