"""MinHash near-dedup with odd sketches.

Each text's set of five-word shingles gets 120 MinHash samples. Bands of five
samples propose candidates. The samples are also folded into a bitmap of
parities (an odd sketch): the population count of two bitmaps' XOR estimates
their similarity, which drops candidates that are far below the threshold.
What is left is confirmed on full sets.

Equal sets are collapsed first, with map-side combining, so a group of equal
copies of any size costs one representative; the sets are the nodes, and an id
on rows of several sets ties these together at the end. Near copies are linked to a
bucket's least member, never pair by pair, and the full sets of a cluster are
compared breadth-first: a text that has joined a component is compared no more.
A cluster larger than one task may hold is dealt into blocks that meet through
a few pilots; members that no pilot reached are then compared with every block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakefold.llm import textkernel as tk
from lakefold.llm.shared import connected_components, cut, short_batches, small, spread, stored

BANDS, ROWS = 24, 5
SKETCH_BITS = 256
#: Estimated similarity below which a candidate is dropped; over five standard errors under 0.8.
LEAST_ESTIMATE = 0.55
#: Shingles of a cluster that one task compares.
BLOCK_SHINGLES = 4_000_000
PILOTS = 8

_rng = np.random.Generator(np.random.PCG64(7))
_SEEDS = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_TAGS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_FOLD = (_rng.integers(0, 1 << 63, ROWS, dtype=np.uint64)) | np.uint64(1)
_SIGNATURE = "id long, th long, n_shingles long, fp1 long, fp2 long, bands array<long>, sketch array<long>"


def odd_sketches(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """One bitmap of parities per row of MinHash samples, as int64 words."""
    rows = samples.shape[0]
    at = tk.mix(samples.astype(np.uint64) ^ _TAGS[None, : samples.shape[1]]) & np.uint64(bits - 1)
    flat = at + (np.arange(rows, dtype=np.uint64) * np.uint64(bits))[:, None]
    odd = (np.bincount(flat.ravel().astype(np.int64), minlength=rows * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(rows, bits), axis=1).view(np.int64)


def most_differing(least: float, samples: int = BANDS * ROWS, bits: int = SKETCH_BITS) -> int:
    """The largest XOR population count whose estimate 1 + bits/(4 samples) * ln(1 - 2 z/bits) is at least `least`."""
    return int(bits / 2 * (1 - np.exp((least - 1) * 4 * samples / bits)))


def min_samples(s: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set of 64-bit hashes."""
    h = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(_SEEDS.size, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, h.size, 2048):
        np.minimum(out, (_SEEDS[:, None] * h[None, at : at + 2048]).min(axis=1), out=out)
    return out


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        counts, prints = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
        samples = np.zeros((n, _SEEDS.size), np.uint32)
        for i, s in tk.shingle_sets(batch.column("text")):
            if s.size:
                counts[i] = s.size
                prints[i] = s.sum(dtype=np.uint64), tk.mix(s).sum(dtype=np.uint64)
                samples[i] = min_samples(s)
        folded = samples.astype(np.uint64).reshape(n, BANDS, ROWS)
        keys = tk.mix((folded * _FOLD).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _TAGS[0])
        sketches = odd_sketches(samples) if n else np.zeros((0, SKETCH_BITS // 64), np.int64)
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel())) for a in (tk.signed(keys), sketches)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(counts), *(pa.array(tk.signed(prints[:, k].copy())) for k in (0, 1)), *lists], ["id", "th", "n_shingles", "fp1", "fp2", "bands", "sketch"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, hash of the text, set size, 128-bit fingerprint of the set, band keys and odd sketch."""
    short_batches(docs.sparkSession)
    return _rows(docs, id_col, text_col).mapInArrow(_signature_batches, _SIGNATURE)


class _Cluster:
    """Exact links among the sets of one cluster, breadth-first."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], sketches: np.ndarray, percent: int):
        self.ids, self.sets, self.sketches, self.percent = np.array(ids), sets, sketches.view(np.uint64), percent
        self.sizes = np.array([s.size for s in sets])

    def roots(self) -> np.ndarray:
        """For each member, the least id of its component."""
        m = len(self.sets)
        flat = np.concatenate(self.sets)
        _, dense = np.unique(flat, return_inverse=True)
        dense = dense.astype(np.int64)
        offs = np.concatenate(([0], np.cumsum(self.sizes)))
        marks = np.zeros(int(dense.max()) + 1, dtype=bool)
        most = most_differing(LEAST_ESTIMATE)
        root = np.full(m, -1)
        open_ = np.arange(m)  # not yet in a component
        while open_.size:
            first, open_ = open_[0], open_[1:]
            members, queue = [first], [first]
            while queue and open_.size:
                f = queue.pop()
                near = np.bitwise_count(self.sketches[open_] ^ self.sketches[f]).sum(axis=1) <= most
                a, b = self.sizes[f], self.sizes[open_]
                near &= 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)
                tried = open_[near]
                if not tried.size:
                    continue
                mine = dense[offs[f] : offs[f + 1]]
                marks[mine] = True
                both = np.empty(tried.size, dtype=np.int64)
                for at in range(0, tried.size, 256):
                    part = tried[at : at + 256]
                    hits = marks[np.concatenate([dense[offs[t] : offs[t + 1]] for t in part])]
                    both[at : at + 256] = np.add.reduceat(hits, np.concatenate(([0], np.cumsum(self.sizes[part])[:-1])), dtype=np.int64)
                marks[mine] = False
                linked = tried[100 * both >= self.percent * (a + self.sizes[tried] - both)]
                if linked.size:
                    members.extend(linked)
                    queue.extend(linked)
                    open_ = open_[~np.isin(open_, linked, assume_unique=True)]
            root[members] = self.ids[members].min()
        return root


def _compare(percent: int):
    """mapInArrow function: rows sorted by (cluster, block) -> (src, dst) star edges of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, sketches = None, [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1:
                root = _Cluster(ids, sets, np.array(sketches, dtype=np.int64), percent).roots()
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, dtype=np.int64)), pa.array(root.astype(np.int64))], ["src", "dst"])

        for batch in batches:
            groups = zip(batch.column("cluster").to_pylist(), batch.column("block").to_pylist(), strict=True)
            own, marks = batch.column("id").to_pylist(), batch.column("sketch").to_pylist()
            hashed = tk.shingle_sets(batch.column("text"))
            for (i, s), group in zip(hashed, groups, strict=True):
                if group != key:
                    yield from flush()
                    key, ids, sets, sketches = group, [], [], []
                ids.append(own[i])
                sets.append(s)
                sketches.append(marks[i])
        yield from flush()

    return run


def _compared(rows: DataFrame, percent: int, parts: int) -> DataFrame:
    rows = rows.select("cluster", "block", "id", "sketch", "text")
    return rows.repartition(parts, "cluster", "block").sortWithinPartitions("cluster", "block", "id").mapInArrow(_compare(percent), "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Near-duplicate classes: one row (id, n_shingles, component_id, kept) per row of docs.

    Two texts are linked when 100 * intersection >= percent * union of their
    five-word shingle sets; component_id is the least id reachable by links,
    kept tells whether that is the row's own id. percent below 75 would need
    other bands.

    Null or empty texts, and texts without words, have no shingles: linked with
    nothing. Rows with a null id are linked with nothing and have a null
    component_id and kept false. An id on several rows is one node, linked by
    each of its texts. Repeated rows count once. Other columns of docs are
    ignored, whatever their names. An empty table gives no rows.
    """
    sig = cut(signatures(docs, id_col, text_col))
    live = sig.where("id IS NOT NULL AND n_shingles > 0")
    key = ["fp1", "fp2", "n_shingles"]
    # collapsed: one representative for each distinct set
    sets = live.groupBy(*key).agg(F.min_by(F.struct("bands", "sketch"), "id").alias("s"), F.min(F.struct("id", "th")).alias("r"))
    sets = cut(sets.select(F.monotonically_increasing_id().alias("set"), *key, "r.id", "r.th", "s.bands", "s.sketch"))
    banded = sets.select("set", F.explode("bands").alias("key"))
    buckets = cut(banded.groupBy("key").agg(F.min("set").alias("a"), F.max("set").alias("b"), F.count("*").alias("m")).where("m > 1"))
    pairs = buckets.where("m = 2").select("a", "b").distinct()
    of = sets.select("set", "sketch")
    differing = F.expr("aggregate(zip_with(sa, sb, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    pairs = pairs.join(of.toDF("a", "sa"), "a").join(of.toDF("b", "sb"), "b").where(differing <= most_differing(LEAST_ESTIMATE))
    stars = buckets.where("m > 2").join(banded, "key").select(F.col("a"), F.col("set").alias("b"))
    cluster_of = connected_components(pairs.select("a", "b").union(stars).toDF("src", "dst")).toDF("set", "cluster")

    members = cut(cluster_of.join(sets.select("set", "id", "th", "n_shingles", "sketch"), "set"))
    sizes = members.groupBy("cluster").agg(F.sum("n_shingles").alias("total"))
    blocks = F.ceil(F.col("total") / block_shingles).cast("int")
    members = cut(members.join(sizes.select("cluster", blocks.alias("n_blocks")), "cluster").withColumn("block", F.pmod(F.xxhash64("set"), F.col("n_blocks").cast("long"))))
    n, widest = members.agg(F.count("*"), F.max("n_blocks")).first()
    rows = _rows(docs, id_col, text_col).join(small(members, 120, n=n), ["id", "th"]).select("cluster", "block", "n_blocks", F.col("set").alias("id"), "sketch", "text")
    rows = stored(rows.dropDuplicates(["id"]), "members")  # a row of a representative may occur more than once
    members = members.drop("id", "th").withColumnRenamed("set", "id")
    parts = spread(members, 1500, n=n)
    links = cut(_compared(rows, percent, parts))
    if (widest or 0) > 1:
        links = _across_blocks(rows.where("n_blocks > 1"), members.where("n_blocks > 1"), links, percent, parts, block_shingles)
    roots = links.groupBy(F.col("src").alias("set")).agg(F.min("dst").alias("root"))

    print_ = F.xxhash64(*key)
    several = cut(sig.where("id IS NOT NULL").groupBy("id").agg(F.min(print_).alias("a"), F.max(print_).alias("b")).where("a <> b").select("id"))
    tied = several.limit(1).count() > 0
    if tied:
        sets_of = cut(live.join(small(several, 8), "id").select("id", *key).distinct().join(sets.select(*key, "set"), key).select("id", "set"))
        ties = sets_of.join(sets_of.groupBy("id").agg(F.min("set").alias("first")), "id").select("set", "first")
        roots = connected_components(cut(roots.union(ties)).toDF("src", "dst")).toDF("set", "root")
    linked = cut(roots.join(sets.select("set", "id"), "set"))
    least = linked.groupBy("root").agg(F.min("id").alias("component"))
    linked = linked.join(least, "root").select("set", "component")
    named = sets.join(linked, "set", "left").select("set", *key, F.coalesce("component", "id").alias("component"))
    out = sig.select("id", *key).join(named.drop("set"), key, "left")
    if tied:
        of_id = cut(sets_of.join(named.select("set", "component"), "set").groupBy("id").agg(F.min("component").alias("of_id")))
        out = out.join(small(of_id, 16), "id", "left").withColumn("component", F.coalesce("of_id", "component"))
    out = out.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def _across_blocks(rows: DataFrame, members: DataFrame, links: DataFrame, percent: int, parts: int, block_shingles: int) -> DataFrame:
    """Links completed over the clusters of several blocks, as stars to the least member."""

    def met(pilots: DataFrame) -> DataFrame:
        """Pilots (id, cluster, chunk) copied to every block of their cluster and compared there."""
        copies = rows.drop("block").join(pilots, ["id", "cluster"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks").cast("long") - 1)))
        at = pilots.select("cluster", "chunk").distinct()
        local = rows.join(at, "cluster")
        both = local.select("cluster", "block", "chunk", "id", "sketch", "text").unionByName(copies.select("cluster", "block", "chunk", "id", "sketch", "text"))
        both = both.withColumn("block", F.xxhash64("block", "chunk")).dropDuplicates(["cluster", "block", "id"])
        return _compared(both, percent, parts)

    pilots = members.where(F.col("block") < PILOTS).groupBy("cluster", "block").agg(F.min("id").alias("id")).select("cluster", "id", F.lit(0).cast("long").alias("chunk"))
    known = cut(links.union(met(pilots)))
    label = connected_components(known).toDF("id", "component")
    label = members.select("id", "cluster", "n_shingles").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = label.groupBy("cluster", "component").count()
    largest = sizes.groupBy("cluster").agg(F.max_by("component", "count").alias("main"))
    rest = cut(label.join(largest, "cluster").where("component <> main").select("id", "cluster", "n_shingles"))
    chunks = rest.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / block_shingles).alias("chunks"))  # each is as large as a block, about
    rest = rest.join(chunks, "cluster").select("id", "cluster", F.pmod(F.xxhash64("id"), F.col("chunks").cast("long")).alias("chunk"))
    done = connected_components(cut(known.union(met(cut(rest)))))
    return done.toDF("src", "dst")
