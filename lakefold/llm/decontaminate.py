"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is short and may lie anywhere in a long document, so a signature of
fixed length would hardly ever keep one of its shingles. Documents are
therefore partitioned by set size into powers of two, and a partition's
one-permutation MinHash has twice as many bins as its largest set has shingles:
at least 78 % of a set's shingles are the minimum of their bin. Each item is
sketched once for every partition; an item and a document with an equal minimum
in a bin are a candidate, so an item of q shingles with a share t in the document
is missed with a probability of about 0.22 ** (t * q). Items too short for that
(under SHORT_ITEM shingles) are probed with all their shingles. Only candidates
are verified, by exact containment: all the item's shingles are looked up in the
document's set.

Items travel to the executors in blocks of bounded size, each searched against
all documents; a document is hashed where it is read, and no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakefold.llm import textkernel as tk
from lakefold.llm.shared import WORD, cut, short_batches, stored

#: Shingles of the items that are sent to the executors at once (8 bytes each, and as many bytes of item numbers).
BLOCK_SHINGLES = 1_000_000
#: Items with fewer shingles are probed with all of them; with so many, 0.8 contained, a miss has a probability of 4e-9.
SHORT_ITEM = 16
_FILTER_BITS = 22
_FOUND = "id long, item_id long, item_shingles long, hits long, row long"


def size_class(n: int) -> int:
    """The partition of a set of n shingles: sets of up to 2 ** class."""
    return max(0, int(n - 1).bit_length())


def are_minima(s: np.ndarray, c: int) -> np.ndarray:
    """One-permutation MinHash of a sorted set for partition c: which hashes are the least of one of 2 ** (c + 1) bins."""
    bins = s >> np.uint64(63 - c)
    return np.concatenate((np.ones(min(1, s.size), dtype=bool), bins[1:] != bins[:-1]))


class ItemIndex:
    """The shingles of a block of items, each with its items, and for each partition of documents which of them are probes."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray]):
        self.ids, self.sizes, self.sets = ids, np.array([s.size for s in sets], dtype=np.int64), sets
        self.short = self.sizes < SHORT_ITEM
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self._order = np.argsort(flat, kind="stable")
        self.hashes, first = np.unique(flat[self._order], return_index=True)
        self.first = np.append(first, flat.size)  # of each hash among the owners
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[self._order]
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[(self.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self._probes: dict[int, np.ndarray] = {}

    def probes(self, c: int) -> np.ndarray:
        """For each hash and item that has it, whether the item is probed with it in partition c."""
        if c not in self._probes:
            marks = [np.ones(s.size, dtype=bool) if short else are_minima(s, c) for s, short in zip(self.sets, self.short, strict=True)]
            self._probes[c] = np.concatenate(marks)[self._order] if marks else np.zeros(0, dtype=bool)
        return self._probes[c]

    def search(self, s: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
        """(item number, shared shingles) of the items of which the sorted set s holds percent or more."""
        near = self.filter[(s >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
        if not near.any():
            return
        c = size_class(s.size)
        maybe, least = s[near], are_minima(s, c)[near]
        at = np.minimum(np.searchsorted(self.hashes, maybe), self.hashes.size - 1)
        equal = self.hashes[at] == maybe
        candidates = set()
        for i, minimum in zip(at[equal], least[equal], strict=True):
            own = slice(self.first[i], self.first[i + 1])
            owners = self.owners[own]
            candidates.update(owners[self.probes(c)[own] & (self.short[owners] | minimum)].tolist())
        for k in sorted(candidates):
            place = np.minimum(np.searchsorted(s, self.sets[k]), s.size - 1)
            hits = int((s[place] == self.sets[k]).sum())
            if 100 * hits >= percent * self.sizes[k]:
                yield k, hits


def _search(block, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = block.value
        index = _indexed(ids, texts)
        for batch in batches:
            own, found = batch.column(0).to_pylist(), []
            for i, s in tk.shingle_sets(batch.column(1)):
                found += [(own[i], int(index.ids[k]), int(index.sizes[k]), n, int(s.size)) for k, n in index.search(s, percent)]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 5, ["id", "item_id", "item_shingles", "hits", "row"])

    return run


_indexes: dict[int, ItemIndex] = {}


def _indexed(ids: list[int], texts: list[str]) -> ItemIndex:
    """The index of a block; a worker builds it once."""
    key = hash((tuple(ids), tuple(texts)))
    if key not in _indexes:
        _indexes.clear()
        sets = [(ids[i], s) for i, s in tk.shingle_sets(pa.array(texts, pa.large_string())) if s.size]
        _indexes[key] = ItemIndex(np.array([i for i, _ in sets], dtype=np.int64), [s for _, s in sets])
    return _indexes[key]


def contaminated(docs: DataFrame, items: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Pairs (id, item_id, item_shingles, hits, containment): the document holds at least percent of the item's five-word shingles.

    Items and documents without words match nothing; an item of one to four
    words is one shingle, and matches documents of exactly those words. Rows
    with a null item_id are left out; documents with a null id are reported
    with a null id. Repeated documents are each reported; repeated rows of an
    item_id with equal text count once, with different texts they are items of
    their own. Other columns are ignored. Empty tables give no rows.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").distinct().withColumn("n", F.greatest(F.lit(1), F.regexp_count("text", F.lit(WORD))).cast("long"))
    items = cut(items.withColumn("r", F.xxhash64("item_id", "text")))
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total * 5 // (block_shingles * 4)))  # blocks by hash are uneven: a quarter to spare
    short_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = []
    for k in range(blocks):
        part = items.where(F.pmod("r", F.lit(blocks)) == k).select("item_id", "text").orderBy("item_id", "text").toArrow()
        block = spark.sparkContext.broadcast((part.column(0).to_pylist(), part.column(1).to_pylist()))
        found.append(texts.mapInArrow(_search(block, percent), _FOUND))
        if blocks > 1:  # one block's index at a time in a worker
            found[-1] = stored(found[-1], "found")
            block.unpersist()
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.select("id", "item_id", "item_shingles", "hits", (F.col("hits") / F.col("item_shingles")).alias("containment"))


def without_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs whose id no pair of contaminated() names, with docs' own columns.

    Rows with a null id are kept unless their text is found (a null id in the pairs drops all rows with a null id).
    """
    id_col = options.get("id_col", "doc_id")
    bad = contaminated(docs, items, **options).select(F.col("id").alias("__bad")).distinct()
    bad = stored(bad, "contaminated")
    few = bad.count() * 16 <= 16 << 20
    return docs.join(F.broadcast(bad) if few else bad, F.col(id_col).cast("long").eqNullSafe(F.col("__bad")), "left_anti")
