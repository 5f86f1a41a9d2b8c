"""Sharding by minimax contiguous partition.

Equal texts are one atomic group. Groups stand in the order of a hash of their
text, and that order is cut into contiguous shards so that the largest shard is
as small as any cut can make it: a binary search over capacities, each checked
greedily.

The groups are never gathered. The driver holds a coarse picture: sizes of key
ranges. A capacity that is feasible with whole ranges bounds the answer from
above, one that is infeasible even if ranges could be divided freely bounds it
from below; only ranges in which a cut can lie between those bounds are
replaced by finer ones, until they are single groups. Each level asks for at
most a few hundred ranges, whatever the number of groups.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakefold.llm.shared import cut

#: Ranges of the first level, and pieces of a range of a later one.
FIRST_BITS, NEXT_BITS = 12, 6
#: Groups that the driver may read at once.
GROUPS_AT_ONCE = 50_000
#: Rows of a bucket in which slots are numbered, about.
BUCKET_ROWS = 4096


def greedy(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """Cuts (numbers of atoms before them) when each shard takes what fits; None if shards do not suffice. ends: running sums."""
    cuts, at, before = [], 0, 0
    for _ in range(shards):
        to = bisect_right(ends, before + capacity)
        if to >= len(ends):
            return cuts + [len(ends)] * (shards - 1 - len(cuts))
        if to == at:
            return None
        cuts.append(to)
        at, before = to, ends[to - 1]
    return None


def least_capacity(sizes: list[int], shards: int) -> int:
    """The smallest capacity under which contiguous shards of atomic sizes are enough."""
    if not sizes:
        return 0
    ends, total = [], 0
    for s in sizes:
        total += s
        ends.append(total)
    lo, hi = max(max(sizes), -(-total // shards)), total
    while lo < hi:
        mid = (lo + hi) // 2
        if greedy(ends, mid, shards) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo


def even_cuts(sizes: list[int], capacity: int, shards: int) -> list[int]:
    """Cuts with no shard above capacity, each as near to its even share as that allows."""
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    n, total = len(sizes), ends[-1]
    latest = [n] * (shards + 1)  # backwards: the first atom at which the last shards may begin
    for k in range(shards - 1, 0, -1):
        at, low = latest[k + 1], 0
        while low < at and ends[at] - ends[low] > capacity:
            step = (low + at) // 2
            if ends[at] - ends[step] > capacity:
                low = step + 1
            else:
                at_low = step
                while at_low > low and ends[at] - ends[at_low - 1] <= capacity:
                    at_low -= 1
                low = at_low
                break
        latest[k] = low
    cuts, at = [], 0
    for k in range(1, shards):
        high = bisect_right(ends, ends[at] + capacity) - 1
        near = bisect_right(ends, total * k // shards)
        if near > 0 and near <= n and total * k / shards - ends[near - 1] <= ends[near] - total * k / shards:
            near -= 1
        at = min(max(near, latest[k], at), high, n)
        cuts.append(at)
    return cuts


class _Atoms:
    """Ranges of keys in order: (key of the end, exclusive; size; whether it is one group)."""

    def __init__(self, shards: int):
        self.shards, self.rows = shards, []

    def doubtful(self) -> set[int]:
        """Numbers of the divisible ranges in which a cut of the best partition may lie."""
        sizes = [r["size"] for r in self.rows]
        n, total = self.shards, sum(sizes)
        ends, run = [], 0
        for s in sizes:
            run += s
            ends.append(run)
        high = least_capacity(sizes, n)
        widest = max([r["size"] for r in self.rows if not r["one"]], default=0)
        low = max([-(-total // n), high - widest, *(r["size"] for r in self.rows if r["one"])])
        out = set()
        at = 0
        for k in range(1, n):  # the k-th cut lies between k greedy shards of the low capacity and k full ones of the high, and after what n - k full ones can hold
            to = bisect_right(ends, (ends[at - 1] if at else 0) + low)
            at = min(max(to, at), len(sizes))
            first = min(at, bisect_right(ends, max(0, total - (n - k) * high)))
            last = bisect_right(ends, min(total, k * high))
            out.update(range(max(0, first - 1), min(len(sizes), last + 1)))
        return {i for i in out if not self.rows[i]["one"]}


def shard_keys(rows: DataFrame, shards: int, groups_at_once: int = GROUPS_AT_ONCE) -> list[tuple[int, int]]:
    """The first keys (h1, h2) of shards 1, 2, ... of the minimax partition; rows: (h1, h2, size), h1 and h2 spread over all longs."""
    top = 1 << 63
    bits = FIRST_BITS
    level = F.shiftright("h1", 64 - bits).alias("r")
    got = rows.groupBy(level).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    atoms = _Atoms(shards)
    width = 1 << (64 - bits)
    atoms.rows = [{"lo": (r["r"] * width, -top), "width": width, "size": r["size"], "n": r["n"], "one": False} for r in sorted(got, key=lambda r: r["r"])]
    while open_ := sorted(atoms.doubtful()):
        groups = sum(atoms.rows[i]["n"] for i in open_)
        width = min(atoms.rows[i]["width"] for i in open_)
        inside = _within(F.col("h1"), [(atoms.rows[i]["lo"][0], atoms.rows[i]["width"]) for i in open_])
        if groups <= groups_at_once or width == 1:
            fine = rows.where(inside).groupBy("h1", "h2").agg(F.sum("size").alias("size")).collect()
            new = [{"lo": (r["h1"], r["h2"]), "width": 0, "size": r["size"], "n": 1, "one": True} for r in fine]
        else:
            bits = min(64, 64 - width.bit_length() + 1 + NEXT_BITS)
            piece = 1 << (64 - bits)
            fine = rows.where(inside).groupBy(F.shiftright("h1", 64 - bits).alias("r")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("h1").alias("x"), F.min("h1").alias("y"), F.max("h2").alias("p"), F.min("h2").alias("q")).collect()
            new = []
            for r in fine:  # a range that holds one group is done, however many rows the group has
                one = r["x"] == r["y"] and r["p"] == r["q"]
                new.append({"lo": (r["y"], r["q"]) if one else (r["r"] * piece, -top), "width": piece, "size": r["size"], "n": r["n"], "one": one})
        stay = [r for i, r in enumerate(atoms.rows) if i not in set(open_)]
        atoms.rows = sorted(stay + new, key=lambda r: r["lo"])
    sizes = [r["size"] for r in atoms.rows]
    cuts = even_cuts(sizes, least_capacity(sizes, shards), shards)
    return [atoms.rows[c]["lo"] if c < len(sizes) else (top - 1, top - 1) for c in cuts]


def _within(h1: Column, ranges: list[tuple[int, int]]) -> Column:
    """h1 lies in one of the ranges (first key, width), whose widths are a few powers of two."""
    widths = {w for _, w in ranges}
    return reduce(or_, [F.shiftright(h1, w.bit_length() - 1).isin([lo // w for lo, x in ranges if x == w]) for w in widths])


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", extra_bytes: int = 8, groups_at_once: int = GROUPS_AT_ONCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row (id, size, text_crc32, law, shard, slot, grown_shard) per row of docs.

    size is the text's bytes in UTF-8 (null: none) plus extra_bytes; equal texts
    lie in one shard (null texts are equal to each other alone); the law is
    'bytes': no other contiguous cut of the groups has a smaller largest shard.
    slot numbers a shard's rows from 0, in an order of no meaning; text_crc32 of a null text and grown_shard
    are null. Null or repeated ids and repeated rows are placed like others.
    Other columns are ignored; an empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text).cast("long"), F.lit(0)) + extra_bytes).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(1), text, text.isNull()).alias("h1"),
        F.xxhash64(F.lit(2), text, text.isNull()).alias("h2"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = cut(rows)
    keys = shard_keys(rows, shards, groups_at_once)
    shard = F.lit(0)
    for h1, h2 in keys:
        first = F.struct(F.lit(h1).cast("long"), F.lit(h2).cast("long"))
        shard = shard + (F.struct("h1", "h2") >= first).cast("int")
    rows = rows.withColumn("shard", shard.cast("int"))
    bits = max(1, (-(-rows.count() // (bucket_rows * shards))).bit_length())
    # rows are told apart by their number, so equal and null ids spread like others; the checkpoint holds the numbers
    rows = rows.withColumn("o", F.xxhash64(F.lit(3), "row")).withColumn("bucket", F.shiftrightunsigned("o", 64 - bits))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    slot = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("o", "row")) - 1
    return rows.withColumn("inside", slot).join(counts.select("shard", "bucket", "before"), ["shard", "bucket"]).select(
        "id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("inside")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
