"""LM scoring by context-tree weighting over bytes, A-Z in lower case.

A symbol (a byte, or the end of the text) is coded by eight binary decisions.
Each decision has a tree of contexts, the preceding bytes up to ORDER of them;
every node counts its decisions and gives a Krichevsky-Trofimov estimate, and
the estimates of all depths on a path are mixed by the context-tree weights that
the training texts leave behind.

Spark counts strings of ORDER + 1 bytes and deals them by the three latest
context bytes. The two deepest levels are computed in runs of strings that share
their four latest bytes, at most 256 * 257 of them; the levels above are sums of
nodes, aggregated level by level, and only the last two (258 contexts at most)
come to the driver. Going down again, the mixture of the upper levels is linear
in the deeper ones' probability, so a node of depth three carries three numbers.
As the model is then fixed, a string's code length is one number, computed once
for each distinct string.

Texts are scored in blocks of bounded size. A block is written to the shared
folder, compressed, by the task that counts it and read again by the task that
scores it, so texts are never shuffled. A block asks only for the strings and
words that it has, by a shuffle, so neither the model nor the vocabulary is ever
broadcast, and what is gathered grows with the corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakefold.llm import textkernel as tk
from lakefold.llm.shared import fresh_path, held_out, short_batches, spread, store_of, stored

ORDER = 5
PAD, END = 0xFE, 0xFF  # bytes that UTF-8 never has
END_WORD = np.uint64(0x6A09E667F3BCC909)
WORDS, GRAMS = 0, 1
#: Bytes of text in a block, about.
BLOCK_BYTES = 24 << 20
#: Distinct strings whose deepest levels are computed at once, about.
CHUNK = 1 << 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NODES = "s long, u long, n0 double, n1 double, w double"
_KEYS = "block long, kind int, key long, n long"
_SCORES = "id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base double, score double"


def grams_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings of ORDER + 1 lower-cased bytes ending at each symbol of each row, its end included, and each row's first (n + 1)."""
    n, extra = offs.size - 1, ORDER + 1
    out = np.full(buf.size + extra * n, PAD, dtype=np.uint8)
    lengths = np.diff(offs)
    out[np.arange(buf.size) + np.repeat(extra * np.arange(n) + ORDER, lengths)] = _LOWER.take(buf)
    out[offs[1:] + extra * np.arange(n) + ORDER] = END
    own = out[ORDER:] != PAD
    out = np.concatenate((np.full(7 - ORDER, PAD, dtype=np.uint8), out))  # so that eight bytes end at each symbol
    wide = np.ndarray(shape=own.shape, dtype=">u8", buffer=out, strides=(1,))
    return wide[own].astype(np.uint64) & np.uint64((1 << 8 * (ORDER + 1)) - 1), np.concatenate(([0], np.cumsum(lengths + 1)))


def words_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's tokens, an end after its words, and each row's first (n + 1)."""
    h, rows = tk.word_hashes(buf, offs)
    n = offs.size - 1
    out = np.empty(h.size + n, dtype=np.uint64)
    out[np.arange(h.size) + np.repeat(np.arange(n), np.diff(rows))] = h
    out[rows[1:] + np.arange(n)] = END_WORD
    return out, rows + np.arange(n + 1)


class _Counter:
    """Distinct keys with counts, merged as they come."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, weight: int) -> None:
        keys, n = np.unique(keys, return_counts=True)
        self.parts.append((keys, n * weight))
        self.size += keys.size
        if len(self.parts) > 16 and self.size > 2 * self.parts[0][0].size:
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys = np.concatenate([k for k, _ in self.parts])
        n = np.concatenate([c for _, c in self.parts])
        self.parts = []
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        self.parts = [(keys[first], np.add.reduceat(n, first))]
        self.size = first.size
        return self.parts[0]


def _count_blocks(folder: str, block_bytes: int):
    """mapInArrow function: rows -> keys of each block, with their counts in its training texts (zero: only others have them).

    A block's texts are written below folder, in a file of the block's number. The number is random, so a task that runs
    again makes blocks of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows.append(batch.slice(lo, 256))
                size += rows[-1].column("text").nbytes
                if 2 * size >= 3 * block_bytes:  # so that what is left at the end makes no small block
                    sizes = np.cumsum([r.column("text").nbytes for r in rows])
                    k = int(np.searchsorted(sizes, block_bytes)) + 1
                    yield from _count_block(folder, rows[:k])
                    size -= int(sizes[k - 1])
                    del rows[:k]
        if rows:
            yield from _count_block(folder, rows)

    return run


def _count_block(folder: str, rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = uuid.uuid4().int >> 65
    store, base = store_of(folder)
    store.create_dir(base, recursive=True)
    counters = {WORDS: _Counter(), GRAMS: _Counter()}
    with store.open_output_stream(f"{base}/{block}") as file, pa.ipc.new_stream(file, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for batch in rows:
            out.write_batch(batch)
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            for lo, hi, buf, offs in tk.slices(batch.column("text")):
                for kind, made in ((WORDS, words_of), (GRAMS, grams_of)):
                    keys, first = made(buf, offs)
                    of = np.repeat(held[lo:hi], np.diff(first))
                    counters[kind].add(keys[~of], 1)
                    if of.any():
                        counters[kind].add(keys[of], 0)
    for kind, c in counters.items():
        keys, n = c.merged()
        for lo in range(0, keys.size, 1 << 16):
            k = keys[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k.size, block)), pa.array(np.full(k.size, kind, np.int32)), pa.array(tk.signed(k.astype(np.uint64))), pa.array(n[lo : lo + (1 << 16)].astype(np.int64))], ["block", "kind", "key", "n"])


_LGAMMA_HALF = lgamma(0.5)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x >= 0.5: Stirling's series at x + 6, taken back by the recurrence."""
    y = x + 6
    down = np.log(x * (x + 1) * (x + 2)) + np.log((x + 3) * (x + 4) * (x + 5))
    i = 1 / y
    series = i / 12 - i**3 / 360 + i**5 / 1260 - i**7 / 1680
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - down


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - 2 * _LGAMMA_HALF - _lgamma(n0 + n1 + 1.0)


class Level:
    """Decision nodes of one depth: for each (string, decision) the node's number, its counts, estimate and bit."""

    def __init__(self, context: np.ndarray, symbol: np.ndarray, n: np.ndarray):
        k = np.arange(8)
        node = (np.int64(1) << k)[None, :] | (symbol[:, None] >> (8 - k)[None, :])
        self.bit = ((symbol[:, None] >> (7 - k)[None, :]) & 1).astype(np.uint8).ravel()
        self.keys, self.number = np.unique((context[:, None] * 256 + node).ravel(), return_inverse=True)
        weight = np.repeat(n, 8).astype(np.float64)
        m = self.keys.size
        self.n1 = np.bincount(self.number, weight * self.bit, m)
        self.n0 = np.bincount(self.number, weight, m) - self.n1
        self.estimate = kt_log(self.n0, self.n1)

    def next_bit(self) -> np.ndarray:
        """The estimate of each string's bit after the training texts."""
        own = np.where(self.bit == 1, self.n1[self.number], self.n0[self.number])
        return (own + 0.5) / (self.n0 + self.n1 + 1.0)[self.number]


def _deep(keys: np.ndarray, n: np.ndarray) -> tuple[Level, Level, np.ndarray, np.ndarray]:
    """Depths ORDER and ORDER - 1 of whole groups of strings with ORDER - 1 latest context bytes in common: (both, the upper one's ln beta and ln weighted)."""
    symbol, context = keys & 0xFF, keys >> 8
    deep, upper = (Level(context & ((1 << 8 * d) - 1), symbol, n) for d in (ORDER, ORDER - 1))
    parent = np.zeros(deep.keys.size, dtype=np.int64)
    parent[deep.number] = upper.number
    below = np.bincount(parent, deep.estimate, upper.keys.size)
    return deep, upper, upper.estimate - below, np.logaddexp(upper.estimate, below) - np.log(2)


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about so many rows, sorted by o, that never part rows of one o."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held)
            o = table.column("o").to_numpy()
            end = int(np.searchsorted(o, o[-1]))
            if end:
                yield table.slice(0, end)
            rest = table.slice(end).combine_chunks()
            held, size = rest.to_batches(), rest.num_rows
    if size:
        yield pa.Table.from_batches(held)


def _third_level(chunk: int):
    """mapInArrow function: Strings sorted by o -> what the nodes of depth three have of each chunk: counts and the sum of the ln weighted below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches, chunk):
            _, upper, _, weighted = _deep(table.column("key").to_numpy(), table.column("n").to_numpy())
            keys, to = np.unique(upper.keys & 0xFFFFFFFF, return_inverse=True)
            sums = (pa.array(np.bincount(to, x, keys.size)) for x in (upper.n0, upper.n1, weighted))
            yield pa.RecordBatch.from_arrays([pa.array(keys >> 8), pa.array(keys & 0xFF), *sums], ["s", "u", "n0", "n1", "w"])

    return run


def _weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes with w, the sum of the ln weighted below -> with their own ln weighted, their share in the mixture and their estimates of either bit."""
    for batch in batches:
        n0, n1, below = (batch.column(c).to_numpy() for c in ("n0", "n1", "w"))
        estimate = kt_log(n0, n1)
        share = 1 / (1 + np.exp(-np.clip(estimate - below, -700, 700)))
        made = (np.logaddexp(estimate, below) - np.log(2), share, (n0 + 0.5) / (n0 + n1 + 1), (n1 + 0.5) / (n0 + n1 + 1))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("s", "u", "n0", "n1")), *map(pa.array, made)], ["s", "u", "n0", "n1", "w", "share", "p0", "p1"])


_WEIGHTED = f"{_NODES}, share double, p0 double, p1 double"


class Top:
    """Depths 1 and 0 as a linear function of the deeper levels' probability: base0, base1 and factor by (latest byte, node)."""

    def __init__(self, c: np.ndarray, u: np.ndarray, n0: np.ndarray, n1: np.ndarray, w: np.ndarray):
        counts, below = np.zeros((2, 256, 256)), np.zeros((256, 256))
        np.add.at(counts[0], (c, u), n0)
        np.add.at(counts[1], (c, u), n1)
        np.add.at(below, (c, u), w)
        estimate = kt_log(*counts)
        share1 = 1 / (1 + np.exp(-np.clip(estimate - below, -700, 700)))
        root = counts.sum(axis=1)
        weighted = np.logaddexp(estimate, below) - np.log(2)
        share0 = 1 / (1 + np.exp(-np.clip(kt_log(*root) - weighted.sum(axis=0), -700, 700)))
        own1, own0 = (counts + 0.5) / (counts.sum(axis=0) + 1), (root + 0.5) / (root.sum(axis=0) + 1)
        self.base = share0 * own0[:, None, :] + (1 - share0) * share1 * own1
        self.factor = (1 - share0) * (1 - share1)


def _folded(top_table):
    """mapInArrow function: nodes of depth three joined to those of depth two -> (o, key, n, b0, b1, f) of all depths up to three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, u = batch.column("s").to_numpy(), batch.column("u").to_numpy()
            base, factor = top_table.value.base[:, s & 0xFF, u], top_table.value.factor[s & 0xFF, u]
            for level in ("2", ""):
                share = batch.column(f"share{level}").to_numpy()
                base = base + factor * share * np.stack([batch.column(f"p{bit}{level}").to_numpy() for bit in (0, 1)])
                factor = factor * (1 - share)
            yield pa.RecordBatch.from_arrays([pa.array(s << 9), pa.array(u), pa.array(np.zeros(s.size, np.int64)), *map(pa.array, (base[0], base[1], factor))], ["o", "key", "n", "b0", "b1", "f"])

    return run


def string_log10(keys: np.ndarray, n: np.ndarray, nodes: np.ndarray, base: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """log10 P(symbol | context) of each string, in whole groups of _deep; nodes: those of depth three, sorted, with their linear function."""
    deep, upper, beta, _ = _deep(keys, n)
    p = _mix(beta[upper.number], upper.next_bit(), deep.next_bit())
    at = np.searchsorted(nodes, upper.keys & 0xFFFFFFFF)[upper.number]
    return np.log10(base[upper.bit, at] + factor[at] * p).reshape(-1, 8).sum(axis=1)


def _string_scores(chunk: int):
    """mapInArrow function: Nodes (o ends in nine zero bits) and strings sorted by o -> (key, value) of the strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None  # nodes of the last group of three bytes, of which more strings may come
        for table in _chunks(batches, chunk):
            o = table.column("o").to_numpy()
            node = (o & 511) == 0
            keys, n = table.column("key").to_numpy(), table.column("n").to_numpy()
            own = np.stack([table.column(c).to_numpy()[node] for c in ("b0", "b1", "f")])
            at = ((o[node] >> 9) << 8) | keys[node]
            order = np.argsort(at)
            nodes, own = at[order], own[:, order]
            if carried is not None:
                nodes, own = np.concatenate((carried[0], nodes)), np.concatenate((carried[1], own), axis=1)
            last = nodes >> 8 == o[-1] >> 9
            carried = nodes[last], own[:, last]
            if not node.all():
                value = string_log10(keys[~node], n[~node], nodes, own[:2], own[2])
                yield pa.RecordBatch.from_arrays([pa.array(keys[~node]), pa.array(value)], ["key", "value"])

    return run


def _mix(beta: np.ndarray, own: np.ndarray, deeper: np.ndarray) -> np.ndarray:
    share = 1 / (1 + np.exp(-np.clip(beta, -700, 700)))
    return share * own + (1 - share) * deeper


def _string_values(strings: DataFrame, parts: int, chunk: int = CHUNK) -> DataFrame:
    """(key, value): log10 P of each of the distinct strings (key, n)."""
    spark = strings.sparkSession
    context = F.shiftright("key", 8)
    place = F.shiftleft(context.bitwiseAND(0xFFFFFF), 9) + 256 + F.shiftright("key", 32).bitwiseAND(0xFF)
    strings = strings.select(place.alias("o"), "key", "n")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, F.shiftright("o", 9)).sortWithinPartitions("o")

    def above(nodes: DataFrame, mask: int) -> DataFrame:
        return nodes.groupBy(F.col("s").bitwiseAND(mask).alias("s"), "u").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "w")))

    third = dealt(strings).mapInArrow(_third_level(chunk), _NODES)
    third = stored(above(third, 0xFFFFFF).mapInArrow(_weighted, _WEIGHTED), "nodes")
    second = stored(above(third, 0xFFFF).mapInArrow(_weighted, _WEIGHTED), "nodes")
    first = above(second, 0xFF).toArrow()  # 258 * 256 rows at most
    top = spark.sparkContext.broadcast(Top(*(first.column(c).to_numpy() for c in ("s", "u", "n0", "n1", "w"))))
    upper = second.select(F.col("s").alias("s2"), "u", F.col("share").alias("share2"), F.col("p0").alias("p02"), F.col("p1").alias("p12"))
    joined = third.withColumn("s2", F.col("s").bitwiseAND(0xFFFF)).join(upper, ["s2", "u"]).select("s", "u", "share", "p0", "p1", "share2", "p02", "p12")
    nodes = joined.mapInArrow(_folded(top), "o long, key long, n long, b0 double, b1 double, f double")
    none = F.lit(0.0)
    rows = nodes.union(strings.select("o", "key", "n", none, none, none))
    return dealt(rows).mapInArrow(_string_scores(chunk), "key long, value double")


class Lookup:
    """Values by 64-bit key, open addressing; every key asked for is there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(8, int(keys.size * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits)
        free = np.ones(1 << bits, dtype=bool)
        slot, todo = self._slot(keys), np.arange(keys.size)
        while todo.size:
            at, first = np.unique(slot[todo], return_index=True)
            ok = free[at]
            at, who = at[ok], todo[first[ok]]
            self.keys[at], self.values[at], free[at] = keys[who], values[who], False
            todo = np.setdiff1d(todo, who, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.values.take(slot)
        todo = np.flatnonzero(self.keys.take(slot) != keys)
        slot = slot[todo]
        while todo.size:
            slot = (slot + 1) & self.mask
            out[todo] = self.values[slot]
            miss = self.keys[slot] != keys[todo]
            todo, slot = todo[miss], slot[miss]
        return out


def _score_block(folder: str):
    """applyInArrow function: the values of one block's strings and words -> scores of its rows."""

    def run(found: pa.Table) -> pa.Table:
        kind, key, value = (found.column(c).to_numpy() for c in ("kind", "key", "value"))
        own = kind == GRAMS
        grams = Lookup(key[own].view(np.uint64), value[own])
        words, counts = key[~own].view(np.uint64), value[~own]
        block = found.column("block")[0].as_py()
        del found, kind, key, value, own
        order = np.argsort(words)
        words, counts = words[order], counts[order]
        logs = np.log10(counts + 1)
        store, base = store_of(folder)
        with store.open_input_stream(f"{base}/{block}") as file, pa.ipc.open_stream(file) as texts:
            return pa.concat_tables([_scores(batch, grams, words, counts, logs) for batch in texts])

    return run


def _scores(batch: pa.RecordBatch, grams: Lookup, words: np.ndarray, counts: np.ndarray, logs: np.ndarray) -> pa.Table:
    n = batch.num_rows
    cols = {c: np.zeros(n) for c in ("base", "score")} | {c: np.zeros(n, np.int64) for c in ("n_bytes", "n_tokens", "n_known")}
    for lo, hi, buf, offs in tk.slices(batch.column("text")):
        cols["n_bytes"][lo:hi] = np.diff(offs)
        g, rows = grams_of(buf, offs)
        cols["score"][lo:hi] = np.add.reduceat(grams.get(g), rows[:-1])
        w, rows = words_of(buf, offs)
        at = np.searchsorted(words, w)
        cols["base"][lo:hi] = np.add.reduceat(logs[at], rows[:-1])
        cols["n_known"][lo:hi] = np.add.reduceat((counts[at] > 0).astype(np.int64), rows[:-1])
        cols["n_tokens"][lo:hi] = np.diff(rows)
    return pa.table({"id": batch.column("id"), "held_out": batch.column("held_out"), **{c: pa.array(cols[c]) for c in ("n_bytes", "n_tokens", "n_known", "base", "score")}})


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, mod: int = 7, chunk: int = CHUNK) -> DataFrame:
    """One row (id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) per row of docs.

    score is the model's log10 probability of the text's bytes, A-Z in lower case, and its end,
    base_score that of its lower-cased words and an end under counts with one
    added; both learn from the rows that are not held out, the scored row
    included. Null texts are empty; an empty text is its end alone. Null ids are
    not held out. Without training rows all decisions are even. Repeated rows
    count and score each; other columns are ignored; an empty table gives no
    rows.
    """
    short_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col, mod).alias("held_out"), text.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rows = rows.coalesce(max(2 * blocks, docs.sparkSession.sparkContext.defaultParallelism))  # small partitions make one block together
    folder = fresh_path(docs.sparkSession, "texts")
    keys = stored(rows.mapInArrow(_count_blocks(folder, block_bytes), _KEYS), "keys")
    counted = stored(keys.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counted")
    words = counted.where(F.col("kind") == WORDS)
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    strings = counted.where(F.col("kind") == GRAMS).select("key", "n")
    values = _string_values(strings, spread(strings, 4 * CHUNK), chunk).select(F.lit(GRAMS).alias("kind"), "key", "value")
    values = values.union(words.select("kind", "key", F.col("n").cast("double")))
    found = keys.select("block", "kind", "key").join(values, ["kind", "key"]).select("block", "kind", "key", "value")
    found = found.repartition(max(16, 2 * blocks), "block")  # a task has a block or two, however many there are
    scored = found.groupBy("block").applyInArrow(_score_block(folder), _SCORES)
    base = F.col("base") - F.col("n_tokens") * float(np.log10(tokens + distinct + 1))
    bits = -F.col("score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))
    return scored.select("id", "held_out", "n_bytes", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))
