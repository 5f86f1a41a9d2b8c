"""Removal of long repeated byte strings by a column-wise, multi-document construction.

Every window of at least `passage` bytes is assigned to the least hash of the
ANCHOR-byte pieces of its first `passage` bytes, its anchor. Equal windows have
equal anchors at equal places, so windows can only be equal if their anchors
are. An anchor that occurs once settles its windows; for the others, the text
around the anchor (all its windows, of up to `length` bytes) is gathered by the
anchor's hash, each distinct context once.

The contexts of an anchor are documents aligned at the anchor. Their collection
transform is built column by column from the right: each round inserts one
symbol of every document, sorts the documents stably by (anchor, symbol) and
updates the common prefixes with the neighbour in that order. A window whose
common prefix with a neighbour reaches `length` occurs elsewhere and is removed;
one whose prefix reaches `passage` is counted as a shared passage. The columns
of a batch of documents are written to a sequential file of the shared folder
first and streamed back one column per round.

An anchor with more contexts than one task should hold (a passage that a large
share of all documents has, in different surroundings) is split into its windows:
each goes by its place and first `passage` bytes, and by all its bytes, and is
counted; no text moves for that.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakefold.llm import textkernel as tk
from lakefold.llm.shared import fresh_path, short_batches, store_of, stored

LENGTH = 400
#: Bytes from which a repeated string counts as a shared passage: fifty short words, about.
PASSAGE = 256
#: Bytes of an anchor.
ANCHOR = 32
#: Documents (contexts) whose columns are inserted together, about.
BATCH_ROWS = 4096
#: Contexts of an anchor that are aligned together; larger groups are split.
GROUP_ROWS = 16384
#: Windows of a longer text are assigned to anchors piece by piece.
PIECE = 4 << 20
_POSITION_BITS = np.uint64(28)
_ANCHORS = "id long, th long, h long, ch long, lo int, span int, to int, at int"
_WINDOWS = "h long, ch long, n long, first long, whole long, skip int, full boolean"
_FOUND = "h long, ch long, long_string boolean, starts array<int>, ends array<int>"


def window_anchors(buf: np.ndarray, offs: np.ndarray, length: int, passage: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Anchors of the windows of all rows of a slice: (row, first window, windows after it, context's end, anchor's place, its hash, its context's hash).

    Places count from the row's first byte. A run of neighbouring windows with
    one anchor is one entry; its context ends `length` bytes after its last
    window's start, or with the row.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(5)) + (np.zeros(0, np.uint64),) * 2
    if buf.size < passage:
        return none
    sums, q = tk.byte_sums(buf, False)
    n = buf.size - anchor + 1
    place = np.arange(n)
    h = tk.span_hashes(sums, q, place, place + anchor)
    keyed = (h & ~((np.uint64(1) << _POSITION_BITS) - np.uint64(1))) | place.astype(np.uint64)
    least = _sliding_least(keyed, passage - anchor + 1)
    row = np.searchsorted(offs, np.arange(least.size), "right") - 1
    inside = offs[row + 1] - np.arange(least.size) >= passage
    fresh = np.ones(least.size, dtype=bool)
    fresh[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], least.size) - 1
    good = inside[first]
    first, last = first[good], last[good]
    if not first.size:
        return none
    at = (least[first] & ((np.uint64(1) << _POSITION_BITS) - np.uint64(1))).astype(np.int64)
    end = np.minimum(last + length, offs[row[first] + 1])
    context = tk.span_hashes(sums, q, first, end) + tk.mix((at - first).astype(np.uint64) + np.uint64(1))
    base = offs[row[first]]
    return row[first], first - base, last - first, end - base, at - base, h[at], context


def _sliding_least(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours: of a block's suffix and the next one's prefix."""
    if a.size < w:
        return a[:0]
    blocks = -(-a.size // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: a.size] = a
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = a.size - w + 1
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def _pieces(buf: np.ndarray, offs: np.ndarray, length: int, passage: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int]]:
    """(first byte, bytes, offsets, first and end of the places at which runs of windows begin that are this piece's) of a slice.

    A single long row comes in pieces that overlap, so that each run of windows
    is seen whole, with the window before it, in the piece where it begins.
    """
    if offs.size > 2 or buf.size <= PIECE:
        yield 0, buf, offs, 0, buf.size
        return
    for at in range(0, buf.size, PIECE):
        skip = max(0, at - passage)
        part = buf[skip : at + PIECE + passage + length]
        yield skip, part, np.array([0, part.size]), at - skip, at - skip + PIECE


def _anchor_batches(length: int, passage: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = batch.column("id"), batch.column("th")
            for lo, _, buf, offs in tk.slices(batch.column("text")):
                for skip, part, bounds, least, end in _pieces(buf, offs, length, passage):
                    row, first, span, to, at, h, ch = window_anchors(part, bounds, length, passage, anchor)
                    if part.size < buf.size:
                        own = (first >= least) & (first < end)
                        row, first, span, to, at, h, ch = (x[own] for x in (row, first, span, to, at, h, ch))
                    if row.size:
                        pick = pa.array(row + lo)
                        numbers = (pa.array(x.astype(np.int32)) for x in (first + skip, span, to + skip, at + skip))
                        yield pa.RecordBatch.from_arrays([ids.take(pick), th.take(pick), pa.array(tk.signed(h)), pa.array(tk.signed(ch)), *numbers], ["id", "th", "h", "ch", "lo", "span", "to", "at"])

    return run


class ColumnwiseTransform:
    """The order and common prefixes of aligned documents, one inserted column at a time."""

    def __init__(self, group: np.ndarray):
        self.group = group  # of each document, ascending
        self.order = np.arange(group.size)
        self.common = np.zeros(group.size + 1, dtype=np.int32)  # with the one before in order; one guard at the end

    def insert(self, column: np.ndarray, present: np.ndarray) -> None:
        """One symbol of every document; where none is present, common prefixes end."""
        symbols, here = column[self.order], present[self.order]
        groups = self.group[self.order]
        together = groups[1:] == groups[:-1]
        equal = together & (symbols[1:] == symbols[:-1]) & here[1:] & here[:-1]
        if (equal | ~together).all():
            self.common[1:-1] = np.where(equal, self.common[1:-1] + 1, 0)
            return
        key = groups * 512 + np.where(here, symbols.astype(np.int64) + 1, 0)
        by = np.argsort(key, kind="stable")
        key = key[by]
        kin = np.flatnonzero((key[1:] == key[:-1]) & here[by][1:])
        common = np.zeros_like(self.common)
        if kin.size:
            spans = np.stack([by[kin] + 1, by[kin + 1] + 1], axis=1).ravel()
            common[kin + 1] = np.minimum.reduceat(self.common, spans)[::2] + 1
        self.order, self.common = self.order[by], common

    def longest(self) -> np.ndarray:
        """For each document, the longer common prefix with its two neighbours in order, from the last column on."""
        out = np.empty(self.order.size, dtype=np.int32)
        out[self.order] = np.maximum(self.common[:-1], self.common[1:])
        return out


def repeated_windows(group: np.ndarray, texts: list[bytes], at: np.ndarray, lengths: tuple[int, ...], folder: str) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each length and context, runs (first, last) of starts (from the context's first byte) of strings that another context of its group has too.

    group: ascending numbers; at: the anchor's place in each context; folder:
    where the file of columns is kept meanwhile.
    """
    left = int(at.max())
    ends = np.array([len(t) for t in texts]) - at
    width = left + int(ends.max())
    m = len(texts)
    transform = ColumnwiseTransform(group)
    starts = left - at  # the column of each context's first byte
    stops = left + ends
    rows = np.zeros((m, width), dtype=np.uint8)
    for i, t in enumerate(texts):
        rows[i, starts[i] : stops[i]] = np.frombuffer(t, dtype=np.uint8)
    store, base = store_of(folder)
    store.create_dir(base, recursive=True)
    path = f"{base}/{uuid.uuid4().hex}"
    with store.open_output_stream(path) as file:  # columns, last first, as the rounds read them
        file.write(np.ascontiguousarray(rows.T[::-1]))
    del rows
    with store.open_input_stream(path) as file:
        flagged = [np.zeros(m, dtype=bool) for _ in lengths]
        runs: list[list[list[int]]] = [[[] for _ in range(m)] for _ in lengths]  # first and last of each run, right to left
        for column in range(width - 1, -1, -1):
            symbols = np.frombuffer(file.read(m), dtype=np.uint8)
            transform.insert(symbols, (starts <= column) & (column < stops))
            longest = transform.longest()
            for k, length in enumerate(lengths):
                now = longest >= length
                for i in np.flatnonzero(now != flagged[k]):
                    runs[k][i].append(column - int(starts[i]) + (0 if now[i] else 1))
                flagged[k] = now
        for k in range(len(lengths)):
            for i in np.flatnonzero(flagged[k]):
                runs[k][i].append(-int(starts[i]))
    store.delete_file(path)
    return [[(np.maximum(np.array(r[1::2], dtype=np.int32), 0), np.array(r[::2], dtype=np.int32)) for r in own] for own in runs]


def _transform_batches(lengths: tuple[int, ...], batch_rows: int, folder: str):
    """mapInArrow function over contexts sorted by h: the runs of repeated strings of each, by length (the longer first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, bytes]] = []

        def out() -> Iterator[pa.RecordBatch]:
            h = np.array([x[0] for x in held], dtype=np.int64)
            group = np.concatenate(([0], np.cumsum(h[1:] != h[:-1])))
            texts = [x[4] for x in held]
            by_length = repeated_windows(group, texts, np.array([x[3] for x in held]), lengths, folder)
            for k, found in enumerate(by_length):
                own, first, last = [], [], []
                for i, ((a, b), (_, _, n, _, text)) in enumerate(zip(found, held, strict=True)):
                    if n > 1 and len(text) >= lengths[k]:  # the whole context occurs more than once
                        a, b = np.zeros(1, np.int32), np.array([len(text) - lengths[k]], np.int32)
                    if a.size:
                        own.append(i)
                        first.append(a)
                        last.append(b)
                lists = (pa.array(x, pa.list_(pa.int32())) for x in (first, last))
                yield pa.RecordBatch.from_arrays([pa.array(h[own]), pa.array([held[i][1] for i in own], pa.int64()), pa.array([k == 0] * len(own), pa.bool_()), *lists], ["h", "ch", "long_string", "starts", "ends"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "ch", "n", "at", "context")), strict=True):
                if held and row[:2] == held[-1][:2]:  # rows of one text with one id give a context twice; n counts them already
                    continue
                if len(held) >= batch_rows and row[0] != held[-1][0]:
                    yield from out()
                    held = []
                held.append(row)
        if held:
            yield from out()

    return run


def _window_batches(length: int, passage: int):
    """mapInArrow function over contexts: each window, with hashes of its place and first `passage` bytes, and of all its bytes; full: it has `length`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in tk.slices(batch.column("context")):
                own = batch.slice(lo, hi - lo)
                at, span = (own.column(c).to_numpy().astype(np.int64) for c in ("at", "span"))
                row = np.repeat(np.arange(hi - lo), span + 1)
                skip = np.arange(row.size) - (np.cumsum(span + 1) - span - 1)[row]
                sums, q = tk.byte_sums(buf, False)
                start = offs[row] + skip
                end = np.minimum(start + length, offs[row + 1])
                anchor = own.column("h").to_numpy().view(np.uint64)[row] + (at[row] - skip).astype(np.uint64)
                first = tk.mix(anchor ^ tk.span_hashes(sums, q, start, start + passage))
                whole = tk.mix(anchor ^ tk.span_hashes(sums, q, start, end))
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(own.column(c).take(pick) for c in ("h", "ch", "n")), pa.array(tk.signed(first)), pa.array(tk.signed(whole)), pa.array(skip.astype(np.int32)), pa.array(end - start == length)], ["h", "ch", "n", "first", "whole", "skip", "full"])

    return run


def _counted_windows(hot: DataFrame, length: int, passage: int) -> DataFrame:
    """(h, ch, long_string, starts, ends) of contexts: every window that occurs more than once is a run of its own."""
    windows = stored(hot.mapInArrow(_window_batches(length, passage), _WINDOWS), "parts")
    whole = windows.groupBy("first", "whole").agg(F.sum("n").alias("times"))
    first = whole.groupBy("first").agg(F.sum("times").alias("total")).where("total > 1")
    repeated = stored(whole.join(first, "first").select("first", "whole", "times"), "repeated")
    met = windows.join(repeated, ["first", "whole"])
    kinds = F.explode(F.when(F.col("full") & (F.col("times") > 1), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False))))
    return met.select("h", "ch", kinds.alias("long_string"), F.col("skip").alias("starts"), F.col("skip").alias("ends"))


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs (first byte, end) of possibly overlapping or touching spans."""
    runs: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if runs and lo <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], hi))
        else:
            runs.append((lo, hi))
    return runs


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with spans: text, if any, without its long strings; the others pass."""
    for batch in batches:
        n = batch.num_rows
        n_removed, n_spans, n_shared = (np.zeros(n, dtype=np.int64) for _ in range(3))
        digest, kept = batch.column("digest").to_pylist(), batch.column("text")
        cut_texts = {}
        spans = batch.column("spans")
        for i in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)):
            own = spans[int(i)].as_py()
            n_shared[i] = sum(hi - lo for lo, hi in covered([(s["s"], s["e"]) for s in own if not s["long_string"]]))
            runs = covered([(s["s"], s["e"]) for s in own if s["long_string"]])
            raw = kept[int(i)].as_buffer().to_pybytes()
            n_removed[i], n_spans[i] = sum(hi - lo for lo, hi in runs), len(runs)
            left = b"".join(raw[lo:hi] for lo, hi in zip([0, *(hi for _, hi in runs)], [*(lo for lo, _ in runs), len(raw)], strict=True))
            digest[i] = hashlib.sha256(left).hexdigest()
            cut_texts[int(i)] = left
        if cut_texts:
            kept = pa.array([cut_texts.get(i, t) for i, t in enumerate(kept.to_pylist())], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *(pa.array(x) for x in (n_removed, n_spans, n_shared)), pa.array(digest, pa.string()), kept], ["id", "n_bytes", "n_removed", "n_spans", "n_shared", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, passage: int = PASSAGE, anchor: int = ANCHOR, with_text: bool = True, batch_rows: int = BATCH_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row (id, n_bytes, n_removed, n_spans, n_shared, kept_sha256, kept) per row of docs.

    Every byte that a string of `length` bytes covers which also starts anywhere
    else, in this or another row, is removed; kept is the rest (where with_text is
    false, null for rows that lose nothing). n_shared counts the bytes that
    repeated strings of `passage` bytes cover, which stay unless they are part of
    a longer one. Null texts are empty; texts shorter than passage stay whole. Null
    and repeated ids and repeated rows are rows like others: two equal rows of
    length bytes or more are both removed wholly. Other columns are ignored; an
    empty table gives no rows. anchor <= passage <= length. group_rows: contexts
    of one anchor beyond which it is split.
    """
    short_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    anchors = stored(rows.where(F.octet_length("text") >= passage).mapInArrow(_anchor_batches(length, passage, anchor), _ANCHORS), "anchors")
    contexts = anchors.groupBy("h", "ch").agg(F.count("*").alias("n"), F.min(F.struct(F.coalesce("id", F.lit(-(1 << 63))), "th", "lo", "span", "to", "at")).alias("r"))
    repeated = contexts.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").alias("m")).where("total > 1").select("h", "m")
    kept = stored(contexts.join(repeated, "h").select("h", "ch", "n", "m", "r.*").toDF("h", "ch", "n", "m", "rid", "rth", "lo", "span", "to", "at"), "contexts")
    # an id on several rows of one text: the text is the same
    owners = rows.withColumn("own", F.coalesce("id", F.lit(-(1 << 63)))).join(kept, F.expr("own = rid AND th = rth"))
    bytes_ = F.substring(F.col("text").cast("binary"), F.col("lo") + 1, F.col("to") - F.col("lo"))
    cutouts = stored(owners.select("h", "ch", "n", "m", (F.col("at") - F.col("lo")).alias("at"), "span", bytes_.alias("context")), "cutouts")
    cool = cutouts.where(F.col("m") <= group_rows)
    parts = max(16, -(-cool.count() // 10_000))
    aligned = cool.select("h", "ch", "n", "at", "context").repartition(parts, "h").sortWithinPartitions("h", "ch")
    found = aligned.mapInArrow(_transform_batches((length, passage), batch_rows, fresh_path(docs.sparkSession, "columns")), _FOUND)
    found = stored(found, "windows").select("h", "ch", "long_string", F.explode(F.arrays_zip("starts", "ends")).alias("w")).select("h", "ch", "long_string", "w.*")
    hot = cutouts.where(F.col("m") > group_rows)
    if hot.limit(1).count():
        hot = hot.dropDuplicates(["h", "ch"]).select("h", "ch", "n", "at", "span", "context")
        found = found.union(stored(_counted_windows(hot, length, passage), "windows"))
    size = F.when(F.col("long_string"), length).otherwise(passage)
    hits = anchors.join(found, ["h", "ch"]).select("id", "th", (F.col("lo") + F.col("starts")).alias("s"), (F.col("lo") + F.col("ends") + size).alias("e"), "long_string").distinct()
    spans = hits.groupBy("id", "th").agg(F.collect_list(F.struct("s", "e", "long_string")).alias("spans"))
    spans = stored(spans, "spans")
    narrow = spans.toDF("sid", "sth", "spans")
    joined = rows.join(narrow, F.col("id").eqNullSafe(F.col("sid")) & (F.col("th") == F.col("sth")), "left")
    whole = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    sent = whole if with_text else F.when(F.col("spans").isNotNull(), whole)
    digest = F.when(F.col("spans").isNull(), F.sha2(whole, 256))
    schema = "id long, n_bytes long, n_removed long, n_spans long, n_shared long, kept_sha256 string, kept binary"
    return joined.select("id", sent.alias("text"), F.length(whole).cast("long").alias("n_bytes"), digest.alias("digest"), "spans").mapInArrow(_removed, schema)
