"""What the two text classifiers share: the labelled rows in shards, rounds of descent over all of them, and scoring straight from Arrow's string buffers."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold.llm.shared import BATCH_ROWS, forget, fresh_path, held_out, made_since, short_batches, small, store_of, stored

#: Bytes of texts that are turned into features at once.
FIT_SLICE = 1 << 18
#: Labelled rows that one task learns from in a round, about.
SHARD_ROWS = 4096
#: Rows of a shard that are read, and dealt in a new order, at once.
FIT_ROWS = BATCH_ROWS
#: Buckets of a table that are merged in one group.
PIECE = 1 << 13
#: Changes are summed as integers, in steps of one part in so many, so that the order of the tasks does not matter.
STEPS = 1 << 30

_CHANGES = "model int, piece int, n long, ids binary, change binary"


#: Labelled rows of each class that a model is fitted on, at most.
SAMPLE_PER_CLASS = 1500


class Model(Protocol):
    """Tables with a row for each bucket, equally many in all, and a vector of all other parameters."""

    def tables(self) -> list[np.ndarray]: ...
    def dense(self) -> np.ndarray: ...
    def set_dense(self, values: np.ndarray) -> None: ...


@dataclass
class Shards:
    """Labelled rows (h, y, lang, text) in Parquet files of about SHARD_ROWS each, in the order of the ids' hash h; and the number of rows of each class."""

    path: str
    files: list[str]
    counts: np.ndarray

    def read(self, k: int) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        with store.open_input_file(self.files[k]) as file:
            yield from pq.ParquetFile(file).iter_batches(FIT_ROWS)


def labelled_shards(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None) -> Shards:
    """All labelled rows that are not held out, stored below the shared folder.

    Null labels and null ids are left out; an id labelled twice has its largest
    label; a null text is empty; an id on several documents brings one text, the
    one of least hash.
    """
    own = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, 4))
    mark = len(made_since(0))
    own = stored(own.groupBy(F.col(id_col).cast("long").alias("__id")).agg((F.max(label) > 0).cast("int").alias("y")), "labelled")
    n = max(1, -(-own.count() // SHARD_ROWS))
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.where(~held_out(id_col, 4)).select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), lang.alias("l"))
    found = rows.join(small(own, 16), "__id").repartition(n, "__id").groupBy("__id", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t", "l")).alias("r"))
    found = found.coalesce(n).select(F.xxhash64("__id").alias("h"), "y", F.col("r.l").alias("lang"), F.col("r.t").alias("text"))
    path = fresh_path(docs.sparkSession, "shards")
    found.sortWithinPartitions("h").write.parquet(path)
    counts = np.zeros(2, dtype=np.int64)
    for r in docs.sparkSession.read.schema("h long, y int, lang string, text string").parquet(path).groupBy("y").count().collect():
        counts[r["y"]] = r["count"]
    store, base = store_of(path)
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(base)) if f.base_name.startswith("part-"))
    forget(docs.sparkSession, made_since(mark)[:1])
    return Shards(path, files, counts)


def fit_rounds(spark: SparkSession, models: list[Model], shards: Shards, rounds: int, learn: Callable) -> None:
    """Descent over all rows in rounds: in each, every shard starts from the models of the round before and takes all its rows once; then the changes are averaged.

    learn(models, batch, round, rngs) takes the steps of one batch, rngs being a generator for each model. A bucket's
    change is the mean over the shards that changed it, as a rare word is in few
    of them; the other parameters' is the mean over all, by rows.
    """
    n = len(shards.files)
    for k in range(rounds):
        sent = spark.sparkContext.broadcast((models, shards))

        def run(batches: Iterator[pa.RecordBatch], k=k, sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    before, own = sent.value
                    after, rows = copy.deepcopy(before), 0
                    rngs = [np.random.Generator(np.random.PCG64([13, k, shard, m])) for m in range(len(before))]
                    for part in own.read(shard):
                        learn(after, part, k, rngs)
                        rows += part.num_rows
                    if rows:
                        yield _changes(before, after, rows)

        changes = spark.range(0, n, 1, n).mapInArrow(run, _CHANGES)
        for r in changes.groupBy("model", "piece").applyInArrow(_merged, _CHANGES).collect():
            model, change = models[r["model"]], np.frombuffer(r["change"], dtype=np.int64) / STEPS
            if r["piece"] < 0:
                model.set_dense((model.dense() + change).astype(np.float32))
                continue
            ids, at = np.frombuffer(r["ids"], dtype=np.int64), 0
            change = change.reshape(ids.size, -1)
            for table in model.tables():
                flat = table.reshape(len(table), -1)
                flat[ids] += change[:, at : at + flat.shape[1]].astype(np.float32)
                at += flat.shape[1]
        sent.destroy()


def _changes(before: list[Model], after: list[Model], rows: int) -> pa.RecordBatch:
    """The changes of one shard: those of changed buckets, piece by piece, and those of the other parameters, times its rows."""
    out = []
    for m, (old, new) in enumerate(zip(before, after, strict=True)):
        out.append((m, -1, rows, b"", _whole((new.dense().astype(np.float64) - old.dense()) * rows)))
        pairs = [(a.reshape(len(a), -1), b.reshape(len(b), -1)) for a, b in zip(old.tables(), new.tables(), strict=True)]
        changed = np.flatnonzero(np.any([(a != b).any(axis=1) for a, b in pairs], axis=0))
        for ids in np.split(changed, np.flatnonzero(np.diff(changed // PIECE)) + 1):
            if ids.size:
                change = np.hstack([b[ids].astype(np.float64) - a[ids] for a, b in pairs])
                out.append((m, int(ids[0]) // PIECE, rows, ids.astype(np.int64).tobytes(), _whole(change)))
    return _batch(out)


def _whole(change: np.ndarray) -> bytes:
    return np.rint(change * STEPS).astype(np.int64).tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = {"model": pa.int32(), "piece": pa.int32(), "n": pa.int64(), "ids": pa.binary(), "change": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], list(types))


def _merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean changes of a piece of a model, one shard after the other."""
    model, piece = (x.as_py() for x in key)
    total, times, rows = 0, np.zeros(PIECE, dtype=np.int64), 0
    for batch in batches:
        for n, ids, change in zip(*(batch.column(c).to_pylist() for c in ("n", "ids", "change")), strict=True):
            change = np.frombuffer(change, dtype=np.int64)
            rows += n
            if piece < 0:
                total = total + change
                continue
            own = np.frombuffer(ids, dtype=np.int64) - piece * PIECE
            change = change.reshape(own.size, -1)
            if not rows - n:
                total = np.zeros((PIECE, change.shape[1]), dtype=np.int64)
            total[own] += change
            times[own] += 1
    if piece < 0:
        yield _batch([(model, piece, rows, b"", np.rint(total / rows).astype(np.int64).tobytes())])
        return
    ids = np.flatnonzero(times)
    yield _batch([(model, piece, rows, (ids + piece * PIECE).tobytes(), np.rint(total[ids] / times[ids, None]).astype(np.int64).tobytes())])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None) -> tuple[pa.Array, np.ndarray, list, float]:
    """(texts, labels, languages, share of label 1 among all labelled training rows), on the driver.

    The sample is bounded: at most per_class ids of each class, those with the
    least hash, of the rows that are not held out. Null labels and null ids are
    left out; an id labelled twice has its largest label; a null text is empty;
    an id on several documents brings one text, the one of least hash.
    """
    own = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, 4))
    own = own.groupBy(F.col(id_col).cast("long").alias("__id")).agg((F.max(label) > 0).cast("int").alias("__y"))
    counts = {r["__y"]: r["count"] for r in own.groupBy("__y").count().collect()}
    picked = []
    for y in (0, 1):
        picked += own.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(per_class).collect()
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r["__id"], r["__y"]) for r in picked], "__id long, __y int")
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), lang.alias("l"))
    found = rows.join(F.broadcast(chosen), "__id").groupBy("__id", "__y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t", "l")).alias("r"))
    got = found.select("__id", "__y", "r.t", "r.l").toArrow().sort_by("__id")
    texts = got.column("t").combine_chunks() if got.num_rows else pa.array([], pa.string())
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return texts, np.array(got.column("__y").to_pylist(), dtype=np.int64), got.column("l").to_pylist(), share


def probability(text: Column, sent, logits: Callable, docs: DataFrame) -> Column:
    """The logistic of logits(texts, model) for each text, sent being the broadcast model; null texts are empty."""
    short_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-np.clip(logits(texts, sent.value), -40, 40))))

    return score(text)
