"""Structured Streaming: replay of a frame in batches, sinks on shared storage, output modes, a logical clock with batch windows.

Staged input, results, history and checkpoints lie below the session's shared
folder, so any executor and a restarted driver see them.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakefold.operators.persist import fresh_path, opened


def staged(df: DataFrame, batch: Column, batches: int, files: int = 1) -> DataFrame:
    """df as a stream of `batches` micro-batches: the rows whose batch number is k come in the k-th.

    Batches are written one after the other, so the file source, which orders
    by time, finds them in order. files: files of a batch, and tasks that write
    it; a batch with fewer rows than files raises. Rows whose number is null or
    outside the range are left out; a batch without rows is an empty one.
    """
    spark = df.sparkSession
    folder = fresh_path(spark, "stream")
    numbered = df.withColumn("__k", batch.cast("int"))
    for k in range(batches):
        rows = numbered.where(F.col("__k") == k).drop("__k")
        (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.mode("append").parquet(folder)
    if files > 1 and len(spark.read.schema(df.schema).parquet(folder).inputFiles()) != batches * files:
        raise ValueError(f"a batch does not fill {files} files")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _written(df: DataFrame, mode: str, f: Callable[[DataFrame, int], DataFrame], checkpoint: str | None) -> tuple[str, list[int]]:
    """f over all available micro-batches, each written in a folder of its number: (folder, numbers). A batch that runs again replaces its rows."""
    out, numbers = fresh_path(df.sparkSession, "batches"), []

    def write(batch: DataFrame, number: int) -> None:
        f(batch, number).write.mode("overwrite").parquet(f"{out}/{number:09d}")
        numbers.append(number)

    writer = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint or fresh_path(df.sparkSession, "offsets"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return out, sorted(set(numbers))


def each_batch(stream: DataFrame, f: Callable[[DataFrame, int], DataFrame], checkpoint: str | None = None) -> DataFrame:
    """f over every micro-batch (batch frame, number), its rows appended; without a batch, f of no rows. An empty batch is given to f like others."""
    out, numbers = _written(stream, "append", f, checkpoint)
    spark = stream.sparkSession
    if not numbers:
        return f(spark.createDataFrame([], stream.schema), -1)
    return spark.read.parquet(*[f"{out}/{k:09d}" for k in numbers])


def run(df: DataFrame, mode: str, keys: list[str] | None = None, checkpoint: str | None = None, name: str | None = None) -> DataFrame:
    """All available input through a streaming frame, as Parquet: all rows in append mode, the last table in complete
    mode, the last state of each key in update mode. name: a view of the result, too. Null keys are keys like others."""
    out, numbers = _written(df, mode, lambda batch, k: batch.withColumn("__batch", F.lit(k)), checkpoint)
    spark = df.sparkSession
    if not numbers:
        found = spark.createDataFrame([], df.schema)
    else:
        found = spark.read.parquet(*[f"{out}/{k:09d}" for k in (numbers[-1:] if mode == "complete" else numbers)])
        if mode == "update":
            rest = [c for c in df.columns if c not in keys]
            last = found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("__s"))
            found = last.select(*keys, *[F.col("__s")[c].alias(c) for c in rest])
        found = found.select(*df.columns)
    if name:
        found.createOrReplaceTempView(name)
    return found


def to_memory(df: DataFrame, mode: str, name: str) -> DataFrame:
    """All available input into the memory sink, as view `name`: for results that fit the driver. Append and update accumulate, complete replaces."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.table(name)


class Running:
    """A started query: run what is there, count its batches, stop it."""

    def __init__(self, query: StreamingQuery):
        self.query = query

    def process_all(self) -> None:
        """Returns when all input that has arrived is in the sink; an error of the query is raised."""
        self.query.processAllAvailable()

    def batches(self) -> int:
        """Micro-batches executed, empty ones too."""
        last = self.query.lastProgress
        return 0 if last is None else int(last["batchId"]) + 1

    def rows(self) -> list[int]:
        """Input rows of each batch in the progress that Spark still holds."""
        return [int(p["numInputRows"]) for p in self.query.recentProgress]

    def stop(self) -> None:
        self.query.stop()

    def stopped(self) -> bool:
        return not self.query.isActive


def start(df: DataFrame, f: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> Running:
    """A query that gives each micro-batch to f until it is stopped."""
    writer = df.writeStream.outputMode(mode).foreachBatch(f).option("checkpointLocation", checkpoint or fresh_path(df.sparkSession, "offsets"))
    return Running(writer.start())


def to_console(df: DataFrame, mode: str = "append", rows: int = 10) -> Running:
    """A query that prints the first rows of each batch."""
    return Running(df.writeStream.outputMode(mode).format("console").option("numRows", rows).option("truncate", False).start())


def printed(batch: DataFrame, number: int, first: int = 10) -> str:
    """The first rows of a batch, and how many more there are."""
    rows = batch.take(first)
    more = batch.count() - len(rows)
    return "\n".join([f"batch {number}", *(str(tuple(r)) for r in rows), *([f"... {more} more"] if more > 0 else [])])


class Ticks:
    """A stream's micro-batches as ticks of a logical clock that moves only when told, with the batches that windows still need.

    At tick t the window of n holds the batches t - n + 1 to t: partial at the
    start, shrinking after the input's end, where ticks are empty. Batches older
    than `remember` ticks are forgotten. The history is Parquet in the shared
    folder, one folder a tick; a batch that runs again replaces its own.
    """

    def __init__(self, stream: DataFrame, remember: int):
        self.spark, self.schema, self.remember = stream.sparkSession, stream.schema, remember
        self.time, self._held, self._history = -1, [], fresh_path(self.spark, "history")
        self._go, self._done, self._ending = threading.Semaphore(0), threading.Semaphore(0), False
        writer = stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", fresh_path(self.spark, "offsets"))
        self._query = writer.trigger(availableNow=True).start()

    def _batch(self, batch: DataFrame, number: int) -> None:
        self._go.acquire()
        if not self._ending:
            batch.write.mode("overwrite").parquet(f"{self._history}/{number:09d}")
        self._done.release()

    def advance(self, ticks: int = 1) -> None:
        """The clock moves: each tick takes the next batch, if there is one."""
        for _ in range(ticks):
            self._go.release()
            while not (came := self._done.acquire(timeout=0.05)) and self._query.isActive:
                pass
            if error := self._query.exception():
                raise error
            self.time += 1
            if came or self._done.acquire(blocking=False):
                self._held.append(self.time)
            for t in [t for t in self._held if t <= self.time - self.remember]:
                self._held.remove(t)
                store, at = opened(f"{self._history}/{t:09d}")
                store.delete_dir(at)

    def slice(self, first: int, last: int) -> DataFrame:
        """The rows of the remembered batches of ticks first to last."""
        if last >= 0 and max(first, 0) < self.time - self.remember + 1:
            raise ValueError(f"ticks up to {self.time - self.remember} are forgotten")
        paths = [f"{self._history}/{t:09d}" for t in self._held if first <= t <= last]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def window(self, length: int) -> DataFrame:
        """The last `length` batches, at most as many as are remembered."""
        if length > self.remember:
            raise ValueError(f"{self.remember} batches are remembered, {length} are asked for")
        return self.slice(self.time - length + 1, self.time)

    def stop(self) -> None:
        """Ends the query; what has not been told to come does not come."""
        self._ending = True
        self._go.release(1 << 20)
        self._query.stop()


def batch_windows(stream: DataFrame, length: int, ticks: int, f: Callable[[DataFrame], DataFrame], slide: int = 1) -> DataFrame:
    """f of the window of `length` batches at each of the first `ticks` ticks that is a multiple of slide, with column window_end."""
    spark, out, ends = stream.sparkSession, fresh_path(stream.sparkSession, "windows"), []
    clock = Ticks(stream, length)
    try:
        for t in range(ticks):
            clock.advance()
            if t % slide == 0:
                f(clock.window(length)).withColumn("window_end", F.lit(t).cast("long")).write.parquet(f"{out}/{t:09d}")
                ends.append(f"{out}/{t:09d}")
    finally:
        clock.stop()
    return spark.read.parquet(*ends)


class Queue:
    """Frames in a queue, one for each tick, or all again at every tick without draining; default where none is left."""

    def __init__(self, frames: list[DataFrame], one_at_a_time: bool = True, default: DataFrame | None = None):
        self.frames, self.one_at_a_time, self.default = list(frames), one_at_a_time, default

    def tick(self) -> DataFrame | None:
        """The next batch; null where the queue is empty and there is no default."""
        if not self.frames:
            return self.default
        if self.one_at_a_time:
            return self.frames.pop(0)
        out = self.frames[0]
        for more in self.frames[1:]:
            out = out.unionByName(more)
        return out


def socket_lines(spark: SparkSession, host: str, port: int, column: str = "word") -> DataFrame:
    """Lines of a socket as one column. Without new lines there is no batch."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load().toDF(column)
