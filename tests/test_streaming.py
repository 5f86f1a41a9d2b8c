"""Micro-batches, output modes, sources, sinks and batch-counted windows on small literals."""

import contextlib
import socketserver
import threading
import time

import pytest
from pyspark.sql import functions as F

from lakefold.sources import records
from lakefold.sources.io import from_rows
from lakefold.streaming import replay


def _words(spark, *batches):
    rows = [(k, w) for k, text in enumerate(batches) for w in text.split()]
    return from_rows(spark, rows, "b int, word string")


def _counts(df):
    return {r.word: r.n for r in df.collect()}


def test_complete_and_update(spark):
    words = _words(spark, "hello hello world", "hello spark")
    want = {"hello": 3, "world": 1, "spark": 1}
    grouped = lambda: replay.staged(words, F.col("b"), 2).groupBy("word").agg(F.count("*").alias("n"))
    assert _counts(replay.run(grouped(), "complete", name="t_view")) == want == _counts(spark.table("t_view"))
    assert _counts(replay.run(grouped(), "update", ["word"])) == want
    assert _counts(replay.to_memory(grouped(), "complete", "t_memory")) == want


def test_append_per_batch(spark):
    stream = replay.staged(_words(spark, "a b", "a c", "d"), F.col("b"), 3)
    got = replay.each_batch(stream, lambda df, k: df.groupBy("b", "word").agg(F.count("*").alias("n")))
    assert {(r.b, r.word, r.n) for r in got.collect()} == {(0, "a", 1), (0, "b", 1), (1, "a", 1), (1, "c", 1), (2, "d", 1)}


def test_batches_of_several_files_and_without_rows(spark):
    words = _words(spark, "a b c d", "", "e f")
    sizes = replay.each_batch(replay.staged(words, F.col("b"), 3), lambda df, k: df.agg(F.count("*").alias("n")).withColumn("k", F.lit(k)))
    assert {(r.k, r.n) for r in sizes.collect()} == {(0, 4), (1, 0), (2, 2)}
    with pytest.raises(ValueError):
        replay.staged(words, F.col("b"), 3, files=3)
    many = spark.range(400).withColumn("b", F.col("id") % 2)
    sizes = replay.each_batch(replay.staged(many, F.col("b"), 2, files=3), lambda df, k: df.agg(F.count("*").alias("n")))
    assert [r.n for r in sizes.collect()] == [200, 200]


def test_restart_continues(spark, tmp_path):
    """A second run on the same checkpoint sees nothing twice."""
    stream = replay.staged(_words(spark, "a", "b"), F.col("b"), 2)
    assert replay.each_batch(stream, lambda df, k: df, str(tmp_path / "ck")).count() == 2
    assert replay.each_batch(stream, lambda df, k: df, str(tmp_path / "ck")).count() == 0
    assert replay.run(stream, "append", checkpoint=str(tmp_path / "ck")).count() == 0


def test_clock_and_windows(spark):
    clock = replay.Ticks(replay.staged(_words(spark, "a", "b", "c", "d"), F.col("b"), 4), remember=3)
    sizes = []
    for t in range(6):
        clock.advance()
        assert clock.time == t
        sizes.append(clock.window(3).count())
    assert sizes == [1, 2, 3, 3, 2, 1]
    assert [r.word for r in clock.slice(3, 3).collect()] == ["d"] and clock.slice(9, 9).count() == 0
    for asked in (lambda: clock.slice(1, 2), lambda: clock.window(4)):
        with pytest.raises(ValueError):
            asked()
    clock.stop()
    words = replay.staged(_words(spark, "a a b", "a c"), F.col("b"), 2)
    got = replay.batch_windows(words, 2, 2, lambda w: w.groupBy("word").agg(F.count("*").alias("n")))
    assert _counts(got.where("window_end = 1")) == {"a": 3, "b": 1, "c": 1}


def test_clock_stands_until_told(spark):
    seen = []
    clock = replay.Ticks(replay.staged(_words(spark, "a", "b"), F.col("b"), 2).where(F.lit(True)), remember=9)
    time.sleep(1)
    seen.append(clock.window(9).count())
    clock.advance(2)
    seen.append(clock.window(9).count())
    clock.stop()
    assert seen == [0, 2]


def test_queue(spark):
    frames = [spark.range(2), spark.range(3)]
    again = replay.Queue(frames, one_at_a_time=False)
    assert [again.tick().count() for _ in range(3)] == [5, 5, 5]
    once = replay.Queue(frames, default=spark.range(0))
    assert [once.tick().count() for _ in range(3)] == [2, 3, 0]
    assert replay.Queue([]).tick() is None


def test_handle_and_console(spark, capfd):
    running = replay.to_console(replay.staged(_words(spark, "printed", "later"), F.col("b"), 2))
    running.process_all()
    assert running.batches() == 2 and running.rows()[:2] == [1, 1] and not running.stopped()
    running.stop()
    assert running.stopped()
    assert replay.printed(spark.range(12), 0).splitlines()[-1] == "... 2 more" and len(replay.printed(spark.range(12), 0).splitlines()) == 12


class _LineServer(socketserver.ThreadingTCPServer):
    """Sends lines to whoever connects, as they are put in."""

    allow_reuse_address, daemon_threads = True, True

    def __init__(self):
        super().__init__(("127.0.0.1", 0), _Sender)
        self.waiting: list[str] = []
        self.ended = False

    def send(self, lines):
        self.waiting += lines


class _Sender(socketserver.BaseRequestHandler):
    def handle(self):
        while not self.server.ended:
            while self.server.waiting:
                self.request.sendall((self.server.waiting.pop(0) + "\n").encode())
            time.sleep(0.02)


def test_socket_lines(spark):
    """Lines come as they are sent; without new ones there is no batch."""
    with contextlib.closing(_LineServer()) as server:
        server.close = server.server_close
        threading.Thread(target=server.serve_forever, daemon=True).start()
        sizes, words = [], []
        lines = replay.socket_lines(spark, *server.server_address)

        def take(batch, number):
            rows = batch.collect()
            sizes.append(len(rows))
            words.extend(r.word for r in rows)

        running = replay.start(lines, take)
        time.sleep(0.5)
        assert sum(sizes) == 0
        server.send(["one", "two"])
        end = time.time() + 30
        while len(words) < 2 and time.time() < end:
            time.sleep(0.1)
        batches = len(sizes)
        time.sleep(0.7)
        assert len(sizes) == batches
        server.send(["three"])
        while len(words) < 3 and time.time() < end:
            time.sleep(0.1)
        running.stop()
        server.ended = True
        server.shutdown()
    assert words == ["one", "two", "three"]


def test_own_source_as_stream(spark, tmp_path):
    """A file a trigger, and after a restart only what is new."""
    records.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    for k, text in enumerate(("a\nb\n", "c")):
        (folder / f"{k}.txt").write_text(text)

    def run():
        got = []
        stream = spark.readStream.format("lakefold_records").option("path", str(folder)).load()
        running = replay.start(stream, lambda df, k: got.append(sorted(r.value for r in df.collect())), checkpoint=str(tmp_path / "ck"))
        running.process_all()
        running.stop()
        return got

    assert run() == [["a", "b"], ["c"]]
    (folder / "2.txt").write_text("d\n")
    assert run() == [["d"]]


def test_stream_stream_join(spark):
    left = from_rows(spark, [(0, 1, 10), (1, 2, 20)], "b int, k int, at int")
    right = from_rows(spark, [(0, 1, 12), (1, 1, 99), (1, 2, 21)], "b int, k int, at int")

    def side(df, name):
        stream = replay.staged(df, F.col("b"), 2).select(F.col("k").alias(f"{name}k"), F.timestamp_seconds("at").alias(f"{name}t"))
        return stream.withWatermark(f"{name}t", "1 minute")

    joined = side(left, "l").join(side(right, "r"), F.expr("lk = rk AND rt >= lt AND rt <= lt + INTERVAL 5 SECONDS"))
    assert sorted(r.lk for r in replay.run(joined, "append").collect()) == [1, 2]
