"""A source of one's own: files of bytes, each decoded to records by a pluggable decoder, in batches or as a stream.

The stream's offset is a number of files in the order of their names; each
trigger takes one file more. A decoder is a function from a binary stream to
tuples, named in DECODERS with its schema; the data source asks for it by name,
as only options travel to the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lakefold.operators.persist import opened


def lines(stream: BinaryIO) -> Iterator[tuple]:
    """UTF-8 lines, the last one with or without its end."""
    held = b""
    while piece := stream.read(1 << 16):
        *whole, held = (held + piece).split(b"\n")
        yield from ((w.decode(),) for w in whole)
    if held:
        yield (held.decode(),)


def longs(stream: BinaryIO) -> Iterator[tuple]:
    """Signed numbers of eight bytes, the highest byte first; a last piece that is shorter raises."""
    while piece := stream.read(8):
        if len(piece) < 8:
            raise EOFError("a number ends early")
        yield (int.from_bytes(piece, "big", signed=True),)


#: Decoders by name, with the schema of their records.
DECODERS: dict[str, tuple[Callable[[BinaryIO], Iterator[tuple]], str]] = {"lines": (lines, "value string"), "longs": (longs, "value long")}


def _files(path: str) -> list[str]:
    """Names of the data files below path, in order; hidden ones and markers are left out."""
    store, at = opened(path)
    found = store.get_file_info(fs.FileSelector(at))
    return sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


class _File(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Decoded:
    def __init__(self, options: dict):
        self.path, self.decode = options["path"], DECODERS[options.get("decoder", "lines")][0]

    def read(self, partition: _File) -> Iterator[tuple]:
        store, _ = opened(self.path)
        with store.open_input_stream(partition.name, compression=None) as stream:
            yield from self.decode(stream)


class _Batch(_Decoded, DataSourceReader):
    def partitions(self) -> list[_File]:
        return [_File(name) for name in _files(self.path)]


class _Stream(_Decoded, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.given = 0

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        self.given = min(self.given + 1, len(_files(self.path)))
        return {"files": self.given}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        self.given = max(self.given, end["files"])  # after a restart, go on from the offset log
        return [_File(name) for name in _files(self.path)[start["files"] : end["files"]]]

    def commit(self, end: dict) -> None:
        """Files stay, so there is nothing to let go of."""


class Records(DataSource):
    """format("lakefold_records"), options path and decoder."""

    @classmethod
    def name(cls) -> str:
        return "lakefold_records"

    def schema(self) -> str:
        return DECODERS[self.options.get("decoder", "lines")][1]

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session; again is harmless."""
    spark.dataSource.register(Records)
